"""Exactness and partition invariance against brute force."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import arrays, keyed
from plumbline.operators import blocks, clean, features, order_stats, profile, stress
from plumbline.operators.selection import Cut, cuts
from plumbline.operators.stress import StressTest

RNG = np.random.default_rng(7)


@pytest.fixture(scope="module")
def cells(spark):
    pdf = pd.DataFrame(
        {
            "row_id": np.arange(4000),
            "x_1": RNG.normal(3, 2, 4000),
            "x_2": RNG.uniform(-1, 5, 4000),
            "y": RNG.integers(0, 3, 4000),
            "split": "test",
        }
    )
    return spark.createDataFrame(pdf).cache(), pdf


@pytest.mark.parametrize("limit", [5, 50, 250_000])
def test_quantiles_are_exact_with_hot_values(spark, limit):
    values = np.concatenate([np.full(1500, 2.5), RNG.lognormal(0, 2, 2000), -RNG.uniform(0, 1, 500), [1e12]])
    pdf = pd.DataFrame({"g": np.where(np.arange(len(values)) % 3 == 0, "a", "b"), "v": RNG.permutation(values)})
    df = spark.createDataFrame(pdf).repartition(7)
    got = order_stats.quantile_values(df, ["g"], "v", [0.0, 0.25, 0.5, 0.9, 1.0], bracket_rows=limit)
    for g, part in pdf.groupby("g"):
        want = np.quantile(part.v, [0.0, 0.25, 0.5, 0.9, 1.0])
        assert np.allclose(got[(g,)], want, rtol=1e-12), g


def test_narrowing_rounds_reach_small_brackets(spark):
    df = spark.range(0, 300_000, 1, 6).select((F.col("id") * 7919 % 300_007).cast("double").alias("v"))
    values = np.sort((np.arange(300_000) * 7919 % 300_007).astype(float))
    got = order_stats.select_ranks(df, [], "v", {(): [0, 12_345, 150_000, 299_999]}, bracket_rows=2000)
    for rank in (0, 12_345, 150_000, 299_999):
        value, below, equal = got[((), rank)]
        assert value == values[rank] and below <= rank < below + equal


def test_empty_and_constant_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", None)], "g string, v double")
    assert order_stats.quantile_values(df, ["g"], "v", [0.5]) == {("a",): [1.0], ("b",): [None]}


def test_cut_breaks_ties_by_key(spark):
    df = spark.createDataFrame([(i, 0.25 if i < 6 else 0.75) for i in range(10)], "k long, u double")
    found = cuts(df, [], "u", "k", {(): [4, 0, 10]}, {(): 10})
    assert found[((), 4)] == Cut(0.25, ("0", "1", "2", "3"))
    picked = df.filter(found[((), 4)].contains(F.col("u"), F.col("k")))
    assert sorted(r.k for r in picked.collect()) == [0, 1, 2, 3]
    assert df.filter(found[((), 0)].contains(F.col("u"), F.col("k"))).count() == 0
    assert df.filter(found[((), 10)].contains(F.col("u"), F.col("k"))).count() == 10


@pytest.mark.parametrize("order", [["k"], ["t", "k"]])
@pytest.mark.parametrize("n_blocks", [23, 1])
def test_directional_fill_matches_pandas(spark, order, n_blocks):
    n = 900
    t = np.where(np.arange(n) % 3 == 0, 50, RNG.integers(0, 100, n))
    v = np.where(RNG.random(n) < 0.7, np.nan, RNG.normal(size=n))
    pdf = pd.DataFrame({"k": RNG.permutation(n), "t": t, "v": v})
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).repartition(5)
    sorted_pdf = pdf.sort_values(order)
    for method, want in (("forward_fill", sorted_pdf.v.ffill()), ("backward_fill", sorted_pdf.v.bfill())):
        got = clean.directional_fill(df, {"v": method}, order, n_blocks).toPandas().set_index("k").v
        expected = pd.Series(want.values, index=sorted_pdf.k.values)
        both = pd.concat([got, expected], axis=1)
        assert ((both.iloc[:, 0] == both.iloc[:, 1]) | (both.iloc[:, 0].isna() & both.iloc[:, 1].isna())).all()


def test_blocks_split_a_hot_leading_value(spark):
    n = 3000
    df = spark.createDataFrame([(5 if i % 3 else i, i) for i in range(n)], "t long, k long")
    sizes = blocks.range_blocks(df, ["t", "k"], 30).groupBy(blocks.BLOCK).count().toPandas()
    assert sizes["count"].max() < 500
    ordered = blocks.range_blocks(df, ["t", "k"], 30).orderBy("t", "k").toPandas()[blocks.BLOCK]
    assert ordered.is_monotonic_increasing


@pytest.mark.parametrize("n_blocks", [1, 9])
def test_directional_fill_keeps_null_and_text_keys(spark, n_blocks):
    """Rows with a null leading key come first; text keys are keys like any other."""
    rows = [(None if i % 7 == 0 else f"t{i % 13:02d}", i, i if i % 5 == 0 else None) for i in range(120)]
    df = spark.createDataFrame(rows, "t string, k long, v long").repartition(4)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    for method, sequence in (("forward_fill", order), ("backward_fill", order[::-1])):
        want, last = {}, None
        for _, k, v in sequence:
            last = v if v is not None else last
            want[k] = last
        got = clean.directional_fill(df, {"v": method}, ["t", "k"], n_blocks).collect()
        assert {r.k: r.v for r in got} == want and len(got) == len(rows)


@pytest.mark.parametrize("k", [3, 5, 40])
def test_a_wrong_number_of_classes_is_an_error(spark, k):
    p = F.array(*[F.lit(x) for x in (0.1, 0.2, 0.3, 0.4)])
    for value in (arrays.entropy(p, k), arrays.squared_error(p, F.lit(1), k), arrays.tempered(p, F.lit(2.0), k), arrays.log_gaps(p, k)):
        with pytest.raises(Exception, match="classes"):
            spark.range(1).select(value).collect()
    right = spark.range(1).select(arrays.entropy(p, 4).alias("a"), arrays.entropy(p).alias("b"), arrays.entropy(F.lit(None).cast("array<double>"), 4).alias("c")).first()
    assert abs(right.a - right.b) < 1e-12 and right.c is None


def test_cells_of_wide_rows_drop_independently(spark):
    """The number of dropped cells of a row over 64 columns is binomial."""
    d, n, rate = 64, 4000, 0.3
    names = [f"x{j}" for j in range(d)]
    df = spark.range(n).select(F.col("id").alias("row_id"), *[(F.lit(1.0) + F.col("id") % 7).alias(c) for c in names])
    moved = stress.perturb(df, names, [StressTest("feature_dropout", {"dropout_rate": rate})])
    cells = np.array([[r[c] == 0.0 for c in names] for r in moved.select(names).collect()])
    counts = cells.sum(axis=1)
    assert abs(counts.mean() - d * rate) < 0.2
    assert abs(counts.var() / (d * rate * (1 - rate)) - 1) < 0.12
    skew = ((counts - counts.mean()) ** 3).mean() / counts.std() ** 3
    assert abs(skew - (1 - 2 * rate) / math.sqrt(d * rate * (1 - rate))) < 0.2
    assert abs(np.corrcoef(cells.T) - np.eye(d)).max() < 0.1


@pytest.mark.parametrize("partitions", [1, 7, 200])
def test_perturbation_does_not_depend_on_partitions(cells, partitions):
    df, _ = cells
    tests = [t for t in stress.DEFAULT_SUITE if t.title in ("Gaussian Noise (High)", "Corruption (15%, random)", "Feature Dropout (20%)")]
    digest = lambda d: d.agg(F.sum(F.xxhash64("row_id", "test_name", F.round("x_1", 9), F.round("x_2", 9)) % 1000003)).first()[0]
    one = digest(stress.perturb(df.coalesce(1), ["x_1", "x_2"], tests))
    assert digest(stress.perturb(df.repartition(partitions), ["x_1", "x_2"], tests)) == one


def perturbed(df, type_, **params):
    return stress.perturb(df, ["x_1", "x_2"], [StressTest(type_, params)]).toPandas().sort_values("row_id")


def test_corruption_hits_exactly_the_asked_rows(cells):
    df, pdf = cells
    for rate in (0.0, 0.1, 0.25):
        got = perturbed(df, "feature_corruption", corruption_rate=rate, corruption_type="zero")
        for c in ("x_1", "x_2"):
            assert (got[c].values == 0).sum() == int(len(pdf) * rate)
    extreme = perturbed(df, "feature_corruption", corruption_rate=0.2, corruption_type="extreme")
    ends = extreme.x_1.isin([pdf.x_1.min(), pdf.x_1.max()]).sum()
    assert int(len(pdf) * 0.2) <= ends <= int(len(pdf) * 0.2) + 2
    mean = perturbed(df, "feature_corruption", corruption_rate=0.1, corruption_type="mean")
    assert np.isclose(mean.x_2, pdf.x_2.mean()).sum() == 400


def test_noise_moments(cells):
    df, pdf = cells
    noise = perturbed(df, "gaussian_noise", noise_level=0.5).x_1.values - pdf.x_1.values
    assert abs(noise.mean()) < 0.06 and abs(noise.std() - 0.5 * pdf.x_1.std(ddof=0)) < 0.05
    assert abs(np.corrcoef(noise, pdf.x_1)[0, 1]) < 0.06
    uniform = perturbed(df, "uniform_noise", noise_range=0.1).x_2.values - pdf.x_2.values
    assert np.abs(uniform).max() <= 0.1 * (pdf.x_2.max() - pdf.x_2.min()) + 1e-9
    dropped = perturbed(df, "feature_dropout", dropout_rate=0.3)
    share = (dropped[["x_1", "x_2"]].values == 0).mean()
    assert abs(share - 0.3) < 4 * math.sqrt(0.3 * 0.7 / 8000)


def test_shifts_and_scale(cells):
    df, pdf = cells
    mean = perturbed(df, "distribution_shift", shift_type="mean", shift_amount=0.5)
    assert np.allclose(mean.x_1.values, pdf.x_1 + 0.5 * pdf.x_1.std(ddof=0))
    var = perturbed(df, "distribution_shift", shift_type="variance", shift_amount=1.5)
    assert np.isclose(var.x_2.std(ddof=0), 1.5 * pdf.x_2.std(ddof=0)) and np.isclose(var.x_2.mean(), pdf.x_2.mean())
    scaled = perturbed(df, "scale_perturbation", scale_factor=2.0)
    for c in ("x_1", "x_2"):
        ratio = np.unique(np.round(scaled[c].values / pdf[c].values, 9))
        assert len(ratio) == 1 and ratio[0] in (2.0, 0.5)


def test_draws_look_uniform_and_independent(spark):
    key = spark.range(20000).withColumnRenamed("id", "k")
    worded = stress._with_words(key, "k", 42).selectExpr(
        *[f"{keyed.open_uniform(keyed.line([f'__w_{i}' for i in range(4)], 'f', s))} AS u{s}" for s in range(3)]
    ).toPandas()
    assert abs(worded.mean() - 0.5).max() < 0.01 and abs(worded.var() - 1 / 12).max() < 0.003
    corr = worded.corr().values - np.eye(3)
    assert np.abs(corr).max() < 0.03
    fine = np.histogram2d(worded.u0, worded.u1, bins=10)[0]
    assert ((fine - 200) ** 2 / 200).sum() < 160


@pytest.mark.parametrize("classes,stratified", [(9, True), (10, False)])
def test_split_sizes(spark, classes, stratified):
    n = 997
    pdf = pd.DataFrame({"k": np.arange(n), "y": np.arange(n) % classes})
    got = features.split(spark.createDataFrame(pdf), "y", "k", 0.2, 0.1).toPandas()
    n_test = math.ceil(n * 0.2)
    n_val = math.ceil((n - n_test) * (0.1 / 0.8))
    assert (got.split == "test").sum() == n_test and (got.split == "validation").sum() == n_val
    share = got[got.split == "test"].groupby("y").size() / got.groupby("y").size()
    assert (share.max() - share.min() < 0.02) == stratified
    again = features.split(spark.createDataFrame(pdf).repartition(13), "y", "k", 0.2, 0.1).toPandas()
    assert got.sort_values("k").split.tolist() == again.sort_values("k").split.tolist()


def test_split_that_loses_classes_stratifies_the_second_cut(spark):
    pdf = pd.DataFrame({"k": np.arange(300), "y": np.where(np.arange(300) < 297, np.arange(300) % 9, 9)})
    for seed in range(40):
        df = spark.createDataFrame(pdf)
        drawn = features.split(df.filter("y < 9 or k = 297"), "y", "k", 0.2, 0.1, seed).toPandas()
        if (drawn[drawn.y == 9].split == "test").all():
            assert (drawn.split == "validation").sum() == math.ceil((298 - 60) * 0.125)
            return
    pytest.fail("no seed put the rare class into the test split")


def test_split_rejects_a_class_of_one_row(spark):
    df = spark.createDataFrame([(i, 0) for i in range(20)] + [(99, 1)], "k long, y int")
    with pytest.raises(ValueError):
        features.split(df, "y", "k")


def test_encode_round_trip(spark):
    df = spark.createDataFrame([(i, f"c{i % 37:02d}" if i % 11 else None) for i in range(500)], "k long, c string")
    encoded, mapping = features.label_encode(df, ["c", "missing"])
    book = {r.category: r.code for r in mapping.collect()}
    assert list(book) and sorted(book, key=book.get) == sorted(book) and book["nan"] == len(book) - 1
    back = features.label_decode(encoded, "c", mapping).toPandas().set_index("k").c
    assert all(back[r.k] == (r.c or "nan") for r in df.collect())


def test_one_hot_drops_first_and_nulls_are_false(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "c")], "k int, c string")
    got = features.one_hot(df, ["c"]).orderBy("k")
    assert got.columns == ["k", "c_b", "c_c"]
    assert [tuple(r)[1:] for r in got.collect()] == [(True, False), (False, False), (False, False), (False, True)]


def test_scale_constant_column_divides_by_one(spark):
    df = spark.createDataFrame([(1.0, 5.0, "train"), (3.0, 5.0, "train"), (None, 5.0, "test")], "a double, b double, split string")
    got = features.scale(df, ["a", "b"]).collect()
    assert [r.a for r in got] == [-1.0, 1.0, None] and all(r.b == 0.0 for r in got)


def test_distinct_counts_and_duplicates_with_long_text(spark):
    long = "x" * 500
    df = spark.createDataFrame([(long, 0.0), (long, -0.0), (long + "y", 1.0), (None, None), (None, None)], "t string, v double")
    got = {r.column: r.distinct for r in profile.distinct_counts(df).collect()}
    assert got == {"t": 2, "v": 2}
    assert profile.duplicates(df).first()[0] == 2
    totals = profile.totals(df).first()
    assert (totals.rows, totals.missing, totals.duplicates) == (5, 4, 2)


@pytest.mark.parametrize("bracket_rows", [order_stats.BRACKET_ROWS, 5000, 300])
def test_column_quantiles_are_exact(spark, bracket_rows, monkeypatch):
    monkeypatch.setattr(order_stats, "SMALL_GROUP", 1000)
    rng = np.random.default_rng(3)
    n = 60_000
    pdf = pd.DataFrame({"a b": rng.normal(size=n), "hot": np.where(rng.random(n) < 0.7, 3.0, rng.integers(0, 9, n)), "wild": rng.standard_cauchy(n) * 1e9})
    pdf["few"] = pd.Series([1.5, -2.5, 7.0] + [None] * (n - 3))
    df = spark.createDataFrame(pdf.replace({np.nan: None}).astype(object).where(pdf.notna(), None), "`a b` double, hot double, wild double, few double").repartition(7)
    probabilities = (0.0, 0.01, 0.25, 0.5, 0.75, 1.0)
    row, got = order_stats.column_quantiles(df, list(pdf), probabilities, [F.sum("hot").alias("total")], bracket_rows)
    assert row["total"] == pdf.hot.sum()
    for c in pdf:
        assert np.allclose(got[c], np.quantile(pdf[c].dropna(), probabilities), rtol=1e-12)


def test_column_quantiles_survive_a_wrong_sketch(spark, monkeypatch):
    monkeypatch.setattr(order_stats, "SMALL_GROUP", 10)
    monkeypatch.setattr(order_stats, "around", lambda ps: [0.9, 0.95] * len(ps))  # brackets that miss the ranks
    df = spark.range(5000).selectExpr("cast(id AS double) AS v", "cast(null AS double) AS none")
    assert order_stats.column_quantiles(df, ["v", "none"], [0.5])[1] == {"v": [2499.5], "none": [None]}
    assert order_stats.column_quantiles(df.limit(0), ["v"], [0.5])[1] == {"v": [None]}


def test_wide_rows_are_perturbed_as_narrow_ones(spark):
    """A column's cells depend on its own name, values and tests only, however many columns there are."""
    wide = spark.range(300).selectExpr("id AS row_id", "'x' AS split", *[f"sin(id * {i + 1}) AS x_{i}" for i in range(150)])
    moved = stress.perturb(wide, [f"x_{i}" for i in range(150)], stress.DEFAULT_SUITE).select("row_id", "test_seq", "x_7", "x_149")
    few = stress.perturb(wide.select("row_id", "split", "x_149", "x_7"), ["x_149", "x_7"], stress.DEFAULT_SUITE)
    key = ["row_id", "test_seq"]
    a, b = moved.toPandas().sort_values(key), few.select(moved.columns).toPandas().sort_values(key)
    assert len(a) == 300 * 19 and np.allclose(a.values.astype(float), b.values.astype(float), rtol=1e-12)


def test_each_part_has_its_own_exact_number_of_cells(spark):
    rows = spark.range(900).selectExpr("id AS row_id", "CASE WHEN id % 9 = 0 THEN null WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS split", "1 AS y", "id + 1.0 AS x")
    test = [StressTest("feature_corruption", {"corruption_rate": 0.3, "corruption_type": "zero"})]

    class Sign:
        name = "sign"

        def attach(self, df, features, column):
            return df.withColumn(column, F.when(F.col("x") > 0, F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0))))

    got = {r["split"]: (r["accuracy_original"], round(r["accuracy_stressed"], 9)) for r in stress.run([Sign()], rows, ["x"], test).collect()}
    assert got == {s: (1.0, round(1 - int(n * 0.3) / n, 9)) for s, n in ((None, 100), ("a", 200), ("b", 600))}


def test_dense_confusion_of_many_labels(spark):
    from plumbline.operators import evaluate

    k = 400
    rows = spark.range(20_000).selectExpr("cast(id % 2 AS string) AS model", f"cast(id % {k} AS int) AS y_true", f"cast(id * id % {k + 7} AS int) AS y_pred")
    got = evaluate.confusion_matrix(rows, ("model",)).toPandas()
    pdf = rows.toPandas()
    for model, own in pdf.groupby("model"):
        labels = sorted(set(own.y_true) | set(own.y_pred))
        want = pd.crosstab(own.y_true, own.y_pred).reindex(index=labels, columns=labels, fill_value=0)
        dense = got[got.model == model].pivot(index="y_true", columns="y_pred", values="n")
        assert (dense.loc[labels, labels].values == want.values).all() and len(dense) == len(labels)


def test_column_quantiles_with_nan_and_infinities(spark, monkeypatch):
    monkeypatch.setattr(order_stats, "SMALL_GROUP", 100)
    n = 3000
    df = spark.range(n).selectExpr("CASE WHEN id % 3 = 0 THEN double('NaN') WHEN id % 3 = 1 THEN double('-inf') ELSE cast(id AS double) END AS v")
    got = order_stats.column_quantiles(df, ["v"], [0.1, 0.5, 0.9, 1.0])[1]["v"]
    finite = sorted(float(i) for i in range(n) if i % 3 == 2)
    assert got[0] == -math.inf or math.isnan(got[0])
    h = (n - 1) * 0.5 - 1000
    assert got[1] == pytest.approx(finite[math.floor(h)] + (finite[math.ceil(h)] - finite[math.floor(h)]) * (h - math.floor(h)))
    assert math.isnan(got[2]) and math.isnan(got[3])
