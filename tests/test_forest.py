"""Forests grown by tasks are those of Spark ML, and their cost doesn't go with their nodes."""

import uuid

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler

import catalog
from catalog import training
from plumbline.operators import compiled, draws, forest, models

NAMES = ["a", "b", "c d", "e", "f"]


def noise(spark, n, classes, seed=5, parts=3):
    """Rows whose labels say little, so that trees grow as large as they can; zeros, repeated values and a constant feature."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 5)).round(2)
    x[:, 1] = rng.integers(-2, 3, n)
    x[:, 4] = 7.0
    y = np.where(rng.random(n) < 0.4, np.abs(x[:, 0]).astype(int) % classes, rng.integers(0, classes, n))
    rows = [(i, int(k), *map(float, v)) for i, (k, v) in enumerate(zip(y, x))]
    return spark.createDataFrame(rows, "row_id long, y int, a double, b double, `c d` double, e double, f double").repartition(parts).cache()


def spark_ml(df, trees, depth, least, seed):
    rows = VectorAssembler(inputCols=NAMES, outputCol="v").transform(df.withColumn("y", df.y.cast("double")))
    kind = RandomForestClassifier(featuresCol="v", labelCol="y", numTrees=trees, maxDepth=depth, minInstancesPerNode=least, seed=seed)
    return kind.fit(rows), rows


def node_rows(nodes):
    rows = nodes.select("treeID", "nodeData.*").drop("impurity").collect()
    return sorted((r.treeID, r.id, r.prediction, r.impurityStats, r.rawCount, round(r.gain, 12), r.leftChild, r.rightChild, *r.split[:2]) for r in rows)


def jobs_of(spark, run):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


@pytest.mark.parametrize("n, classes, trees, depth, least, seed", [(300, 4, 7, 30, 1, 42), (200, 2, 3, 5, 4, 1), (25, 3, 1, 30, 1, 9), (12_000, 3, 2, 6, 1, 42)])
def test_node_for_node_as_spark_ml(spark, tmp_path, n, classes, trees, depth, least, seed):
    df = noise(spark, n, classes)
    model = models.fit(models.FOREST, df, NAMES, n_estimators=trees, max_depth=depth, min_samples_leaf=least, random_state=seed)
    told, rows = spark_ml(df, trees, depth, least, seed)
    told.write().save(str(tmp_path / "told"))
    assert node_rows(model.classifiers[0].node_table(spark)) == node_rows(spark.read.parquet(str(tmp_path / "told/data")))
    assert [v for _, v in model.importance()] == pytest.approx(told.featureImportances.toArray().tolist(), abs=1e-12)
    got = {r.row_id: r.p for r in model.attach(df, NAMES, "p").collect()}
    assert all(got[r.row_id] == pytest.approx(r.probability.toArray().tolist(), abs=1e-12) for r in told.transform(rows).collect())


def test_jobs_do_not_go_with_the_levels(spark):
    """A job or more for each level of the trees, and each with statistics for all open nodes, took the time of large forests."""
    df = noise(spark, 300, 4)
    assert jobs_of(spark, lambda: models.fit(models.FOREST, df, NAMES, n_estimators=5)) <= 8


def test_several_tasks_keep_rows_and_trees(spark, monkeypatch):
    """Each tree has the rows that it has in one task, and grows until no split of tried features makes a node purer."""
    df = noise(spark, 400, 3)
    one = models.fit(models.FOREST, df, NAMES, n_estimators=9).classifiers[0]
    monkeypatch.setattr(forest, "TASK_CELLS", 800)
    monkeypatch.setattr(forest, "STEP_CELLS", 64)
    many = models.fit(models.FOREST, df, NAMES, n_estimators=9).classifiers[0]
    roots = [[r for r in node_rows(m.node_table(spark)) if r[1] == 0] for m in (one, many)]
    assert len(many.trees) == 9 and [r[3] for r in roots[0]] == [r[3] for r in roots[1]]
    for tree in many.trees:
        leaf = tree.feature < 0
        held = tree.stats[tree.link[leaf]]
        assert 20 < leaf.sum() and (held.sum(axis=1) > 0).all() and (held.max(axis=1) / held.sum(axis=1)).mean() > 0.9
    assert node_rows(one.node_table(spark)) != node_rows(many.node_table(spark))
    assert abs(many.importances() - one.importances()).max() < 0.1


def test_steps_of_a_level_do_not_matter(spark, monkeypatch):
    df = noise(spark, 400, 3)
    want = node_rows(models.fit(models.FOREST, df, NAMES, n_estimators=4).classifiers[0].node_table(spark))
    monkeypatch.setattr(forest, "STEP_CELLS", 16)
    assert node_rows(models.fit(models.FOREST, df, NAMES, n_estimators=4).classifiers[0].node_table(spark)) == want


def test_saved_forest_predicts_the_same(spark, tmp_path):
    df = noise(spark, 150, 3).selectExpr("*", "'test' AS split")
    book = models.ModelBook()
    book.train(models.FOREST, df, NAMES, n_estimators=5)
    book.save(models.FOREST, str(tmp_path / "random_forest"))
    again = models.ModelBook()
    again.load(models.FOREST, str(tmp_path / "random_forest"))
    want = {r.row_id: (r.y_pred, r.proba) for r in book.predict(models.FOREST, df).collect()}
    assert {r.row_id: (r.y_pred, r.proba) for r in again.predict(models.FOREST, df).collect()} == want
    assert again.get(models.FOREST).importance() == book.get(models.FOREST).importance()


def test_what_spark_ml_refuses_is_refused(spark):
    df = noise(spark, 40, 2)
    for bad, what in ((df.selectExpr("row_id", "y", "a", "b", "`c d`", "if(row_id = 3, null, e) AS e", "f"), "without values"), (df.selectExpr("if(row_id = 3, -1, y) AS y", "a", "b", "`c d`", "e", "f"), "labels"), (df.selectExpr("if(row_id = 3, null, y) AS y", "a", "b", "`c d`", "e", "f"), "labels"), (df.selectExpr("0 AS y", "a", "b", "`c d`", "e", "f"), "two classes")):
        with pytest.raises(Exception, match=what):
            models.fit(models.FOREST, bad, NAMES, n_estimators=2)
    for params in ({"max_depth": 31}, {"min_samples_split": 3}):
        with pytest.raises(ValueError):
            models.fit(models.FOREST, df, NAMES, **params)
    model = models.fit(models.FOREST, df, NAMES, n_estimators=2)
    with pytest.raises(Exception, match="without values"):
        model.attach(df.selectExpr("a", "b", "`c d`", "e", "cast('NaN' AS double) AS f"), NAMES, "p").collect()


def test_draws_are_those_of_the_jvm(spark):
    jvm = spark._jvm
    for seed in (43, 2**40 + 5, -3):
        told = jvm.org.apache.commons.math3.distribution.PoissonDistribution(1.0)
        told.reseedRandomGenerator(seed)
        mine = draws.Poisson(seed)
        assert np.concatenate([mine.counts(n) for n in (1, 7, 500, 1200)]).tolist() == list(told.sample(1708))
    for seed in (42, 0, -7):
        assert draws.sample_seed(seed) == jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
    random, mine = jvm.java.util.Random(11), draws.Subsets(11, 64, 8)
    assert mine._longs(6).view(np.int64).tolist() == [random.nextLong() for _ in range(6)]
    assert sorted(draws.map_order(range(100))) == [*range(100)] and draws.map_order([50, 3, 77, 12, 80]) != [3, 12, 50, 77, 80]


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    """A folder with 200 vectors of ten classes, their split, and Spark ML's forest on the training rows."""
    folder = str(tmp_path_factory.mktemp("vectors"))
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(200, 64)).astype(np.float32), rng.integers(0, 10, 200)
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, y))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    df = training.rows(spark, folder)
    table = VectorAssembler(inputCols=training.COLUMNS, outputCol="v").transform(df.withColumn("label", df.y.cast("double")))
    told = RandomForestClassifier(featuresCol="v", labelCol="label", numTrees=100, maxDepth=30, seed=42).fit(table.filter("split = 'train'"))
    return folder, told, table


def asked(spark, folder, name, most_jobs):
    """The rows of a query; no more jobs than given, as there would be with jobs for each level of the trees."""
    out = []
    jobs = jobs_of(spark, lambda: out.extend(catalog.load()[name].run(spark, folder).collect()))
    assert jobs <= most_jobs
    return out


def test_top_features_are_spark_mls(spark, vectors):
    folder, told, _ = vectors
    got = asked(spark, folder, "m13_top_features", 32)
    want = sorted(((-round(v, 6), f) for v, f in zip(told.featureImportances.toArray(), training.COLUMNS)))[:10]
    assert [(-r.importance, r.feature) for r in got] == want


def test_importances_are_spark_mls(spark, vectors):
    folder, told, _ = vectors
    got = asked(spark, folder, "m12_feature_importance", 33)
    assert len(got) == 64 and [r.importance for r in got] == sorted((r.importance for r in got), reverse=True)
    assert {r.feature: r.importance for r in got} == pytest.approx(dict(zip(training.COLUMNS, told.featureImportances.toArray())), abs=1e-6)


def test_metrics_are_those_of_spark_mls_predictions(spark, vectors):
    folder, told, table = vectors
    got = {r.split: r for r in asked(spark, folder, "m2_random_forest", 34)}
    rows = told.transform(table).selectExpr("split", "cast(prediction = label AS double) AS hit").groupBy("split").avg("hit").collect()
    assert {r[0]: round(r[1], 6) for r in rows} == {s: r.accuracy for s, r in got.items()} and len(got) == 3


def test_all_rows_are_scored_soundly(spark, vectors):
    got = asked(spark, vectors[0], "m2_forest_soundness", 32)
    assert [r.asDict() for r in got] == [{"rows": 200, "sums": 200, "labels": 200, "known": 200}]


def test_top_features_by_nodes_agree(spark, vectors):
    got = asked(spark, vectors[0], "m13_top_features_by_nodes", 50)
    assert sorted(r.place for r in got) == [*range(1, 11)] and all(r.same_feature and r.same_importance and r.shown == 10 for r in got)


def test_nodes_are_not_in_the_plan(spark):
    """The nodes reach the tasks by one broadcast, whatever is asked of them, not through the driver's heap."""
    model = models.fit(models.FOREST, noise(spark, 200, 3), NAMES, n_estimators=4)
    nodes = model.classifiers[0].node_table(spark)
    assert "Range (0, 4" in nodes._jdf.queryExecution().optimizedPlan().toString()
    assert model.classifiers[0]._shared(spark) is model.classifiers[0]._shared(spark)
    assert nodes.count() == sum(len(t.feature) for t in model.classifiers[0].trees)


def test_arrays_agree_with_the_pipeline(spark, vectors):
    got = asked(spark, vectors[0], "m4_predictions_by_arrays", 85)
    assert sorted((r.model, r.row_id) for r in got) == sorted((k, i) for k in (models.LOGISTIC, models.FOREST) for i in range(200))
    assert all(r.same_label and r.same_probabilities for r in got)


def test_the_driver_gets_a_row_a_tree(spark):
    """Not a row a node, of which large forests have millions."""
    model = models.fit(models.FOREST, noise(spark, 200, 3), NAMES, n_estimators=4)
    rows = compiled.packed(compiled.node_table(spark, model), False).collect()
    assert sorted(r.tree for r in rows) == [*range(4)]
    sizes = {r.tree: len(r.left) // 4 for r in rows}
    assert sizes == {t: len(tree.feature) for t, tree in enumerate(model.classifiers[0].trees)} and min(sizes.values()) > 50
