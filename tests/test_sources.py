"""Readers and writers."""

import json

import pytest

from plumbline.operators import confidence, models, report, robustness
from plumbline.plans import scorecard
from plumbline.sources import artifacts, readers, records, sinks, stored


def test_csv_turns_nan_into_null(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("a,b,c\n1,NaN,x\n2,2.5,\n3,,z\n")
    df = readers.read_csv(spark, str(path))
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["bigint", "double", "string"]
    assert [r.b for r in df.orderBy("a").collect()] == [None, 2.5, None]
    typed = readers.read_csv(spark, str(path), "a long, b double, c string")
    assert typed.filter("b IS NULL").count() == 2
    typed.write.parquet(str(tmp_path / "p"))
    assert readers.read_parquet(spark, str(tmp_path / "p")).count() == 3


def test_prediction_exports(spark, golden, tmp_path):
    sinks.write_predictions(confidence.confidence_frame(golden), str(tmp_path / "pred"))
    back = spark.read.csv(str(tmp_path / "pred"), header=True, inferSchema=True)
    assert back.columns == ["True_Label", "Predicted_Label", "Confidence", "Correct"] and back.count() == 10
    sinks.write_predictions(confidence.high_confidence_errors(golden, 0.8), str(tmp_path / "errors"))
    assert spark.read.csv(str(tmp_path / "errors"), header=True).count() == 1


def test_stress_and_text_exports(spark, stress_table, tmp_path):
    sinks.write_stress(stress_table, str(tmp_path / "stress"))
    assert spark.read.csv(str(tmp_path / "stress"), header=True).columns == list(sinks.STRESS_COLUMNS.values())
    sinks.write_csv(robustness.vulnerability(stress_table), str(tmp_path / "vulnerability"))
    lines = robustness.recommendations(stress_table)
    sinks.write_lines(lines, "text", ["model", "line"], str(tmp_path / "advice"))
    text = "".join(p.read_text() for p in (tmp_path / "advice").glob("part-*"))
    assert text.startswith("✅ **Excellent robustness**")


def test_report_document_and_sections(spark, golden, stress_table, tmp_path):
    trained = spark.createDataFrame([("m", 0), ("idle", 1)], "model string, model_seq int")
    built = scorecard.compile_report(trained, golden, stress_table, n_classes=3)
    summary = built["summary"].first()
    assert (summary.best_performance, summary.num_models, summary.num_stressed, summary.num_calibrated) == ("m", 2, 1, 1)
    assert len(summary.generated_at) == 19 and summary.dataset_name == "Test"
    document = json.loads(report.as_document(built["summary"], built["sections"]).first().report)
    assert {len(document[s]) for s in ("performance", "calibration")} == {1}
    assert len(document["robustness"]) == 5 and len(document["reliability"]) == 2
    sinks.write_sections(built["sections"], str(tmp_path / "report"))
    combined = spark.read.csv(str(tmp_path / "report" / "all"), header=True)
    assert combined.columns[0] == "Section" and combined.count() == 1 + 5 + 1 + 2
    sinks.write_json(built["summary"], str(tmp_path / "json"))
    assert sinks.all_sections({}) is None
    empty = report.summary(trained, {}).first()
    assert (empty.best_performance, empty.most_robust, empty.num_stressed) == ("N/A", "N/A", 0)


def test_models_train_score_save_and_list(spark, tmp_path):
    import numpy as np
    import pandas as pd
    import pytest

    rng = np.random.default_rng(3)
    n = 300
    y = np.arange(n) % 3
    pdf = pd.DataFrame({"row_id": np.arange(n), "a": y + rng.normal(0, 0.4, n), "b": -y + rng.normal(0, 0.4, n), "c": rng.normal(size=n), "y": y})
    pdf["split"] = np.where(np.arange(n) % 5 == 0, "test", "train")
    df = spark.createDataFrame(pdf).cache()
    train = df.filter("split = 'train'")
    book = models.ModelBook()
    book.train(models.LOGISTIC, train, ["a", "b", "c"])
    book.train(models.FOREST, train, ["a", "b", "c"], n_estimators=10, max_depth=4)
    book.train(models.BOOSTED, train, ["a", "b", "c"], n_estimators=3, max_depth=2)
    metrics = {(r.model, r.split): r.accuracy for r in book.evaluate(df).collect()}
    assert len(metrics) == 6 and min(metrics.values()) > 0.6
    pred = book.predict(models.BOOSTED, df)
    assert pred.filter("abs(aggregate(proba, 0D, (s, x) -> s + x) - 1) > 1e-9").count() == 0
    assert models.importance_frame(spark, book.get(models.LOGISTIC)) is None
    top = models.importance_frame(spark, book.get(models.FOREST), 2).collect()
    assert {r.feature for r in top} == {"a", "b"}
    for name in (models.LOGISTIC, models.BOOSTED):
        book.save(name, artifacts.artifact_path(str(tmp_path), name))
        again = models.ModelBook()
        again.load(name, artifacts.artifact_path(str(tmp_path), name))
        want = {r.row_id: r.y_pred for r in book.predict(name, df).collect()}
        assert {r.row_id: r.y_pred for r in again.predict(name, df).collect()} == want
    listed = {r.folder: r.display_name for r in artifacts.list_models(spark, str(tmp_path)).collect()}
    assert listed == {"logistic_regression": "Logistic Regression", "xgboost": "Xgboost"}
    with pytest.raises(ValueError, match="Unknown model"):
        models.fit("SVM", train, ["a"])
    with pytest.raises(ValueError, match="not trained"):
        book.predict("nobody", df)
    with pytest.raises(ValueError, match="not trained"):
        book.save("nobody", str(tmp_path / "x"))


CSV_LINES = [
    'a,b,"c ""d"" e"',
    "1,2,3",
    '4,"two\nlines",x',
    "",
    '5,"a ""quote"", a comma\n\n\nand ""more""",',
    '6,5" pipe,not a "quote" here',
    '7,"","x"',
    '8,"closed" early,"y"',
    '9,"\n",z',
    '"a","b","c"',
    '10,"' + "long text\n" * 40 + '",end',
    "11,NA,é日本",
    '12,only two',
]


def csv_cells(text):
    """Cells by the rules of the format: the way the reader must see the text, whatever its splits."""
    rows, cell, row, i, quoted, fresh = [], "", [], 0, False, True
    while i < len(text):
        c = text[i]
        if quoted:
            if c == '"' and text[i + 1 : i + 2] == '"':
                cell, i = cell + '"', i + 1
            elif c == '"':
                quoted = False
            else:
                cell += c
        elif c == '"' and fresh:
            quoted = True
        elif c in ",\n":
            row.append(cell)
            cell = ""
            if c == "\n":
                rows.append(row)
                row = []
        else:
            cell += c
        fresh = not quoted and c in ",\n"
        i += 1
    return [r for r in rows if r != [""]]


@pytest.mark.parametrize("width", [16, 100, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_in_splits(spark, tmp_path, width, end):
    text = "\n".join(CSV_LINES + ["13,last,row"]) + "\n"
    for i in range(2):
        (tmp_path / f"part-{i}.csv").write_text(text.replace("\n", end) if i else text, encoding="utf-8", newline="")
    want = []
    for e in ("\n", end):
        for row in csv_cells(text)[1:]:
            cells = [c.replace("\n", e) for c in [*row, "", ""][:3]]
            want.append(tuple(None if c in readers.MISSING_WORDS else c for c in cells))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(width))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        out = readers.read_csv(spark, str(tmp_path), "a string, b string, `c \"d\" e` string")
        got = sorted((tuple(r) for r in out.collect()), key=repr)
        tasks = records.records(spark, str(tmp_path)).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    plain = [tuple("closed early" if x == '"closed" early' else x for x in r) for r in got]  # such a cell keeps its quotes
    assert sorted(plain, key=repr) == sorted(want, key=repr)
    assert width > 1000 or tasks > 8


@pytest.mark.parametrize("line, inside, after", [
    ("a,b", False, False), ("a,b", True, True), ('"a', False, True), ('a"', True, False), ('a""b', True, True), ('a""",x', True, False),
    ('5" pipe', False, False), ('x,"y""z', False, True), ('x,"y"""', False, False), ('","', False, False), ('","', True, True), ('"",""', False, False),
    ("", False, False), ("", True, True), ('"x" y "z,"w', False, True),
])
def test_line_ends(line, inside, after):
    assert records.ends_inside(line, inside) is after


def test_stored_table_rewrites_its_own_partitions(spark, tmp_path):
    schema = spark.createDataFrame([], "model string, test_name string, drop double").schema
    store = stored.StoredTable(spark, str(tmp_path / "t"), schema, ["model", "test_name"])
    store.put(spark.createDataFrame([("1", "Corruption (5%, zero)", 1.0), ("b", "x/y", 2.0), (None, "x/y", 3.0)], schema))
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    store.put(spark.createDataFrame([("b", "x/y", 9.0), ("b", "new", 4.0)], schema))
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    rows = {tuple(r) for r in store.read().collect()}
    assert rows == {("1", "Corruption (5%, zero)", 1.0), ("b", "x/y", 9.0), (None, "x/y", 3.0), ("b", "new", 4.0)}
    assert len(set(before.items()) & set(after.items())) == 2


def test_document_in_part_files_is_one_json(spark, tmp_path):
    section = spark.createDataFrame([("a", 1.5, None), ("b", None, 'q"\n'), ("a", 1.5, None)], "Model string, F1 double, Note string").repartition(3)
    sections = {"performance": section, "robustness": section.limit(0), "reliability": section.limit(1)}
    one = spark.createDataFrame([("a", 2)], "best string, n int")
    sinks.write_document(one, sections, str(tmp_path / "doc"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "doc").glob("part-*")))
    found = json.loads(text)
    assert found["summary"] == {"best": "a", "n": 2} and found["robustness"] == [] and len(found["reliability"]) == 1
    assert sorted(str(r) for r in found["performance"]) == sorted(str(r.asDict()) for r in section.collect())
    sinks.write_document(one, {}, str(tmp_path / "none"))
    assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "none").glob("part-*")))) == {"summary": {"best": "a", "n": 2}}
