"""Models taken apart score and weigh features as Spark ML does."""

import numpy as np
import pytest

from plumbline.operators import compiled, models


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(240, 4))
    rows = [(i, "train", int(v[0] > 0) + int(v[1] > 0.5), *map(float, np.round(v, 1))) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "row_id long, split string, y int, a double, b double, `c d` double, e double").repartition(3).cache()


NAMES = ["a", "b", "c d", "e"]
CASES = [
    (models.LOGISTIC, 3, {}), (models.LOGISTIC, 2, {}), (models.FOREST, 3, {"n_estimators": 15}),
    (models.BOOSTED, 2, {"n_estimators": 8}), (models.BOOSTED, 3, {"n_estimators": 4}),
]


@pytest.mark.parametrize("kind, classes, params", CASES)
def test_same_scores_and_importances(spark, table, kind, classes, params):
    df = table.selectExpr("row_id", "split", f"least(y, {classes - 1}) AS y", *[f"`{c}`" for c in NAMES])
    model = models.fit(kind, df, NAMES, **params)
    a = model.attach(df, NAMES, "p").select("row_id", "p").toPandas().sort_values("row_id")
    b = compiled.Compiled(spark, model).attach(df, NAMES, "p").select("row_id", "p").toPandas().sort_values("row_id")
    pa, pb = np.vstack(a.p), np.vstack(b.p)
    assert pa.shape == (240, classes) and np.allclose(pa, pb, atol=1e-9) and (pa.argmax(1) == pb.argmax(1)).all()
    if kind == models.LOGISTIC:
        with pytest.raises(ValueError):
            compiled.node_table(spark, model)
        return
    nodes = compiled.node_table(spark, model)
    got = {r["feature"]: r["importance"] for r in compiled.importances(nodes, NAMES, kind == models.FOREST).collect()}
    assert got == pytest.approx(dict(model.importance()), abs=1e-9)


def test_features_without_values_fail(spark, table):
    model = models.fit(models.LOGISTIC, table, NAMES)
    with pytest.raises(Exception, match="without values"):
        compiled.Compiled(spark, model).attach(table.selectExpr("a", "b", "`c d`", "cast(null AS double) AS e"), NAMES, "p").collect()
