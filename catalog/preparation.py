"""Encoding, splitting and scaling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import features
from plumbline.plans.prepare import prepare

from . import fixtures as fx
from .base import big, digest, num, ordering, query, r6, table, tidy

CUSTOMERS_SQL = """cust AS (SELECT c_custkey, c_acctbal,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_mktsegment END AS segment, c_name FROM customer)"""


def customers(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey",
        "c_acctbal",
        F.expr("CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_mktsegment END AS segment"),
        "c_name",
    )


BOOK = "SELECT category, row_number() OVER (ORDER BY category) - 1 AS code FROM (SELECT DISTINCT coalesce({c}, 'nan') AS category FROM cust)"


@query(
    "f1_label_encode",
    f"""WITH {CUSTOMERS_SQL}, seg AS ({BOOK.format(c='segment')}), nam AS ({BOOK.format(c='c_name')})
    SELECT c_custkey, {r6('c_acctbal')} AS c_acctbal, {big('seg.code')} AS segment, {big('nam.code')} AS c_name FROM cust
    JOIN seg ON seg.category = coalesce(segment, 'nan') JOIN nam ON nam.category = c_name""",
)
def f1(spark, sf):
    encoded, _ = features.label_encode(customers(spark, sf), ["segment", "c_name", "c_acctbal"])
    return tidy(encoded)


@query(
    "f1_label_mapping",
    f"""WITH {CUSTOMERS_SQL} SELECT 'segment' AS "column", category, {big('code')} AS code FROM ({BOOK.format(c='segment')})""",
)
def f1_mapping(spark, sf):
    _, mapping = features.label_encode(customers(spark, sf), ["segment"])
    return tidy(mapping)


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    "f2_one_hot",
    f"""WITH {CUSTOMERS_SQL} SELECT c_custkey, c_name, {r6('c_acctbal')} AS c_acctbal, """
    + ", ".join(f"coalesce(segment = '{s}', false) AS \"segment_{s}\"" for s in SEGMENTS[1:])
    + " FROM cust",
)
def f2(spark, sf):
    return tidy(features.one_hot(customers(spark, sf), ["segment"]))


def split_ctes(table_sql: str, target: str, key: str, test: float = 0.2, val: float = 0.1) -> str:
    """CTEs ending in ``parted``: the exact stratified split, ranked by keyed draw within a class."""
    draw = ordering(digest(fx.SEED, "'split'", f"'{target}'", key))

    def shared(source: str, count: str, draws: str, out: str) -> str:
        return f"""SELECT *, floor(x) + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, {target}) <= {draws} - sum(floor(x)) OVER ()
            THEN 1 ELSE 0 END AS {out} FROM (SELECT *, {draws} * {count} / (sum({count}) OVER ())::DOUBLE AS x FROM {source})"""

    return f"""cls AS (SELECT {target}, count(*)::DOUBLE AS n_c, (sum(count(*)) OVER ())::DOUBLE AS n FROM {table_sql} GROUP BY {target}),
szs AS (SELECT *, ceil(n * {num(test)}) AS n_test, ceil((n - ceil(n * {num(test)})) * ({num(val)} / (1.0::DOUBLE - {num(test)}))) AS n_val FROM cls),
lefts AS ({shared('szs', 'n_c', '(n - n_test)', 'left_c')}),
trains AS ({shared('(SELECT * EXCLUDE (x) FROM lefts)', 'left_c', '(n - n_test - n_val)', 'train_c')}),
parted AS (SELECT t.*, CASE WHEN rk <= n_c - left_c THEN 'test' WHEN rk <= n_c - train_c THEN 'validation' ELSE 'train' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY {target} ORDER BY {draw}, {key}) AS rk FROM {table_sql}) t
  JOIN trains USING ({target}))"""


ORDER_SPLIT = split_ctes("orders", "o_orderstatus", "o_orderkey")


@query(
    "f4_split_stratified",
    f"WITH {ORDER_SPLIT} SELECT o_orderkey, o_orderstatus, split FROM parted",
)
def f4(spark, sf):
    parted = features.split(table(spark, sf, "orders"), "o_orderstatus", "o_orderkey", seed=fx.SEED)
    return parted.select("o_orderkey", "o_orderstatus", "split")


PLAIN_DRAW = ordering(digest(fx.SEED, "'split'", "'p_brand'", "p_partkey"))


@query(
    "f4_split_plain",
    f"""WITH szs AS (SELECT count(*)::DOUBLE AS n, ceil(count(*) * 0.2::DOUBLE) AS n_test FROM part),
    rk AS (SELECT p_partkey, p_brand, row_number() OVER (ORDER BY {PLAIN_DRAW}, p_partkey) AS rk FROM part)
    SELECT p_partkey, p_brand, CASE WHEN rk <= n_test THEN 'test'
    WHEN rk <= n_test + ceil((n - n_test) * (0.1::DOUBLE / (1.0::DOUBLE - 0.2::DOUBLE))) THEN 'validation' ELSE 'train' END AS split
    FROM rk CROSS JOIN szs""",
)
def f4_plain(spark, sf):
    """25 brands, so the split is not stratified."""
    parted = features.split(table(spark, sf, "part"), "p_brand", "p_partkey", seed=fx.SEED)
    return parted.select("p_partkey", "p_brand", "split")


SUMMARY = f"""SELECT split, {{t}} AS class, {big('class_count')} AS class_count, {big('sum(class_count) OVER (PARTITION BY split)')} AS samples,
  {r6('sum(class_count) OVER (PARTITION BY split) * 100e0 / sum(class_count) OVER ()')} AS percentage
  FROM (SELECT split, {{t}}, count(*) AS class_count FROM parted GROUP BY ALL)"""


@query("f5_split_summary", f"WITH {ORDER_SPLIT} {SUMMARY.format(t='o_orderstatus')}")
def f5(spark, sf):
    parted = features.split(table(spark, sf, "orders"), "o_orderstatus", "o_orderkey", seed=fx.SEED)
    return tidy(features.split_summary(parted, "o_orderstatus"))


def scaled_sql(source: str, key: str, extra: str = "") -> str:
    stats = ", ".join(
        f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1e0 ELSE stddev_pop({c}) END AS s_{c}" for c in fx.FEATURES
    )
    cols = ", ".join(f"{r6(f'({c} - m_{c}) / s_{c}')} AS {c}" for c in fx.FEATURES)
    return f"""sc AS (SELECT {stats} FROM {source} WHERE split = 'train')
    SELECT {key}, split{extra}, {cols} FROM {source} CROSS JOIN sc"""


@query("f6_scale_features", f"WITH {fx.SQL_FEATURES}, {scaled_sql('feat', 'row_id')}")
def f6(spark, sf):
    scaled = features.scale(fx.features(spark, sf), fx.FEATURES)
    return tidy(scaled.select("row_id", "split", *fx.FEATURES))


RAW_SQL = f"{fx.SQL_FEATURES}, raw AS (SELECT row_id, y, x_1, x_2, x_3 FROM feat), {split_ctes('raw', 'y', 'row_id')}"


@query("f7_prepare", f"WITH {RAW_SQL}, {scaled_sql('parted', 'row_id')}")
def f7(spark, sf):
    raw = fx.features(spark, sf).drop("split")
    ready = prepare(raw, "y", "row_id", fx.FEATURES, seed=fx.SEED)
    return tidy(ready.select("row_id", "split", *fx.FEATURES))
