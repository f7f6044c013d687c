"""Profiling queries over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import profile

from .base import big, fixed, query, r6, table, text, tidy

LINEITEM = [
    ("l_orderkey", "bigint", 8),
    ("l_partkey", "bigint", 8),
    ("l_suppkey", "bigint", 8),
    ("l_linenumber", "int", 4),
    ("l_quantity", "double", 8),
    ("l_extendedprice", "double", 8),
    ("l_discount", "double", 8),
    ("l_tax", "double", 8),
    ("l_returnflag", "string", 0),
    ("l_linestatus", "string", 0),
    ("l_shipdate", "timestamp_ntz", 8),
]
EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type_n", "value_n", "props"]
EVENTS_SQL = """events_missing AS (SELECT event_id, ts, user_id,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS event_type_n,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value_n, props FROM events)"""
DUPS_SQL = f"""{EVENTS_SQL}, events_dups AS (SELECT user_id, event_type_n, value_n, props FROM events_missing
  UNION ALL SELECT user_id, event_type_n, value_n, props FROM events_missing WHERE event_id % 50 = 0)"""


def events_missing(spark, sf):
    """Events with derived missing values; the source tables have none."""
    return table(spark, sf, "events").select(
        "event_id",
        "ts",
        "user_id",
        F.expr("CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS event_type_n"),
        F.expr("CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value_n"),
        "props",
    )


def events_dups(spark, sf):
    """Events without their unique columns, a fiftieth of them repeated."""
    base = events_missing(spark, sf)
    again = base.filter(F.col("event_id") % 50 == 0)
    return base.unionAll(again).drop("event_id", "ts")


@query(
    "p1_shape",
    f"""SELECT {big('count(*)')} AS rows, {big('11')} AS columns, {big('8')} AS numeric_columns, {big('2')} AS categorical_columns
    FROM lineitem""",
)
def p1(spark, sf):
    return tidy(profile.shape(table(spark, sf, "lineitem")))


def _missing_sql(where: str, columns: str) -> str:
    parts = [
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, (count(*) - count({c})) * 100e0 / count(*) AS pct FROM events_missing"
        for c in EVENT_COLUMNS
    ]
    return f"WITH {EVENTS_SQL}, m AS ({' UNION ALL '.join(parts)}) SELECT {columns} FROM m {where}"


@query("p2_missing_count", _missing_sql("", f'"column", {big("missing")} AS missing'))
def p2(spark, sf):
    return tidy(profile.missing(events_missing(spark, sf)).select("column", "missing"))


@query("p3_missing_pct", _missing_sql("", f'"column", {r6("pct")} AS missing_pct'))
def p3(spark, sf):
    return tidy(profile.missing(events_missing(spark, sf)).select("column", "missing_pct"))


@query(
    "p4_missing_only",
    _missing_sql("WHERE missing > 0", f'"column", {big("missing")} AS missing, {fixed("pct", 2, "%")} AS missing_pct'),
)
def p4(spark, sf):
    return tidy(profile.missing_only(events_missing(spark, sf)))


@query("p5_columns_with_missing", _missing_sql("WHERE missing > 0", '"column"'))
def p5(spark, sf):
    return profile.columns_with_missing(events_missing(spark, sf))


@query(
    "p6_duplicates",
    f"""WITH {DUPS_SQL} SELECT {big('sum(n - 1)')} AS duplicates FROM
    (SELECT count(*) AS n FROM events_dups GROUP BY user_id, event_type_n, value_n, props)""",
)
def p6(spark, sf):
    return tidy(profile.duplicates(events_dups(spark, sf)))


@query(
    "p6_duplicate_documents",
    f"""SELECT {big('sum(n - 1)')} AS duplicates FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang, source, n_chars)""",
)
def p6_documents(spark, sf):
    """Whole texts compared; only their digests are shuffled."""
    return tidy(profile.duplicates(table(spark, sf, "documents"), ["text", "lang", "source", "n_chars"]))


SIZE_SQL = " + ".join(
    f"sum(strlen({c}))" if kind == "string" else f"count(*) * {width}" for c, kind, width in LINEITEM
)


@query("p8_estimated_size", f"SELECT {r6(f'({SIZE_SQL}) / 1048576e0')} AS size_mb FROM lineitem")
def p8(spark, sf):
    return tidy(profile.size_mb(table(spark, sf, "lineitem")))


@query(
    "p9_preview",
    f"""SELECT o_orderkey, o_custkey, o_orderstatus, {r6('o_totalprice')} AS o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority
    FROM orders ORDER BY o_orderkey LIMIT 10""",
)
def p9(spark, sf):
    shown = profile.preview(table(spark, sf, "orders"), ["o_orderkey"])
    return tidy(shown.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")))


INFO_SQL = " UNION ALL ".join(
    f"""SELECT {text(c)} AS "column", {text(kind)} AS dtype, {big(f'count({c})')} AS non_null, {big(f'count(*) - count({c})')} AS null_count,
    {r6(f'round((count(*) - count({c})) * 100e0 / count(*), 2)')} AS null_pct, {big(f'count(DISTINCT {c})')} AS "distinct" FROM lineitem"""
    for c, kind, _ in LINEITEM
)


@query("p10_column_info", INFO_SQL)
def p10(spark, sf):
    return tidy(profile.column_info(table(spark, sf, "lineitem")))


@query(
    "p11_totals",
    f"""WITH {DUPS_SQL} SELECT {big('sum(n)')} AS rows, {big('4')} AS columns,
    {big('sum(n * ((user_id IS NULL)::INT + (event_type_n IS NULL)::INT + (value_n IS NULL)::INT + (props IS NULL)::INT))')} AS missing,
    {big('sum(n - 1)')} AS duplicates FROM (SELECT user_id, event_type_n, value_n, props, count(*) AS n FROM events_dups GROUP BY ALL)""",
)
def p11(spark, sf):
    return tidy(profile.totals(events_dups(spark, sf)))


DESCRIBE_SQL = " UNION ALL ".join(
    f"""SELECT {text(c)} AS "column", {big(f'count({c})')} AS "count", {r6(f'avg({c})')} AS mean, {r6(f'stddev_samp({c})')} AS std,
    {r6(f'min({c})')} AS min, {r6(f'quantile_cont({c}::DOUBLE, 0.25)')} AS p25, {r6(f'quantile_cont({c}::DOUBLE, 0.5)')} AS p50,
    {r6(f'quantile_cont({c}::DOUBLE, 0.75)')} AS p75, {r6(f'max({c})')} AS max FROM lineitem"""
    for c, kind, _ in LINEITEM
    if kind in ("bigint", "int", "double")
)


@query("p12_describe", DESCRIBE_SQL)
def p12(spark, sf):
    return tidy(profile.describe(table(spark, sf, "lineitem")))
