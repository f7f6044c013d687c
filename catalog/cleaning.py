"""Cleaning queries over events with derived missing values."""

from __future__ import annotations

from plumbline.operators import clean

from .base import query, r6, tidy
from .profiling import DUPS_SQL, EVENTS_SQL, events_dups, events_missing

SHOWN = f"event_id, user_id, event_type_n, {r6('value_n')} AS value_n"


def shown(df):
    return tidy(df.select("event_id", "user_id", "event_type_n", "value_n"))


def filled(value: str = "value_n", event_type: str = "event_type_n", where: str = "") -> str:
    return f"""WITH {EVENTS_SQL} SELECT event_id, user_id, {event_type} AS event_type_n, {r6(value)} AS value_n
    FROM events_missing {where}"""


@query(
    "c1_drop_duplicates",
    f"WITH {DUPS_SQL} SELECT DISTINCT user_id, event_type_n, {r6('value_n')} AS value_n, props FROM events_dups",
)
def c1(spark, sf):
    return tidy(clean.drop_duplicates(events_dups(spark, sf)))


@query(
    "c1_drop_duplicates_keep_first",
    f"""WITH {EVENTS_SQL} SELECT min(event_id) AS event_id, user_id, event_type_n FROM events_missing GROUP BY user_id, event_type_n""",
)
def c1_first(spark, sf):
    rows = events_missing(spark, sf).select("event_id", "user_id", "event_type_n")
    return tidy(clean.drop_duplicates(rows, key="event_id"))


@query(
    "c2_fill_in_order",
    f"""WITH {EVENTS_SQL}, kept AS (SELECT * FROM events_missing WHERE event_type_n IS NOT NULL)
    SELECT event_id, user_id, event_type_n, {r6('coalesce(value_n, (SELECT avg(value_n) FROM kept))')} AS value_n FROM kept""",
)
def c2(spark, sf):
    """The drop comes first, so the mean is that of the remaining rows."""
    return shown(clean.fill(events_missing(spark, sf), {"event_type_n": "drop", "absent": "mean", "value_n": "mean"}))


@query("c3_mean", filled("coalesce(value_n, (SELECT avg(value_n) FROM events_missing))"))
def c3(spark, sf):
    return shown(clean.fill(events_missing(spark, sf), {"value_n": "mean"}))


@query("c4_median", filled("coalesce(value_n, (SELECT quantile_cont(value_n, 0.5) FROM events_missing))"))
def c4(spark, sf):
    return shown(clean.fill(events_missing(spark, sf), {"value_n": "median"}))


@query(
    "c5_mode",
    filled(
        event_type="""coalesce(event_type_n, (SELECT event_type_n FROM events_missing WHERE event_type_n IS NOT NULL
        GROUP BY event_type_n ORDER BY count(*) DESC, event_type_n LIMIT 1))"""
    ),
)
def c5(spark, sf):
    return shown(clean.fill(events_missing(spark, sf), {"event_type_n": "mode"}))


@query("c6_drop", filled(where="WHERE value_n IS NOT NULL"))
def c6(spark, sf):
    return shown(clean.fill(events_missing(spark, sf), {"value_n": "drop"}))


BACK = "OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
AHEAD = "OVER (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query(
    "c7_forward_fill",
    filled(f"last_value(value_n IGNORE NULLS) {BACK}", f"last_value(event_type_n IGNORE NULLS) {BACK}"),
)
def c7(spark, sf):
    moves = {"value_n": "forward_fill", "event_type_n": "forward_fill"}
    return shown(clean.fill(events_missing(spark, sf), moves, order_by=["ts", "event_id"]))


@query(
    "c8_backward_fill",
    filled(f"first_value(value_n IGNORE NULLS) {AHEAD}", f"first_value(event_type_n IGNORE NULLS) {AHEAD}"),
)
def c8(spark, sf):
    moves = {"value_n": "backward_fill", "event_type_n": "backward_fill"}
    return shown(clean.fill(events_missing(spark, sf), moves, order_by=["ts", "event_id"]))


@query("c9_custom_value", filled("coalesce(value_n, -1)", "coalesce(event_type_n, 'unknown')"))
def c9(spark, sf):
    return shown(clean.fill(events_missing(spark, sf), {"value_n": -1.0, "event_type_n": "unknown"}))
