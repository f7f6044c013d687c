"""Report section and export queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators import reliability, report
from plumbline.operators.stress import DEFAULT_SUITE
from plumbline.plans import scorecard
from plumbline.session import held, shared_folder
from plumbline.sources import sinks

from . import expected
from . import fixtures as fx
from .base import big, query, r6, text, tidy
from .reliability import SCORES

PERF = """sec_perf AS (SELECT model AS "Model", accuracy AS "Accuracy", precision AS "Precision", recall AS "Recall", f1 AS "F1" FROM perf WHERE has_data)"""
ROB = """sec_rob AS (SELECT model AS "Model", test_name AS "Stress Type", round(accuracy_original, 4) AS "Orig Acc",
  round(accuracy_stressed, 4) AS "Stress Acc", round(performance_drop, 4) AS "Drop", round(performance_drop_pct, 2) AS "Drop %" FROM stress_results)"""
CAL = f"""sec_cal AS (SELECT model AS "Model", round(ece, 4) AS "ECE", {expected.quality('ece')} AS "Quality" FROM cert)"""
REL = """sec_rel AS (SELECT model AS "Model", total AS "Total", grade AS "Grade", performance AS "Performance",
  calibration AS "Calibration", robustness AS "Robustness", confidence AS "Confidence" FROM sc)"""
ALL = f"WITH {SCORES}, {PERF}, {ROB}, {CAL}, {REL}"


def cells(spark, sf):
    return held(scorecard.evidence_cells(fx.predictions(spark, sf), fx.K))


def everything(spark, sf):
    counted, results = cells(spark, sf), fx.stored_results(spark, sf)
    models = fx.models(spark)
    scores = reliability.score(scorecard.evidence(models, counted, results))
    return models, scorecard.sections(models, counted, results, scores)


def shown(columns, numbers):
    return ", ".join(f'{r6(chr(34) + c + chr(34))} AS "{c}"' if c in numbers else f'"{c}"' for c in columns)


PERF_COLS = ["Model", "Accuracy", "Precision", "Recall", "F1"]
ROB_COLS = ["Model", "Stress Type", "Orig Acc", "Stress Acc", "Drop", "Drop %"]
REL_COLS = ["Model", "Total", "Grade", "Performance", "Calibration", "Robustness", "Confidence"]


@query("x1_performance_section", f"{ALL} SELECT {shown(PERF_COLS, PERF_COLS[1:])} FROM sec_perf")
def x1(spark, sf):
    return tidy(report.performance(fx.models(spark), scorecard.metrics(cells(spark, sf))))


@query("x2_robustness_section", f"{ALL} SELECT {shown(ROB_COLS, ROB_COLS[2:])} FROM sec_rob")
def x2(spark, sf):
    return tidy(report.robustness(fx.models(spark), fx.stored_results(spark, sf)))


@query("x3_calibration_section", f"""{ALL} SELECT "Model", {r6('"ECE"')} AS "ECE", "Quality" FROM sec_cal""")
def x3(spark, sf):
    return tidy(report.calibration(fx.models(spark), scorecard.certainty(cells(spark, sf))))


@query("x4_reliability_section", f"{ALL} SELECT {shown(REL_COLS, ['Total', *REL_COLS[3:]])} FROM sec_rel")
def x4(spark, sf):
    return tidy(everything(spark, sf)[1]["reliability"])


SUMMARY = f"""(SELECT sec_perf."Model" FROM sec_perf JOIN trained ON trained.model = sec_perf."Model" ORDER BY "F1" DESC, model_seq LIMIT 1) AS best_performance,
    (SELECT sec_rel."Model" FROM sec_rel JOIN trained ON trained.model = sec_rel."Model" ORDER BY "Total" DESC, model_seq LIMIT 1) AS best_reliability,
    (SELECT sec_rob."Model" FROM sec_rob JOIN trained ON trained.model = sec_rob."Model" GROUP BY sec_rob."Model", model_seq ORDER BY avg("Drop"), model_seq LIMIT 1) AS most_robust,
    {big('(SELECT count(*) FROM trained)')} AS num_models, {big('(SELECT count(DISTINCT "Model") FROM sec_rob)')} AS num_stressed,
    {big('(SELECT count(*) FROM sec_cal)')} AS num_calibrated"""


@query("x5_summary", f"{ALL} SELECT {SUMMARY}")
def x5(spark, sf):
    models, sections = everything(spark, sf)
    return tidy(report.summary(models, sections))


TESTS = [t.title for t in DEFAULT_SUITE]


@query(
    "x6_robustness_heatmap",
    f'{ALL} SELECT "Model", '
    + ", ".join(f"""{r6(f'max(CASE WHEN "Stress Type" = {text(t)} THEN "Drop" END)')} AS "{t}" """ for t in TESTS)
    + ' FROM sec_rob GROUP BY "Model"',
)
def x6(spark, sf):
    return tidy(report.heatmap(report.robustness(fx.models(spark), fx.stored_results(spark, sf)), TESTS))


@query(
    "x7_performance_series",
    f"{ALL} " + " UNION ALL ".join(f"""SELECT "Model", '{c}' AS metric, {r6(f'"{c}"')} AS value FROM sec_perf""" for c in PERF_COLS[1:]),
)
def x7_performance(spark, sf):
    section = report.performance(fx.models(spark), scorecard.metrics(cells(spark, sf)))
    return tidy(report.performance_series(section))


@query("x7_calibration_series", f"""{ALL} SELECT "Model", {r6('"ECE"')} AS "ECE", "Quality" FROM sec_cal""")
def x7_calibration(spark, sf):
    section = report.calibration(fx.models(spark), scorecard.certainty(cells(spark, sf)))
    return tidy(report.calibration_series(section))


@query(
    "x7_reliability_series",
    f"{ALL} "
    + " UNION ALL ".join(
        f"""SELECT "Model", {r6('"Total"')} AS "Total", "Grade", '{c}' AS component, {r6(f'"{c}" / 25e0')} AS share FROM sec_rel"""
        for c in REL_COLS[3:]
    ),
)
def x7_reliability(spark, sf):
    return tidy(report.reliability_series(everything(spark, sf)[1]["reliability"]))


COLUMNS = ["Section", *PERF_COLS, *ROB_COLS[1:], "ECE", "Quality", "Total", "Grade", *REL_COLS[3:]]
NUMBERS = {*PERF_COLS[1:], *ROB_COLS[2:], "ECE", "Total", *REL_COLS[3:]}


def _section_sql(label: str, source: str, columns: list[str]) -> str:
    cells_sql = []
    for c in COLUMNS:
        if c == "Section":
            cells_sql.append(f"'{label}' AS \"Section\"")
        elif c in columns:
            cells_sql.append((r6(f'"{c}"') if c in NUMBERS else f'"{c}"') + f' AS "{c}"')
        else:
            cells_sql.append(f'NULL AS "{c}"')
    return f"SELECT {', '.join(cells_sql)} FROM {source}"


ALL_SECTIONS = f"{ALL} " + " UNION ALL ".join(
    [
        _section_sql("Performance", "sec_perf", PERF_COLS),
        _section_sql("Robustness", "sec_rob", ROB_COLS),
        _section_sql("Calibration", "sec_cal", ["Model", "ECE", "Quality"]),
        _section_sql("Reliability", "sec_rel", REL_COLS),
    ]
)


@query("s13_export_all_sections", ALL_SECTIONS)
def s13(spark, sf):
    return tidy(sinks.all_sections(everything(spark, sf)[1]))


def compiled(spark, sf):
    return scorecard.compile_report(fx.models(spark), fx.predictions(spark, sf), fx.stored_results(spark, sf), n_classes=fx.K)


@query("x8_report_sections", ALL_SECTIONS)
def x8_sections(spark, sf):
    """The sections of the assembled report."""
    return tidy(sinks.all_sections(compiled(spark, sf)["sections"]))


@query("x8_report_summary", f"{ALL} SELECT 'Test' AS dataset_name, true AS stamped, {SUMMARY}")
def x8_summary(spark, sf):
    """The summary of the assembled report; the time of its making only has to be there."""
    found = compiled(spark, sf)["summary"]
    return tidy(found.withColumn("stamped", F.col("generated_at").isNotNull()).drop("generated_at"))


def read_document(spark, path, sections):
    """{name: rows} of the written report: its lines in their order, parsed as one document."""
    kinds = {name: section.schema for name, section in sections.items()}
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), "value")
    whole = lines.agg(F.array_sort(F.collect_list(F.struct("file", "at", "value"))).alias("l"))
    schema = T.StructType([T.StructField(name, T.ArrayType(kind)) for name, kind in kinds.items()])
    text_ = F.array_join(F.transform("l", lambda x: x["value"]), "")
    return whole.select(F.from_json(text_, schema).alias("d")), list(kinds)


@query("s11_report_document", ALL_SECTIONS)
def s11_document(spark, sf):
    """The report written as a JSON document, and its sections read back from that."""
    models, sections = everything(spark, sf)
    path = f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    sinks.write_document(report.summary(models, sections), sections, path)
    document, names = read_document(spark, path, sections)
    return tidy(sinks.all_sections({n: document.select(F.inline(f"d.{n}")) for n in names}))


@query("s11_report_json")
def s11(spark, sf):
    """Rows-only: one nested JSON document."""
    models, sections = everything(spark, sf)
    return report.as_document(report.summary(models, sections), sections).select(F.length("report").alias("size"), "report")
