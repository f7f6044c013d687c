"""Export frames and writers. Writers produce a folder of part files, one per task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle

# Column order and headings of the stress export.
STRESS_COLUMNS = {
    "model": "Model",
    "split": "Dataset",
    "test_name": "Stress_Test",
    "accuracy_original": "Accuracy_Original",
    "accuracy_stressed": "Accuracy_Stressed",
    "performance_drop": "Performance_Drop",
    "performance_drop_pct": "Performance_Drop_Pct",
    "precision_stressed": "Precision_Stressed",
    "recall_stressed": "Recall_Stressed",
    "f1_stressed": "F1_Stressed",
    "prediction_agreement": "Prediction_Agreement",
}

# Report sections in export order.
SECTIONS = ("performance", "robustness", "calibration", "reliability")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Headed CSV; a quote inside a cell is doubled, and cells keep their outer white space."""
    df.write.mode(mode).options(
        header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_lines(df: DataFrame, text_column: str, order_by: Sequence[str], path: str) -> None:
    """Ordered text, such as the models' recommendations: part files in order, a single one while the text is short."""
    df.orderBy(*order_by).select(text_column).write.mode("overwrite").text(path)


def stress_export(result: DataFrame) -> DataFrame:
    return result.select(*[F.col(c).alias(h) for c, h in STRESS_COLUMNS.items()])


def predictions_export(frame: DataFrame) -> DataFrame:
    """Confidence frame under its export headings."""
    return frame.select(
        F.col("true_label").alias("True_Label"),
        F.col("predicted_label").alias("Predicted_Label"),
        F.col("confidence").alias("Confidence"),
        F.col("correct").alias("Correct"),
    )


def write_predictions(frame: DataFrame, path: str) -> None:
    write_csv(predictions_export(frame), path)


def write_stress(result: DataFrame, path: str) -> None:
    write_csv(stress_export(result), path)


def all_sections(sections: Mapping[str, DataFrame]) -> DataFrame | None:
    """Every section under one another with a leading ``Section`` column; absent columns are null."""
    combined = None
    for name in SECTIONS:
        if name not in sections:
            continue
        part = sections[name].select(F.lit(name.capitalize()).alias("Section"), "*")
        combined = part if combined is None else combined.unionByName(part, allowMissingColumns=True)
    return combined


def write_sections(sections: Mapping[str, DataFrame], folder: str) -> None:
    """One CSV folder per section plus ``all`` with everything."""
    for name in SECTIONS:
        if name in sections:
            write_csv(sections[name], f"{folder}/{name}")
    combined = all_sections(sections)
    if combined is not None:
        write_csv(combined, f"{folder}/all")


def document_lines(summary_row: DataFrame, sections: Mapping[str, DataFrame]) -> DataFrame:
    """The report as JSON, a line per row: (place, line) in the order of ``place``.

    No section is gathered into one value: what tells a section's first line from the others is the least of its lines.
    """
    order = "place struct<section:int, part:int, text:string, copy:bigint>"
    spark = summary_row.sparkSession
    parts = [summary_row.select(F.lit(0).alias("section"), _as_json().alias("text"))]
    parts += [sections[name].select(F.lit(i + 1).alias("section"), _as_json().alias("text")) for i, name in enumerate(sections)]
    rows = reduce(DataFrame.unionByName, parts)
    kept = settle(rows.withColumn("copy", F.monotonically_increasing_id()))
    first = kept.groupBy("section").agg(F.min(F.struct("text", "copy")).alias("first"))
    place = F.struct("section", F.lit(1).alias("part"), "text", "copy").alias("place")
    comma = F.when(F.struct("text", "copy") == F.col("first"), F.lit("")).otherwise(F.lit(","))
    body = kept.join(first, "section").select(place, F.concat(comma, "text").alias("line"))
    heads = [((0, 0, "", 0), '{"summary":')]
    heads += [((i + 1, 0, "", 0), f'],"{name}":[' if i else f',"{name}":[') for i, name in enumerate(sections)]
    heads.append(((len(sections) + 1, 0, "", 0), "]}" if sections else "}"))
    return body.unionByName(spark.createDataFrame(heads, f"{order}, line string"))


def _as_json():
    return F.to_json(F.struct("*"), {"ignoreNullFields": "false"})


def write_document(summary_row: DataFrame, sections: Mapping[str, DataFrame], path: str) -> None:
    """The report as one JSON document in ordered part files: read one after the other they are the document."""
    document_lines(summary_row, sections).orderBy("place").select("line").write.mode("overwrite").text(path)
