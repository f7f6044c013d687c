"""Documents to packed training sequences: five stages, each written and read again before the next."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, lines, neardup, packing, quality
from plumbline.llm.frames import small_batches, table, written
from plumbline.llm.queries import vocabulary
from plumbline.session import ship


def stage(fn: Callable[[SparkSession, DataFrame, str], DataFrame]):
    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        small_batches(spark)
        return fn(spark, docs, sf_dir)

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and have enough content lines. Null and empty texts fail; null ids pass as others."""
    field = quality.train(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    rows = rows.select("_row", quality.measured(F.col("_row.text"), field).alias("_m"))
    return rows.where(quality.verdict("_m")).select(*_columns(docs))


@stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a later document repeats; ``n_chars`` follows the text. Null texts stay null."""
    kept = lines.without_repeats(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id. Of rows that repeat an id, one stays; rows with a
    null id and documents without words stay."""
    gone = neardup.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    kept = docs.join(gone.hint("shuffle_hash"), F.col("doc_id") == F.col("_gone"), "left_anti")
    ids = written(docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).count().where("count > 1").select("_id"))
    if ids.isEmpty():
        return kept
    once = kept.join(ids, F.col("doc_id") == F.col("_id"), "left_anti")
    again = kept.join(ids, F.col("doc_id") == F.col("_id"), "left_semi")
    return once.unionByName(again.dropDuplicates(["doc_id"]))


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words is in passages of the benchmark. Null and empty texts stay."""
    blocks = decontaminate.item_blocks(table(spark, sf_dir, "benchmark"), "item_id", "text")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    rows = rows.select("_row", decontaminate.benchmark_hits(F.col("_row.text"), blocks).alias("_h"))
    clean = ~decontaminate.contaminated(F.col("_h.n_hit"), F.col("_h.n_words"))
    return rows.where(clean).select(*_columns(docs))


@stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), end_id=2, limit=1024)


def _columns(docs: DataFrame) -> list:
    return [F.col(f"_row.`{c}`").alias(c) for c in docs.columns]


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-duplicate removal", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]
ORACLE_SQL = None  # the sequence labelling and the packing have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, one in STAGES[:-1]:
        docs = written(one(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
