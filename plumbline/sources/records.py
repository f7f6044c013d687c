"""Records of CSV files that are read in splits although a quoted cell may hold line breaks.

A line without its surroundings doesn't say whether it begins inside a quoted cell. So a first pass works out for each split
how it would end if it began outside such a cell and how if inside; a window over these few rows, one per split, then tells how
each split really begins, and the second pass cuts the lines into records. Only the pieces of records that cross from one split
into the next are brought together in a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import settle, ship

QUOTE, COMMA = '"', ","
#: Splits up to which the table of them is broadcast (about 100 bytes each).
FEW_SPLITS = 200_000

_SPLIT = ["file", "block"]
_ENDS = "file string, block long, out0 int, out1 int, closes boolean"
_PIECES = "file string, block long, owner long, header boolean, record string"


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line that begins inside a quoted cell, or outside, ends inside one.

    A cell is quoted if it begins with a quote; in it two quotes are one, and one alone ends it. What follows up to the next
    comma belongs to the cell, and quotes elsewhere are ordinary characters.
    """
    at = 0
    while True:
        if inside:
            at = line.find(QUOTE, at)
            while at >= 0 and line.startswith(QUOTE, at + 1):
                at = line.find(QUOTE, at + 2)
            if at < 0:
                return True
        elif line.startswith(QUOTE, at):
            inside, at = True, at + 1
            continue
        at = line.find(COMMA, at)
        if at < 0:
            return False
        inside, at = False, at + 1


def _split_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, state = None, [False, True, False]

    def row() -> pa.RecordBatch:
        values = [*now, int(state[0]), int(state[1]), state[2]]
        types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], ["file", "block", "out0", "out1", "closes"])

    for batch in batches:
        for file, block, line in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, block) != now:
                if now is not None:
                    yield row()
                now, state = (file, block), [False, True, False]
            if line:
                state[0], state[1] = ends_inside(line, state[0]), ends_inside(line, state[1])
            state[2] |= not state[1]
    if now is not None:
        yield row()


def splits(lines: DataFrame) -> DataFrame:
    """(file, block, inside, start, tail): whether a split begins in a quoted cell, the last split before in which a record
    began that was open at its end, and whether such a record begins here."""
    quoted = lines.select(*_SPLIT, F.expr(f"CASE WHEN instr(value, '{QUOTE}') > 0 THEN value ELSE '' END").alias("line"))
    ends = quoted.mapInArrow(_split_ends, _ENDS)
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # a split either ends alike whatever comes before it, or passes that on, or turns it round
    flips = ends.withColumn("flip", F.expr("CASE WHEN out0 = 1 AND out1 = 0 THEN 1 ELSE 0 END"))
    flips = flips.withColumn("flips", F.sum("flip").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    fixed = F.last(F.expr("CASE WHEN out0 = out1 THEN struct(out0 AS value, flips) END"), ignorenulls=True).over(before)
    known = flips.withColumn("fixed", fixed).withColumn("turns", F.coalesce(F.sum("flip").over(before), F.lit(0)))
    begun = known.withColumn("inside", F.expr("(coalesce(fixed.value, 0) + turns - coalesce(fixed.flips, 0)) % 2 = 1"))
    tail = begun.withColumn("tail", F.expr("CASE WHEN inside THEN out1 = 1 AND closes ELSE out0 = 1 END"))
    start = F.last(F.expr("CASE WHEN tail THEN block END"), ignorenulls=True).over(before)
    return tail.select(*_SPLIT, "inside", start.alias("start"), "tail")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records that lie within their split (owner null), and the pieces of the others with the split that owns them."""
    now = owner = None
    held: list[str] = []
    inside = begun = False

    for batch in batches:
        out: list[tuple] = []
        for file, block, was_inside, start, line in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, block) != now:
                if held:  # the end of the split before: the record goes on in a later one
                    out.append((*now, now[1] if owner is None else owner, now[1] == 0 and owner is None and not begun, "\n".join(held)))
                now, held, begun = (file, block), [], False
                inside, owner = was_inside, start if was_inside else None
            held.append(line)
            inside = ends_inside(line, inside) if QUOTE in line else inside
            if not inside:
                record = "\n".join(held)
                if owner is not None or record.strip("\r"):
                    out.append((file, block, owner, block == 0 and owner is None and not begun, record))
                    begun |= owner is None
                held, owner = [], None
        if out:
            yield _batch(out)
    if held:
        yield _batch([(*now, now[1] if owner is None else owner, now[1] == 0 and owner is None and not begun, "\n".join(held))])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["file", "block", "owner", "header", "record"])


def records(spark: SparkSession, path: str) -> DataFrame:
    """(record) of headed CSV files, without the headers and empty lines. A record ends at a line feed outside quoted cells."""
    ship(spark)
    text = spark.read.option("lineSep", "\n").text(path)
    lines = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    known = settle(splits(lines))
    shape = known.agg(F.count(F.lit(1)).alias("n"), F.bool_or("tail").alias("crosses")).first()
    if shape["n"] <= FEW_SPLITS:
        placed = lines.join(F.broadcast(known), _SPLIT)  # streams the lines in their order
    else:
        numbered = lines.withColumn("at", F.monotonically_increasing_id())
        placed = numbered.join(known, _SPLIT).repartition(*_SPLIT).sortWithinPartitions(*_SPLIT, "at")
    cut = placed.select(*_SPLIT, "inside", "start", "value").mapInArrow(_pieces, _PIECES)
    whole = cut.where("owner IS NULL AND NOT header").select("record")
    if not shape["crosses"]:
        return whole
    pieces = placed.where("inside OR tail").select(*_SPLIT, "inside", "start", "value").mapInArrow(_pieces, _PIECES).where("owner IS NOT NULL")
    parts = pieces.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("block", "record"))).alias("parts"), F.bool_or("header").alias("header"))
    joined = parts.where("NOT header").select(F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"))
    return whole.unionByName(joined)
