"""Chat formatting by quotation linking: who quotes whom, and conversations in reply order without the quotes.

A message's lines are parsed into nested quote levels. Quoted passages and the messages' own passages are normalised and
hashed; equal hashes within a conversation link a quote to the last earlier message that has the passage. Links make reply
trees; a conversation lists its trees by their first message, each in order of turns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import partitions, texts_of, written
from .graph import components

QUOTE = re.compile(r"[ \t]*((?:>[ \t]?)+)")
INTRODUCTION = re.compile(r"(?i)^.{0,200}\b(?:wrote|writes|said|schrieb|escribió|a écrit)[ \t]*:[ \t]*$")
#: Turns of one passage in one conversation that are sorted together; their last ones are sorted over all such runs.
RUN = 1024


def levels(text: str) -> list[tuple[int, str]]:
    """(quote level, line without its quote marks)."""
    out = []
    for line in text.split("\n"):
        m = QUOTE.match(line)
        out.append((m[1].count(">"), line[m.end() :]) if m else (0, line))
    return out


def normal(text: str) -> str:
    return " ".join(text.casefold().split())


def passages(lines: list[str]) -> set[int]:
    """Hashes of the whole, of its paragraphs and of its lines, without empty ones."""
    units, paragraph = {normal(" ".join(lines))}, []
    for line in [*lines, ""]:
        if line.strip():
            paragraph.append(line)
            units.add(normal(line))
        elif paragraph:
            units.add(normal(" ".join(paragraph)))
            paragraph = []
    units.discard("")
    return {xxhash.xxh3_64_intdigest(u) - (1 << 63) for u in units}


def parsed(text: str) -> tuple[str, set[int], dict[int, set[int]]]:
    """Text without quotes and their introductions; hashes of its own passages; hashes of the quoted ones by level."""
    lines = levels(text)
    own = [
        line
        for i, (level, line) in enumerate(lines)
        if not level and not (INTRODUCTION.match(line) and any(x for x, _ in lines[i + 1 : i + 3]))
    ]
    quoted: dict[int, set[int]] = {}
    run: list[str] = []
    for i, (level, line) in enumerate(lines):
        if level:
            run.append(line)
            if i + 1 == len(lines) or lines[i + 1][0] != level:
                quoted.setdefault(level, set()).update(passages(run))
                run = []
    return re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip(), passages(own), quoted


def messages(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, text without quotes, own hashes, quoted (level, hash) pairs)."""
    kinds = [df.schema[c].dataType.simpleString() for c in (conv_col, turn_col, role_col)]
    schema = "conv {}, turn {}, role {}, text string, own array<long>, quoted array<struct<level:int,passage:long>>".format(*kinds)
    pair = pa.struct([("level", pa.int32()), ("passage", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parsed(t) for t in texts_of(batch.column(3))]
            quoted = [[{"level": k, "passage": h} for k, hs in sorted(q.items()) for h in sorted(hs)] for _, _, q in rows]
            arrays = [pa.array([t for t, _, _ in rows], pa.string()), pa.array([sorted(o) for _, o, _ in rows], pa.list_(pa.int64()))]
            names = ["conv", "turn", "role", "text", "own", "quoted"]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(3)] + [*arrays, pa.array(quoted, pa.list_(pair))], names)

    return df.select(*[F.col(c) for c in (conv_col, turn_col, role_col, text_col)]).mapInArrow(run, schema)


def replies(rows: DataFrame) -> DataFrame:
    """(conv, turn, parent): the last earlier message of the conversation that has a passage of the outermost quote level
    that any message has. Passages and quotes are sorted in runs of turns, and the last message of each run over the runs, so
    no passage of a conversation, however common, is gathered in one task."""
    known = rows.where(F.col("conv").isNotNull() & F.col("turn").isNotNull())
    written_by = known.select("conv", "turn", F.explode("own").alias("passage"), F.lit(None).cast("int").alias("level")).distinct()
    quotes = known.select("conv", "turn", F.explode("quoted").alias("_q")).select("conv", "turn", "_q.passage", "_q.level").distinct()
    wanted = quotes.select("conv", "passage").distinct()
    both = written_by.join(wanted, ["conv", "passage"], "left_semi").unionByName(quotes)
    both = both.withColumn("run", F.floor(F.col("turn") / RUN)).withColumn("by", F.when(F.col("level").isNull(), F.col("turn")))
    order = Window.partitionBy("conv", "passage", "run").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.max("by").over(order)).where("level is not null")
    last = both.groupBy("conv", "passage", "run").agg(F.max("by").alias("last"))
    before = Window.partitionBy("conv", "passage").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    far = last.select("conv", "passage", "run", F.max("last").over(before).alias("far"))
    found = near.join(far, ["conv", "passage", "run"]).select("conv", "turn", "level", F.coalesce("near", "far").alias("parent"))
    found = found.where("parent is not null")
    best = found.groupBy("conv", "turn").agg(F.max(F.struct((-F.col("level")).alias("l"), "parent")).alias("best"))
    return best.select("conv", "turn", F.col("best.parent").alias("parent"))


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` with their position in the conversation, from 0: places within range partitions plus what comes before."""
    order = ["conv", "thread", "turn", "role", "text"]
    ordered = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    numbered = written(ordered.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")))
    parts = numbered.groupBy("conv", "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("conv").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("conv").alias("_conv"), F.col("_part").alias("_p"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = numbered["conv"].eqNullSafe(parts["_conv"]) & (numbered["_part"] == parts["_p"])
    return numbered.join(parts, same).withColumn("position", F.col("_row") - F.col("_first") + F.col("_before"))


def reply_ordered(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``df``: conversation, turn, role, ``text`` without quotes, ``parent`` (turn it answers, or null),
    ``thread`` (first turn of its reply tree), ``position`` (in the conversation, in reply order), ``chat`` (formatted).

    A conversation's ``chat`` in the order of ``position`` is the formatted conversation; conversations are not gathered, so
    one may have any number of messages. A message without a quote, or whose quote no earlier message has, starts a thread.
    Null text is empty, a null role is ``user``. Messages with a null conversation or turn neither quote nor are quoted and
    are their own threads. Rows that repeat a turn share its parent and thread. Other columns are not read.
    """
    rows = written(messages(df, conv_col, turn_col, role_col, text_col))
    links = written(replies(rows))
    named = lambda turn: F.struct(F.col("conv"), F.col(turn).alias("turn"))
    roots = components(links.select(named("turn").alias("a"), named("parent").alias("b")))
    roots = roots.select(F.col("node.conv").alias("conv"), F.col("node.turn").alias("turn"), F.col("label.turn").alias("thread"))
    told = rows.select("conv", "turn", "role", "text").join(links, ["conv", "turn"], "left").join(roots, ["conv", "turn"], "left")
    told = placed(told.withColumn("thread", F.coalesce("thread", "turn")))
    role = F.coalesce(F.col("role"), F.lit("user"))
    chat = F.concat(F.lit("<|"), role, F.lit("|>\n"), F.col("text"), F.lit("\n"))
    return told.select(
        F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), F.col("text").alias(text_col),
        "parent", "thread", "position", chat.alias("chat"),
    )
