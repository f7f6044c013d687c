"""Windows of words that repeat, found with a count-min sketch and then counted exactly.

Texts are kept as *units* of a few megabytes, compressed. First pass: every unit sketches its windows. A sketch is sent sparse,
as the sorted 28-bit values from which a window's cell in each of the two rows follows, dealt by hash range into *shards*; a
shard adds up the sketches of all units and returns to each a bitmap of its values whose least cell says two or more. A sketch
only overestimates, so no repeated window is lost. Second pass: the windows estimated repeated, and only they, go to the
shards once more, as 128-bit hashes with their first document, and are grouped exactly; the shard returns a bitmap of those
that an earlier document holds too. Within a unit equal windows are found by themselves, and are sent once: a passage in all
documents costs a shard one value per unit. Memory is bounded by the unit and the shard, whose numbers grow with the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import by_size, bytes_of, mixed, written
from .wordids import WordIds, rolled, slices

#: Bytes of texts of a unit (a longer text is a unit of its own) and windows of a shard.
UNIT_BYTES, SHARD_WINDOWS = 4 << 20, 1 << 20
VALUE_BITS, LEAST_ROW_BITS, MOST_ROW_BITS = 28, 10, 24
ROW_FACTORS = (1, 0x9E3779B1)
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
ESTIMATED, EARLIER = 0, 1
SPACE = re.compile(rb"[\x20\x09-\x0D]")
SENT = "unit long, shard int, n int, data binary"
BACK = "unit long, kind int, shard int, data binary"


def squeezed(*columns: np.ndarray) -> bytes:
    """Arrays of one length, byte plane by byte plane and compressed: sorted values and near document numbers shrink."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns]
    return pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def unsqueezed(data: bytes, n: int, *types: str) -> list[np.ndarray]:
    sizes = [np.dtype(t).itemsize for t in types]
    raw = np.frombuffer(pa.decompress(data, decompressed_size=n * sum(sizes), codec="zstd", asbytes=True), np.uint8)
    ends = np.cumsum([n * s for s in sizes])
    return [np.ascontiguousarray(raw[e - n * s : e].reshape(s, n).T).view(t).ravel() for e, s, t in zip(ends, sizes, types)]


def numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, order long, text): ``order`` increases with the id; whole numbers are their own order."""
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    if isinstance(rows.schema["id"].dataType, T.IntegralType):
        return rows.select("id", F.col("id").cast("long").alias("order"), "text")
    ids = rows.select("id").where("id is not null").distinct().orderBy("id")
    orders = written(ids.select("id", F.monotonically_increasing_id().alias("order")))
    return rows.join(orders, "id", "left").select("id", "order", "text")


def in_units(rows: DataFrame, unit_bytes: int) -> DataFrame:
    """One row per unit: ids, orders, sizes and the compressed texts."""
    kind = rows.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = bytes_of(batch.column(2))
            sizes = [len(t) for t in texts]
            for a, b in by_size(sizes, unit_bytes):
                data = pa.compress(b"".join(texts[a:b]), codec="zstd", asbytes=True)
                ids, orders = (pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), batch.column(c).slice(a, b - a)) for c in (0, 1))
                arrays = [pa.array([number]), ids, orders, pa.array([sizes[a:b]], pa.list_(pa.int64())), pa.array([data], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["unit", "ids", "orders", "sizes", "data"])
                number += 1

    schema = T.StructType([T.StructField("unit", T.LongType()), T.StructField("ids", T.ArrayType(kind))])
    for name, of in (("orders", T.ArrayType(T.LongType())), ("sizes", T.ArrayType(T.LongType())), ("data", T.BinaryType())):
        schema.add(name, of)
    return rows.select("id", "order", "text").mapInArrow(run, schema)


class Unit:
    """The windows of a unit's texts. ``h``, ``g``: halves of their hashes; ``doc``, ``order``: whose they are; ``at``: first word."""

    def __init__(self, orders: list, sizes: list[int], data: bytes, width: int):
        whole = pa.decompress(data, decompressed_size=sum(sizes), codec="zstd", asbytes=True) if any(sizes) else b""
        ends = np.cumsum(sizes).tolist()
        self.texts = [whole[end - size : end] for size, end in zip(sizes, ends)]
        self.width, ids = width, WordIds()
        parts = [np.concatenate([ids.of(s.split()) for s in slices(t, SPACE)]) for t in self.texts]
        self.n_words = np.array([len(p) for p in parts], np.int64)
        words = np.concatenate(parts) if parts else np.empty(0, np.int64)
        first = np.cumsum(self.n_words) - self.n_words
        self.first = first
        open_docs = np.array([o is not None for o in orders], bool) & (self.n_words >= width)
        order = np.array([0 if o is None else o for o in orders], np.int64)
        doc = np.repeat(np.arange(len(parts)), self.n_words)[: max(0, len(words) - width + 1)]
        at = np.flatnonzero(open_docs[doc] & (np.arange(len(doc)) + width <= (first + self.n_words)[doc])) if len(doc) else np.empty(0, np.int64)
        table = ids.hashes() if len(words) else np.empty((0, 2), np.uint64)
        self.h, self.g = (mixed(rolled(table[words, k], width, f)[at]) if len(at) else np.empty(0, np.uint64) for k, f in enumerate(FACTORS))
        self.at, self.doc = at, doc[at]
        self.order = order[self.doc]

    def shard_of(self, h: np.ndarray, shards: int) -> np.ndarray:
        return (((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)

    def sketch(self, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct values in order of shard and value, whether each is there twice, and where each window's value is."""
        value = self.h & np.uint64((1 << VALUE_BITS) - 1)
        keys = (self.shard_of(self.h, shards).astype(np.uint64) << np.uint64(VALUE_BITS)) | value
        distinct, where, n = np.unique(keys, return_inverse=True, return_counts=True)
        return distinct, n > 1, where

    def repeated(self, back: dict, shards: int) -> np.ndarray:
        """Windows that the merged sketch estimates to be there twice or more."""
        distinct, _, where = self.sketch(shards)
        shard = (distinct >> np.uint64(VALUE_BITS)).astype(np.int64)
        flags = np.zeros(len(distinct), bool)
        for s, a, b in runs(shard):
            flags[a:b] = unpacked_bits(back[ESTIMATED, s], b - a)
        return np.flatnonzero(flags[where])

    def grouped(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The chosen windows in order of hash, document and place; where each distinct one begins; which one each is."""
        order = chosen[np.lexsort((self.at[chosen], self.order[chosen], self.g[chosen], self.h[chosen]))]
        h, g = self.h[order], self.g[order]
        new = np.ones(len(order), bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        return order, np.flatnonzero(new), np.cumsum(new) - 1

    def kept(self, back: dict, shards: int) -> Iterator[tuple[int, int, bytes]]:
        """(words, removed words, kept words joined by a space) of each text."""
        order, begin, group = self.grouped(self.repeated(back, shards))
        later = np.zeros(len(begin), bool)  # distinct windows whose first document here is not the first of all
        for s, a, b in runs(self.shard_of(self.h[order[begin]], shards)):
            later[a:b] = unpacked_bits(back[EARLIER, s], b - a)
        own = self.order[order]
        gone = later[group] | (own > own[begin][group])
        same = np.zeros(len(order), bool)  # the same text has the window before: places ascend within an order, texts may share one
        if len(order):
            by_doc = np.lexsort((self.at[order], self.doc[order], group))
            again = (group[by_doc][1:] == group[by_doc][:-1]) & (self.doc[order][by_doc][1:] == self.doc[order][by_doc][:-1])
            same[by_doc[1:]] = again
        starts = self.at[order[gone | same]]
        edge = np.zeros(int(self.n_words.sum()) + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + self.width, -1)
        covered = np.cumsum(edge[:-1]) > 0
        for text, first, n in zip(self.texts, self.first.tolist(), self.n_words.tolist()):
            drop = covered[first : first + n]
            n_gone = int(drop.sum())
            words: list[bytes] = []
            done = 0
            for piece in slices(text, SPACE):
                part = piece.split()
                stay = ~drop[done : done + len(part)]
                words += part if stay.all() else [part[i] for i in np.flatnonzero(stay).tolist()]
                done += len(part)
            yield n, n_gone, b" ".join(words)


def runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, end) of the equal neighbours."""
    if len(values):
        cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)]):
            yield int(values[a]), a, b


def unpacked_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def sent(unit: list[int], shard: list[int], n: list[int], data: list[bytes]) -> pa.RecordBatch:
    arrays = [pa.array(unit, pa.int64()), pa.array(shard, pa.int32()), pa.array(n, pa.int32()), pa.array(data, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, ["unit", "shard", "n", "data"])


def answers(unit: list[int], kind: int, shard: list[int], data: list[bytes]) -> pa.Table:
    columns = [pa.array(unit, pa.int64()), pa.array([kind] * len(unit), pa.int32()), pa.array(shard, pa.int32()), pa.array(data, pa.binary())]
    return pa.table(columns, names=["unit", "kind", "shard", "data"])


def units_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[dict, Unit]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).drop_columns(["ids"]) if "ids" in batch.schema.names else batch.slice(i, 1)
            values = row.to_pylist()[0]
            yield values | {"row": batch.slice(i, 1)}, Unit(values["orders"], values["sizes"], values["data"], width)


def sketches(units: DataFrame, width: int, shards: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, unit in units_of(batches, width):
            distinct, twice, _ = unit.sketch(shards)
            out = []
            for s, a, b in runs((distinct >> np.uint64(VALUE_BITS)).astype(np.int64)):
                values = (distinct[a:b] & np.uint64((1 << VALUE_BITS) - 1)).astype("<u4")
                values[1:] -= values[:-1].copy()  # steps between sorted values are smaller
                out.append((row["unit"], s, b - a, squeezed(values) + np.packbits(twice[a:b]).tobytes()))
            yield sent(*(map(list, zip(*out)) if out else ([], [], [], [])))

    return units.select("unit", "orders", "sizes", "data").mapInArrow(run, SENT)


def estimated(sketched: DataFrame) -> DataFrame:
    """The sketches of a shard added up; back to each unit which of its values are estimated to be there twice or more."""

    def merge(table: pa.Table) -> pa.Table:
        unit, shard, n, data = (table.column(c).to_pylist() for c in ("unit", "shard", "n", "data"))
        values, twice = [], []
        for size, d in zip(n, data):
            cut = len(d) - (size + 7) // 8
            values.append(np.cumsum(unsqueezed(d[:cut], size, "<u4")[0], dtype=np.uint32))
            twice.append(unpacked_bits(d[cut:], size))
        value, double = np.concatenate(values), np.concatenate(twice)
        bits = min(MOST_ROW_BITS, max(LEAST_ROW_BITS, int(8 * len(value)).bit_length()))
        least = None
        for factor in ROW_FACTORS:
            cells = ((value * np.uint32(factor)) & np.uint32((1 << VALUE_BITS) - 1)) >> np.uint32(VALUE_BITS - bits)
            counts = np.bincount(cells, minlength=1 << bits) + np.bincount(cells[double], minlength=1 << bits)
            row = counts[cells] > 1
            least = row if least is None else least & row
        cuts = np.cumsum(n)[:-1]
        return answers(unit, ESTIMATED, shard, [np.packbits(x).tobytes() for x in np.split(least, cuts)])

    return sketched.groupBy("shard").applyInArrow(merge, BACK)


def read_back(batch: dict) -> dict:
    return {(b["kind"], b["shard"]): b["data"] for b in batch["back"] or ()}


def candidates(units: DataFrame, back: DataFrame, width: int, shards: int) -> DataFrame:
    """The distinct windows of each unit that the merged sketch says repeat, with the first document of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, unit in units_of(batches, width):
            order, begin, _ = unit.grouped(unit.repeated(read_back(row), shards))
            one = order[begin]
            out = []
            for s, a, b in runs(unit.shard_of(unit.h[one], shards)):
                own = one[a:b]
                out.append((row["unit"], s, b - a, squeezed(unit.h[own], unit.g[own], unit.order[own])))
            yield sent(*(map(list, zip(*out)) if out else ([], [], [], [])))

    return answered(units, back).select("unit", "orders", "sizes", "data", "back").mapInArrow(run, SENT)


def grouped_exactly(windows: DataFrame) -> DataFrame:
    """Equal windows of a shard together; back to each unit which of its windows a document before its own first one holds."""

    def group(table: pa.Table) -> pa.Table:
        unit, shard, n, data = (table.column(c).to_pylist() for c in ("unit", "shard", "n", "data"))
        h, g, order = (np.concatenate(x) for x in zip(*(unsqueezed(d, k, "<u8", "<u8", "<i8") for k, d in zip(n, data))))
        by = np.lexsort((order, g, h))
        new = np.ones(len(by), bool)
        new[1:] = (h[by][1:] != h[by][:-1]) | (g[by][1:] != g[by][:-1])
        first = order[by][np.flatnonzero(new)][np.cumsum(new) - 1]
        later = np.zeros(len(by), bool)
        later[by] = order[by] > first
        return answers(unit, EARLIER, shard, [np.packbits(x).tobytes() for x in np.split(later, np.cumsum(n)[:-1])])

    return windows.groupBy("shard").applyInArrow(group, BACK)


def answered(units: DataFrame, back: DataFrame) -> DataFrame:
    """Units with the bitmaps sent back to them."""
    own = back.groupBy("unit").agg(F.collect_list(F.struct("kind", "shard", "data")).alias("back"))
    return units.join(own.hint("shuffle_hash"), "unit", "left")


def without_repeats(docs: DataFrame, width: int = 20, key: str = "doc_id", text: str = "text", unit_bytes: int = UNIT_BYTES, shard_windows: int = SHARD_WINDOWS) -> DataFrame:
    """Every row's text without the words of windows that start earlier too: (``key``, text, n_words, n_removed).

    Words are runs of other than ASCII white space, kept words are joined by one space. A window of ``width`` words starts
    earlier if a row of smaller id holds it, or the same row nearer its start; windows are judged on the input. Null texts are
    empty. Rows with a null id take no part: nothing is removed from them or because of them. Rows that share an id do not
    remove words from each other, also if they are equal, but each loses what is in a row of smaller id. Other columns are not
    looked at. Windows are told apart by 128-bit hashes of their words.
    """
    rows = numbered(docs, key, text)
    units = written(in_units(rows, unit_bytes))
    words = units.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).first()["n"] or 0
    shards = max(1, -(-words // (6 * shard_windows)))  # a word and its space take about six bytes
    guessed = written(estimated(sketches(units, width, shards)))
    exact = written(grouped_exactly(candidates(units, guessed, width, shards)))
    kind = rows.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, unit in units_of(batches, width):
            n, gone, texts = zip(*unit.kept(read_back(row), shards))
            ids = row["row"].column("ids").flatten()
            yield pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], [key, "text", "n_words", "n_removed"])

    schema = T.StructType([T.StructField(key, kind), T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    return answered(units, guessed.unionByName(exact)).select("unit", "ids", "orders", "sizes", "data", "back").mapInArrow(run, schema)
