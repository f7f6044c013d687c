"""Repeated passages across documents: blockwise suffix sorting with a difference-cover sample.

Texts are dealt into *batches*; suffixes go to *buckets* by a fingerprint and are sorted one bucket at a time, so memory is
bounded by the bucket and the batch. Two suffixes that agree in ``length`` bytes meet, within one period, at two positions of
the difference cover, and agree from there on in ``length - PERIOD + 1`` bytes. So the sample is ranked first: buckets of
sample suffixes, cut to that depth, tell which sample positions have an equal elsewhere. Only suffixes that reach such a
position can be in a long tie; they alone enter the second sort, by their first ``length`` bytes and then by document and
position, whose first suffix stays. As no order between different passages is needed, the sort keys are 64-bit fingerprints
of the bytes. Exact copies of a whole text are set aside before.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import bytes_of, mixed

# A difference cover; every residue of the period is a difference of two of its members.
PERIOD, COVER = 57, (0, 1, 3, 13, 32, 36, 43, 52)

BATCH_BYTES, SAMPLE_BUCKET_BYTES, BUCKET_BYTES = 8 << 20, 48 << 20, 16 << 20
SEGMENT = 1 << 19
FACTOR = 0x5851F42D4C957F2D
RANKED, EARLIER, COPY = 0, 1, 2
BACK = "batch long, kind int, bucket int, data binary"


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(FACTOR, -1, 1 << 64)
    up, down = np.full(n, FACTOR, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def fingerprints(data: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """64-bit fingerprint of the ``width`` bytes at each of the ascending ``starts``."""
    out = np.empty(len(starts), np.uint64)
    up, down = _powers(SEGMENT + width + 1)
    cuts = np.searchsorted(starts, np.arange(0, len(data) + SEGMENT, SEGMENT))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        if a < b:
            base = k * SEGMENT
            part = data[base : base + SEGMENT + width].astype(np.uint64)
            part *= up[: len(part)]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part, out=sums[1:])
            at = starts[a:b] - base
            out[a:b] = (sums[at + width] - sums[at]) * down[at]
    return mixed(out)


def _split(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by bucket (stable), and where each bucket ends in it."""
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n), side="right")


def _bucket(prints: np.ndarray, n: int) -> np.ndarray:
    return (((prints >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def packed(texts: DataFrame) -> DataFrame:
    """Rows (batch, doc, text) as one row per batch of each Arrow batch: ids, sizes and the compressed texts, so that
    shuffling the texts costs about half of what they take as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            order = np.argsort(rows.column(0).to_numpy(), kind="stable")
            numbers, starts = np.unique(rows.column(0).to_numpy()[order], return_index=True)
            out = []
            for at in np.split(order, starts[1:]) if len(order) else []:
                own = rows.take(pa.array(at))
                texts = bytes_of(own.column(2))
                data = pa.compress(b"".join(texts), codec="zstd", asbytes=True)
                out.append((own.column(1).to_pylist(), [len(t) for t in texts], data))
            docs, sizes, data = zip(*out) if out else ((), (), ())
            arrays = [pa.array(docs, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int64())), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), *arrays], ["batch", "docs", "sizes", "data"])

    return texts.select("batch", "doc", "text").mapInArrow(run, "batch long, docs array<long>, sizes array<long>, data binary")


def unpacked(rows: pa.Table) -> tuple[list, list[bytes]]:
    ids: list = []
    texts: list[bytes] = []
    for docs, sizes, data in zip(*(rows.column(c).to_pylist() for c in ("docs", "sizes", "data"))):
        whole = pa.decompress(data, decompressed_size=sum(sizes), codec="zstd", asbytes=True) if any(sizes) else b""
        ends = np.cumsum(sizes).tolist()
        ids += docs
        texts += [whole[end - size : end] for size, end in zip(sizes, ends)]
    return ids, texts


class Batch:
    """The distinct documents of a batch in order of id and text, as one array of bytes."""

    def __init__(self, rows: pa.Table, back: pa.Table, length: int):
        ids, texts = unpacked(rows)
        self.length = length
        self.row_ids = ids
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
        self.own = np.zeros(len(ids), np.int64)  # the document of each row
        self.ids: list = []
        self.texts: list[bytes] = []
        for i in order:
            if not self.ids or self.ids[-1] != ids[i] or self.texts[-1] != texts[i]:
                self.ids.append(ids[i])
                self.texts.append(texts[i])
            self.own[i] = len(self.ids) - 1
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        kinds, buckets, data = (back.column(c).to_pylist() for c in ("kind", "bucket", "data"))
        self.back = {(k, b): d for k, b, d in zip(kinds, buckets, data) if k != COPY}
        copies = {int(d) for k, d in zip(kinds, data) if k == COPY}
        self.copy = np.array([i in copies and n >= length for i, n in zip(self.ids, self.size)], bool)
        self.open = ~self.copy & (self.size >= length) & np.array([i is not None for i in self.ids], bool)

    def sample(self) -> np.ndarray:
        """Cover positions, in order, with room for a sample suffix."""
        depth = self.length - PERIOD + 1
        cover = np.array(COVER)
        parts = []
        for begin, size in zip(self.begin[self.open].tolist(), self.size[self.open].tolist()):
            at = (np.arange(0, size, PERIOD)[:, None] + cover).ravel()
            parts.append(at[at <= size - depth] + begin)
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def sample_prints(self, at: np.ndarray) -> np.ndarray:
        return fingerprints(self.data, at, self.length - PERIOD + 1)

    def returned(self, kind: int, order: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The bits that the buckets gave back, in the batch's own order."""
        out = np.zeros(len(order), bool)
        start = 0
        for bucket, end in enumerate(ends):
            bits = self.back.get((kind, bucket))
            if bits is not None:
                out[order[start:end]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=end - start).astype(bool)
            start = end
        return out

    def suffixes(self, sample_buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the suffixes that may be in a long tie, and the document of each."""
        at = self.sample()
        order, ends = _split(_bucket(self.sample_prints(at), sample_buckets), sample_buckets)
        at = at[self.returned(RANKED, order, ends)]
        cover = np.zeros(len(self.data) + 1, np.int32)
        doc = np.searchsorted(self.begin + self.size, at, side="right")
        low = np.maximum(at - PERIOD + 1, self.begin[doc])
        high = np.minimum(at, self.begin[doc] + self.size[doc] - self.length) + 1
        some = low < high
        np.add.at(cover, low[some], 1)
        np.add.at(cover, high[some], -1)
        starts = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
        return starts, np.searchsorted(self.begin + self.size, starts, side="right")

    def firsts(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of the suffixes, and which are the first of their kind in the batch."""
        prints = fingerprints(self.data, starts, self.length)
        order = np.argsort(prints, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = prints[order][1:] != prints[order][:-1]
        first = np.zeros(len(order), bool)
        first[order[new]] = True
        return prints, first


def passages(df: DataFrame, id_col: str, text_col: str, length: int) -> tuple[DataFrame, DataFrame, dict]:
    """Documents in batches, exact copies, and the numbers of batches and buckets."""
    total = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = {k: int(-(-total // size)) or 1 for k, size in (("batches", BATCH_BYTES), ("samples", SAMPLE_BUCKET_BYTES), ("suffixes", BUCKET_BYTES))}
    batch = lambda c: F.pmod(F.xxhash64(c), F.lit(n["batches"])).alias("batch")
    texts = df.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(text_col, F.lit("")).alias("text"))
    texts = texts.select(batch("doc"), "doc", "text")
    long_enough = texts.where(F.col("doc").isNotNull() & (F.octet_length("text") >= length)).select("doc", F.sha2("text", 256).alias("digest"))
    first = long_enough.groupBy("digest").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1")
    # an id with several texts is left to the sort: a copy here is an id all of whose texts are copies
    state = long_enough.join(first.select("digest", "first"), "digest", "left").groupBy("doc")
    copies = state.agg(F.min(F.coalesce(F.col("first") < F.col("doc"), F.lit(False)).cast("int")).alias("all")).where("all = 1")
    data = F.col("doc").cast("string").cast("binary").alias("data")
    copies = copies.select(batch("doc"), F.lit(COPY).alias("kind"), F.lit(0).alias("bucket"), data)
    return packed(texts), copies, n


def by_batch(texts: DataFrame, back: DataFrame, parts: int, run, schema: str) -> DataFrame:
    left, right = texts.repartition(parts, "batch"), back.repartition(parts, "batch")
    return left.groupBy("batch").cogroup(right.groupBy("batch")).applyInArrow(run, schema)


def ranked_sample(texts: DataFrame, copies: DataFrame, n: dict, length: int, parts: int) -> DataFrame:
    """Which sample suffixes have an equal: a bit for each, by batch and bucket."""

    def deal(rows: pa.Table, back: pa.Table) -> pa.Table:
        batch = Batch(rows, back, length)
        prints = batch.sample_prints(batch.sample())
        order, ends = _split(_bucket(prints, n["samples"]), n["samples"])
        low = (prints & np.uint64(0xFFFFFFFF)).astype("<u4")[order]
        starts = np.append(0, ends[:-1])
        used = np.flatnonzero(ends > starts)
        number = rows.column("batch")[0].as_py() if rows.num_rows else 0
        columns = [[number] * len(used), used.tolist(), [low[starts[b] : ends[b]].tobytes() for b in used]]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary()))], ["batch", "bucket", "data"])

    def rank(rows: pa.Table) -> pa.Table:
        blobs = rows.column("data").to_pylist()
        values = np.frombuffer(b"".join(blobs), "<u4")
        order = np.argsort(values)
        ordered = values[order]
        same = ordered[1:] == ordered[:-1]
        several = np.zeros(len(values), bool)
        several[order[1:][same]] = True
        several[order[:-1][same]] = True
        return _bits(rows, [len(b) // 4 for b in blobs], several, RANKED)

    dealt = by_batch(texts, copies, parts, deal, "batch long, bucket int, data binary")
    return dealt.groupBy("bucket").applyInArrow(rank, BACK)


def _bits(rows: pa.Table, sizes: list[int], flags: np.ndarray, kind: int) -> pa.Table:
    """The flags of each record of a bucket, packed; records without a set flag send nothing back."""
    ends = np.cumsum(sizes)
    out = []
    for batch, bucket, size, end in zip(rows.column("batch").to_pylist(), rows.column("bucket").to_pylist(), sizes, ends):
        own = flags[end - size : end]
        if own.any():
            out.append((batch, kind, bucket, np.packbits(own).tobytes()))
    columns = list(zip(*out)) or [[], [], [], []]
    types = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], ["batch", "kind", "bucket", "data"])


def earlier_suffixes(texts: DataFrame, back: DataFrame, n: dict, length: int, parts: int) -> DataFrame:
    """Which first suffixes of the batches have an equal in an earlier document: a bit for each, by batch and bucket."""

    def deal(rows: pa.Table, back: pa.Table) -> pa.Table:
        batch = Batch(rows, back, length)
        starts, doc = batch.suffixes(n["samples"])
        prints, first = batch.firsts(starts)
        prints, doc = prints[first], doc[first]
        order, ends = _split(_bucket(prints, n["suffixes"]), n["suffixes"])
        prints, doc = prints[order], doc[order]
        ids = np.array([i or 0 for i in batch.ids], np.int64)
        number = rows.column("batch")[0].as_py() if rows.num_rows else 0
        out = []
        for bucket, (a, b) in enumerate(zip(np.append(0, ends[:-1]), ends)):
            if a < b:
                which, counts = np.unique(doc[a:b], return_counts=True)
                small = [zlib.compress(x.tobytes(), 1) for x in (ids[which], counts.astype(np.int32))]
                out.append((number, bucket, *small, prints[a:b].tobytes()))
        columns = list(zip(*out)) or [[]] * 5
        types = (pa.int64(), pa.int32(), *[pa.binary()] * 3)
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], ["batch", "bucket", "docs", "counts", "data"])

    def sort(rows: pa.Table) -> pa.Table:
        blobs = rows.column("data").to_pylist()
        prints = np.frombuffer(b"".join(blobs), np.uint64)
        docs = np.concatenate([np.frombuffer(zlib.decompress(d), np.int64) for d in rows.column("docs").to_pylist()])
        counts = np.concatenate([np.frombuffer(zlib.decompress(d), np.int32) for d in rows.column("counts").to_pylist()])
        order = np.lexsort((np.repeat(docs, counts), prints))
        ordered = prints[order]
        later = np.zeros(len(prints), bool)
        later[order[1:][ordered[1:] == ordered[:-1]]] = True
        return _bits(rows, [len(b) // 8 for b in blobs], later, EARLIER)

    dealt = by_batch(texts, back, parts, deal, "batch long, bucket int, docs binary, counts binary, data binary")
    return dealt.groupBy("bucket").applyInArrow(sort, BACK)


def dedup_passages(df: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per row of ``df``: id (long), ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` [, ``kept``: binary].

    A byte goes if it lies in ``length`` bytes that also start earlier: in a document with a smaller id, or earlier in the
    same one. Null text is empty. A row with a null id neither loses bytes nor makes others lose any; equal rows are one
    document; of several texts with one id, the smaller comes first. Other columns are not read. An empty table gives none.
    """
    if length < PERIOD:
        raise ValueError(f"passages must have {PERIOD} bytes or more")
    spark = df.sparkSession
    texts, copies, n = passages(df, id_col, text_col, length)
    parts = min(n["batches"], int(spark.conf.get("spark.sql.shuffle.partitions")) * 4)
    ranks = ranked_sample(texts, copies, n, length, parts)
    back = ranks.unionByName(copies)
    both = back.unionByName(earlier_suffixes(texts, back, n, length, parts))

    def cut(rows: pa.Table, back: pa.Table) -> pa.Table:
        batch = Batch(rows, back, length)
        starts, _ = batch.suffixes(n["samples"])
        prints, first = batch.firsts(starts)
        repeat = ~first
        at = np.flatnonzero(first)
        order, ends = _split(_bucket(prints[first], n["suffixes"]), n["suffixes"])
        repeat[at[batch.returned(EARLIER, order, ends)]] = True
        cover = np.zeros(len(batch.data) + 1, np.int32)
        cover[starts[repeat]] += 1
        cover[starts[repeat] + length] -= 1
        gone = np.cumsum(cover[:-1]) > 0
        results = []
        for text, begin, size, copy in zip(batch.texts, batch.begin.tolist(), batch.size.tolist(), batch.copy.tolist()):
            mark = gone[begin : begin + size]
            removed = size if copy else int(mark.sum())
            spans = 1 if copy else int(mark[:1].sum()) + int((mark[1:] & ~mark[:-1]).sum())
            kept = b"" if copy else batch.data[begin : begin + size][~mark].tobytes() if removed else text
            results.append((size, removed, spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        columns = list(zip(*(results[i] for i in batch.own))) or [[]] * 5
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        ids = pa.array(batch.row_ids, pa.int64())
        names = ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        return pa.table([ids, *[pa.array(c, t) for c, t in zip(columns, types)]], names)

    schema = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    out = by_batch(texts, both, parts, cut, schema).withColumnRenamed("doc", id_col)
    return out if with_text else out.drop("kept")
