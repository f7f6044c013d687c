"""Hard negatives by exact search with segment summaries.

Vectors are stored in blocks of rows, each with the mean and the deviation of its segments. Over a segment of ``m`` components
the inner product of two vectors lies within m (mean mean' +- deviation deviation'); summed over segments, that bounds the score
from both sides. A pair is looked at with one segment, then with more and shorter ones, and scored exactly only if its bounds
still reach what the anchor looks for. The anchors, a stated share of the rows, are searched for a block at a time: a block of a
fixed number of bytes is broadcast, and every task keeps the few best rows of each anchor over all the row blocks it reads, so
that its limits rise as it goes. Nothing but those best rows is shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import shared_folder, written

#: Rows of a stored block, bytes of vectors of a broadcast block of anchors, and anchors compared with a row block at once.
BLOCK_ROWS, ANCHOR_BYTES, TILE = 2048, 4 << 20, 512
#: Segments of a vector, from coarse to fine; the finest are stored.
LEVELS = (1, 4, 16)
#: Share of pairs left above which a whole tile is multiplied rather than its pairs one by one.
DENSE = 0.1
EXACT = 1 << 53  # doubles hold integers below exactly
NONE, LONGEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
BLOCKS = "block long, n int, dim int, kind string, ids binary, labels array<string>, data binary, means binary, deviations binary"


def summaries(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of the finest segments; vectors are filled up with zeros to whole segments."""
    parts = vectors.astype(np.float64).reshape(len(vectors), LEVELS[-1], -1)
    means = parts.mean(axis=2)
    return means, np.sqrt(((parts - means[:, :, None]) ** 2).mean(axis=2))


def padded(lists: pa.Array) -> np.ndarray:
    """One row per vector, zeros after the end of shorter ones, in the smallest integer type that holds them."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    width = -(-max(1, int(sizes.max())) // LEVELS[-1]) * LEVELS[-1]
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    top = max(abs(int(out.max())), abs(int(out.min())))
    return out.astype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64)


def stored(rows: DataFrame, block_rows: int) -> DataFrame:
    """Rows (id, label, vector) in blocks with their segment summaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a in range(0, batch.num_rows, block_rows):
                part = batch.slice(a, block_rows)
                vectors = padded(part.column(2))
                means, deviations = summaries(vectors)
                row = {"block": number, "n": len(vectors), "dim": vectors.shape[1], "kind": vectors.dtype.str}
                row |= {"ids": part.column(0).to_numpy().astype("<i8").tobytes(), "labels": part.column(1).to_pylist()}
                row |= {"data": vectors.tobytes(), "means": means.tobytes(), "deviations": deviations.tobytes()}
                yield pa.RecordBatch.from_pylist([row], schema=SCHEMA)
                number += 1

    return rows.select("id", "label", "vector").mapInArrow(run, BLOCKS)


SCHEMA = pa.schema(
    [("block", pa.int64()), ("n", pa.int32()), ("dim", pa.int32()), ("kind", pa.string()), ("ids", pa.binary()), ("labels", pa.list_(pa.string()))]
    + [(c, pa.binary()) for c in ("data", "means", "deviations")]
)


class Block:
    """Stored rows: ids, labels, vectors, and per level the features whose products are the bounds."""

    def __init__(self, row: dict):
        shape = row["n"], row["dim"]
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.labels = row["labels"]
        self.vectors = np.frombuffer(row["data"], row["kind"]).reshape(shape)
        means, deviations = (np.frombuffer(row[c], np.float64).reshape(shape[0], LEVELS[-1]) for c in ("means", "deviations"))
        self.means, self.deviations = means, deviations
        self.top = int(np.abs(self.vectors.astype(np.float64)).max()) if self.vectors.size else 0

    def widened(self, dim: int) -> "Block":
        """The same rows filled up with zeros, so that segments of two blocks are of the same length."""
        if self.vectors.shape[1] == dim:
            return self
        out = object.__new__(Block)
        out.ids, out.labels, out.top = self.ids, self.labels, self.top
        out.vectors = np.pad(self.vectors, ((0, 0), (0, dim - self.vectors.shape[1])))
        out.means, out.deviations = summaries(out.vectors)
        return out

    def features(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per level sqrt(m) mean and sqrt(m) deviation of its segments, coarse ones pooled from the finest."""
        n = len(self.ids)
        square = self.means**2 + self.deviations**2
        out = []
        for segments in LEVELS:
            m = self.vectors.shape[1] // segments
            mean = self.means.reshape(n, segments, -1).mean(axis=2)
            spread = np.maximum(square.reshape(n, segments, -1).mean(axis=2) - mean**2, 0) if segments < LEVELS[-1] else self.deviations**2
            out.append((mean * np.sqrt(m), np.sqrt(spread * m)))
        return out

    def norms(self) -> np.ndarray:
        length = self.vectors.shape[1] // LEVELS[-1]
        return np.sqrt(((self.means**2 + self.deviations**2) * length).sum(axis=1))


def products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of all rows of ``a`` with all of ``b``; those beyond 64 bits become the largest or smallest long."""
    if exact:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    whole = a.astype(object) @ b.T.astype(object)
    return np.array([[min(max(v, NONE + 1), LONGEST) for v in row] for row in whole], np.int64).reshape(len(a), len(b))


def pair_products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return np.einsum("ij,ij->i", a.astype(np.float64), b.astype(np.float64)).astype(np.int64)
    return np.array([min(max(sum(int(x) * int(y) for x, y in zip(u, v)), NONE + 1), LONGEST) for u, v in zip(a, b)], np.int64)


class Best:
    """The ``k`` best rows of each query, by score and then smaller id: score and id arrays, best first."""

    def __init__(self, n: int, k: int):
        self.score, self.id = np.full((n, k), NONE, np.int64), np.full((n, k), LONGEST, np.int64)

    def limit(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(query):
            return
        k = self.score.shape[1]
        own = np.unique(query)
        q = np.concatenate([np.repeat(own, k), query])
        s, i = np.concatenate([self.score[own].ravel(), score]), np.concatenate([self.id[own].ravel(), ids])
        order = np.lexsort((i, ~s, q))  # ~s descends where s ascends, without overflow
        q, s, i = q[order], s[order], i[order]
        begin = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        best = (begin[:, None] + np.arange(k)).ravel()
        self.score[own], self.id[own] = s[best].reshape(-1, k), i[best].reshape(-1, k)


class Search:
    """Compares row blocks with a block of anchors. A query is an anchor with a range of scores; an anchor may have several."""

    def __init__(self, anchors: Block, low: np.ndarray, high: np.ndarray, k: int, same_label: bool):
        self.anchors, self.low, self.high, self.same_label = anchors, low, high, same_label  # low, high: anchors x queries
        self.best = Best(low.size, k)
        self.k = k
        self.widths: dict = {}
        codes: dict = {}
        self.label = np.array([codes.setdefault(x, len(codes)) for x in anchors.labels], np.int64)
        self.codes = codes

    def look(self, rows: Block) -> None:
        dim = max(rows.vectors.shape[1], self.anchors.vectors.shape[1])
        rows = rows.widened(dim)
        if dim not in self.widths:
            wide = self.anchors.widened(dim)
            self.widths = {dim: (wide, wide.features(), wide.norms())}
        anchors, features, norms = self.widths[dim]
        label = np.array([self.codes.get(x, -1) for x in rows.labels], np.int64)
        row_features, row_norms = rows.features(), rows.norms()
        exact = rows.top * anchors.top * dim < EXACT
        for a in range(0, len(anchors.ids), TILE):
            own = slice(a, min(a + TILE, len(anchors.ids)))
            allowed = (self.label[own][:, None] == label) == self.same_label
            allowed &= anchors.ids[own][:, None] != rows.ids
            self._tile(own, allowed, [(m[own], d[own]) for m, d in features], norms[own], row_features, row_norms, anchors.vectors[own], rows, exact)

    def _limits(self, own: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per query of the tile the least score that still counts, and per anchor the range that any of its queries wants."""
        queries = self.low.shape[1]
        least = np.maximum(self.low[own], self.best.limit().reshape(-1, queries)[own])
        high = self.high[own].max(axis=1)
        return least, least.min(axis=1), np.where(high == LONGEST, np.inf, high)  # a bound may pass the largest long, scores don't

    def _tile(self, own, allowed, features, norms, row_features, row_norms, vectors, rows, exact) -> None:
        least, low, high = self._limits(own)
        slack = 1e-9 * norms[:, None] * row_norms + 1e-6
        left = np.flatnonzero(allowed)
        for (m, d), (rm, rd) in zip(features, row_features):
            if not len(left):
                return
            if len(left) > DENSE * allowed.size:
                middle, spread = m @ rm.T, d @ rd.T + slack
                allowed &= (middle + spread >= low[:, None]) & (middle - spread <= high[:, None])
                left = np.flatnonzero(allowed)
            else:
                i, j = np.divmod(left, allowed.shape[1])
                middle, spread = np.einsum("ij,ij->i", m[i], rm[j]), np.einsum("ij,ij->i", d[i], rd[j]) + slack[i, j]
                left = left[(middle + spread >= low[i]) & (middle - spread <= high[i])]
        i, j = np.divmod(left, allowed.shape[1])
        whole = len(left) > DENSE * allowed.size
        if whole:
            table = products(vectors, rows.vectors, exact)
            score = table[i, j]
        else:
            score = pair_products(vectors[i], rows.vectors[j], exact)
        for q in range(least.shape[1]):
            fits = (score >= least[i, q]) & (score <= self.high[own][i, q])
            qi, qj, qs = i[fits], j[fits], score[fits]
            if len(qs) > 4 * self.k * len(vectors):  # many: only the k best of each row of the tile, and those that tie
                full = np.full(allowed.shape, NONE, np.int64)
                full[qi, qj] = qs
                edge = np.partition(full, -min(self.k, full.shape[1]), axis=1)[:, -min(self.k, full.shape[1])]
                top = qs >= edge[qi]
                qi, qj, qs = qi[top], qj[top], qs[top]
            self.best.add((own.start + qi) * least.shape[1] + q, qs, rows.ids[qj])


def searched(blocks: DataFrame, anchors: dict, low: np.ndarray, high: np.ndarray, k: int, same_label: bool) -> DataFrame:
    """(query int, id, score): each task's ``k`` best rows of each query, over all row blocks it reads."""
    shared = blocks.sparkSession.sparkContext.broadcast((anchors, low, high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, low, high = shared.value
        search = Search(Block(row), low, high, k, same_label)
        for batch in batches:
            for i in range(batch.num_rows):
                search.look(Block(batch.slice(i, 1).to_pylist()[0]))
        found = np.flatnonzero(search.best.score.ravel() > NONE)
        columns = [found // k, search.best.id.ravel()[found], search.best.score.ravel()[found]]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["query", "id", "score"])

    return blocks.mapInArrow(run, "query long, id long, score long")


def once(rows: DataFrame) -> DataFrame:
    """One row of each id: of several the one with the smallest label, then vector."""
    again = written(rows.groupBy("id").count().where("count > 1").select("id"))
    if again.isEmpty():
        return rows
    firsts = rows.join(again, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "vector")).alias("first"))
    return rows.join(again, "id", "left_anti").unionByName(firsts.select("id", "first.label", "first.vector"))


def hard_negatives(
    rows: DataFrame,
    is_anchor: str,
    key: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    positives: int = 5,
    negatives: int = 5,
    percent: int = 80,
    block_rows: int = BLOCK_ROWS,
    anchor_bytes: int = ANCHOR_BYTES,
) -> DataFrame:
    """The hardest negatives of each anchor and positive: (anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score).

    ``vector`` holds whole numbers (array<long>), a score is an inner product, and shorter vectors count as filled up with
    zeros. Anchors are the rows for whose id the SQL expression ``is_anchor`` over ``id`` holds. An anchor's positives are the
    best ``positives`` other rows of its label, its negatives for one of them the best ``negatives`` rows of another label that
    score at least ``percent`` percent of the positive and at most as much. Better is a higher score, then a smaller id. Rows
    with a null id or label, or a null vector or component, take no part. Of rows that repeat an id, the one with the smallest
    label and then vector counts. Scores beyond 64 bits count as the largest or smallest long. A positive with a negative
    score has no negatives. An empty table gives no rows. Other columns aren't looked at.
    """
    spark = rows.sparkSession
    own = rows.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{vector}`").cast("array<long>").alias("vector"))
    fit = once(own.where("id is not null and label is not null and vector is not null and forall(vector, x -> x is not null)"))
    blocks = written(stored(fit, block_rows))
    dim = blocks.agg(F.max("dim")).first()[0] or 1
    per_block = max(1, anchor_bytes // (8 * dim))
    chosen = fit.where(F.expr(is_anchor))
    groups = -(-chosen.count() // per_block)
    anchors = written(chosen.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(max(1, groups)))))
    schema = T.StructType([T.StructField(c, T.IntegerType() if c == "rank" else T.LongType()) for c in RESULT])
    folder = f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    spark.createDataFrame([], schema).write.parquet(folder)
    for part in range(groups):
        block = packed_anchors(anchors.where(F.col("part") == part).select("id", "label", "vector").toArrow())
        if block:
            negatives_of(blocks, block, positives, negatives, percent).write.mode("append").parquet(folder)
    return spark.read.schema(schema).parquet(folder)


RESULT = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def packed_anchors(table: pa.Table) -> dict | None:
    if not table.num_rows:
        return None
    vectors = padded(table.column("vector").combine_chunks())
    means, deviations = summaries(vectors)
    row = {"n": len(vectors), "dim": vectors.shape[1], "kind": vectors.dtype.str, "labels": table.column("label").to_pylist()}
    ids = table.column("id").to_numpy().astype("<i8").tobytes()
    return row | {"ids": ids, "data": vectors.tobytes(), "means": means.tobytes(), "deviations": deviations.tobytes()}


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def negatives_of(blocks: DataFrame, block: dict, positives: int, negatives: int, percent: int) -> DataFrame:
    """The result for one block of anchors."""
    ids = np.frombuffer(block["ids"], "<i8")
    n = len(ids)
    every = np.full((n, 1), NONE, np.int64), np.full((n, 1), LONGEST, np.int64)
    near = ranked(searched(blocks, block, *every, positives, True), positives).toArrow()
    score, other = np.full((n, positives), NONE, np.int64), np.zeros((n, positives), np.int64)
    query, place = near.column("query").to_numpy(), near.column("rank").to_numpy() - 1
    score[query, place], other[query, place] = near.column("score").to_numpy(), near.column("id").to_numpy()
    low = np.array([[-(-percent * int(s) // 100) if s > NONE else LONGEST for s in row] for row in score], np.int64).reshape(n, positives)
    found = ranked(searched(blocks, block, low, score, negatives, False), negatives)
    pairs = pa.table({"query": np.arange(n * positives), "anchor_id": np.repeat(ids, positives), "positive_id": other.ravel(), "positive_score": score.ravel()})
    known = blocks.sparkSession.createDataFrame(pairs)
    joined = found.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(known, "query")
    return joined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
