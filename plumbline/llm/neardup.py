"""Near-duplicate documents by a chosen-path set similarity join over minwise hashes.

Each document's shingles become ``WIDTH`` minwise hashes; a *token* is a place in that signature with the value there. A tree
starts with all documents. At each node every place is chosen with probability 1 / (similarity x WIDTH), by a hash of the
node, and the documents go on to one child per chosen place and value. Documents that reach the threshold share a child with
the probability that keeps the branching alive; others part quickly. Independent trees are repeated until the recall is met.

A node's documents are compared with a leader of the node first, then, where a small node still holds different classes, all
with all. Nodes whose documents already form one class are done; large ones with several classes branch again. Candidates
must agree in four bits of enough minwise hashes and are then confirmed on the full sets. Documents with equal sets are joined before.

Nodes that further branching doesn't part are dense: all their documents are compared all with all on the full sets, block by
block, as products of 0/1 matrices, where the sizes of their sets allow a link. That work grows with the square of a dense node
that holds several classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import WORD_HASHES, bytes_of, mixed, windows_of, written
from .graph import joined_classes

SHINGLE, PERCENT, WIDTH = 5, 75, 128
#: Nodes of up to so many documents are compared all with all; trees branch this deep at most.
SMALL, DEEPEST = 32, 6
#: Documents, and shingles of all of them, in a block of a dense node (expected; a longer document is a block of its own or
#: makes its block longer); shingles that are columns of a matrix at a time.
BLOCK, BLOCK_SHINGLES, COLUMNS = 512, 1 << 20, 2048
#: A dense node of more blocks is cut by the size of the sets first: a document then meets the blocks of up to three bands.
UNCUT = 3
#: A child that keeps so much of its node is dense: its documents are too alike to part by further branching.
DENSE = 0.6
RECALL_DEPTH, RECALL = 3, 0.9995
#: Minwise hashes of WIDTH that a candidate must share: 4.5 standard deviations below what the threshold leads to.
AGREE = int(WIDTH * PERCENT / 100 - 4.5 * math.sqrt(WIDTH * PERCENT / 100 * (1 - PERCENT / 100)))
#: Size of the filter that keeps documents out of a shuffle: a power of two of bits.
FILTER_BITS = 25
SIGNATURE = "doc {id}, n_shingles long, d1 long, d2 long, signature array<int>"

_A = (mixed(np.arange(1, WIDTH + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (mixed(np.arange(WIDTH + 1, 2 * WIDTH + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_CHANCE = np.uint64(int(2**64 / (WIDTH * PERCENT / 100)))
_PLACES = np.arange(1, WIDTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def trees() -> int:
    """Trees after which a pair at the threshold has met with probability ``RECALL`` at ``RECALL_DEPTH``."""
    meets = 1.0
    for _ in range(RECALL_DEPTH):
        meets = 1 - math.exp(-meets)
    return math.ceil(math.log(1 - RECALL) / math.log(1 - meets))


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; words are runs of other bytes than ASCII white space, A-Z lowered."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(windows_of(WORD_HASHES.of(words), min(SHINGLE, len(words))))


def minwise(hashes: np.ndarray) -> np.ndarray:
    """The ``WIDTH`` minwise tokens of a set, a slice of the set at a time: 25 bits of the smallest hash and its place."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    best = np.full(WIDTH, np.iinfo(np.uint32).max, np.uint32)
    for s in range(0, len(short), 1024):
        best = np.minimum(best, (short[s : s + 1024, None] * _A + _B).min(axis=0))
    best = (best ^ (best >> np.uint32(16))) * np.uint32(0x45D9F3B)
    best ^= best >> np.uint32(16)
    return ((best & ~np.uint32(WIDTH - 1)) | np.arange(WIDTH, dtype=np.uint32)).view(np.int32)


def signatures(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, d1, d2, marks = [], [], [], []
            for text in bytes_of(batch.column(1)):
                found = shingles(text)
                digest = xxhash.xxh3_128_digest(found.tobytes())
                counts.append(len(found))
                d1.append(int.from_bytes(digest[:8], "little", signed=True))
                d2.append(int.from_bytes(digest[8:], "little", signed=True))
                marks.append(minwise(found) if len(found) else None)
            longs = [pa.array(x, pa.int64()) for x in (counts, d1, d2)]
            arrays = [batch.column(0), *longs, pa.array(marks, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc", "n_shingles", "d1", "d2", "signature"])

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, SIGNATURE.format(id=kind))


def full_sets(df: DataFrame, kind: str) -> DataFrame:
    """(rep, set) of rows (rep, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t).view(np.int64) for t in bytes_of(batch.column(1))]
            ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            values = np.concatenate(sets) if sets else np.empty(0, np.int64)
            arrays = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), arrays], ["rep", "set"])

    return df.mapInArrow(run, f"rep {kind}, set array<long>")


def chosen(roots: int) -> int:
    """Tokens of a document that the roots of the trees choose."""
    return len(_roots(roots)[0])


def _roots(roots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tree and place of each choice, and the trees' own nodes."""
    trees_at = mixed(np.arange(1, roots + 1, dtype=np.uint64))
    tree, place = np.nonzero(mixed(trees_at[:, None] ^ _PLACES) < _CHANCE)
    return tree, place, trees_at


def branch(df: DataFrame, roots: int, kind: str) -> DataFrame:
    """(node, rep, above) of the children: of ``roots`` trees, or of the nodes in the column ``nodes`` (one row per document, with
    (node, n) of each of its nodes), whose sizes go along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = batch.column("signature").flatten().to_numpy().view(np.uint32)
            marks = tokens.reshape(-1, WIDTH).astype(np.uint64)
            if roots:
                tree, place, trees_at = _roots(roots)
                row = np.tile(np.arange(len(marks)), len(tree))
                tree, place = np.repeat(trees_at[tree], len(marks)), np.repeat(place, len(marks))
                size = pa.nulls(len(row), pa.int64())
            else:
                held, above = batch.column("nodes").flatten(), np.repeat(np.arange(len(marks)), batch.column("nodes").value_lengths())
                nodes = held.field("node").to_numpy().view(np.uint64)
                at, place = np.nonzero(mixed(nodes[:, None] ^ _PLACES) < _CHANCE)
                tree, row, size = nodes[at], above[at], held.field("n").take(pa.array(at))
            child = mixed(mixed(tree + _PLACES[place]) ^ marks[row, place])
            arrays = [pa.array(child.view(np.int64)), batch.column("rep").take(pa.array(row)), size]
            yield pa.RecordBatch.from_arrays(arrays, ["node", "rep", "above"])

    columns = ["rep", "signature"] if roots else ["rep", "signature", "nodes"]
    return df.select(columns).mapInArrow(run, f"node long, rep {kind}, above long")


def among(df: DataFrame, column: str, ids: DataFrame, inside: bool = True) -> DataFrame:
    """Rows of ``df`` whose ``column`` may be in ``ids`` (one column): a broadcast bit set of at most 2^FILTER_BITS bits
    holds back most others before a shuffle, however many ids there are. Those others, which are in no case among them, if
    not ``inside``."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << FILTER_BITS))
    at = ids.select(bit(F.col(ids.columns[0])).alias("_at"))
    words = at.groupBy(F.shiftright("_at", 6).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(_at & 63 as int)))").alias("_bits"))
    found = df.withColumn("_at", bit(F.col(column))).withColumn("_w", F.shiftright("_at", 6))
    found = found.join(F.broadcast(words), F.col("_w") == F.col("_word"), "inner" if inside else "left")
    hit = F.expr("getbit(_bits, cast(_at & 63 as int)) = 1")
    return found.where(hit if inside else F.col("_word").isNull() | ~hit).select(df.columns)


def only(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``column`` is in ``ids`` (one column, distinct). An inner join: Spark would move a semi join to
    before the bit set, and so shuffle all rows."""
    known = ids.select(F.col(ids.columns[0]).alias("_id"))
    return among(df, column, ids).join(known, F.col(column) == F.col("_id")).select(df.columns)


def sketches(marks: DataFrame, kind: str) -> DataFrame:
    """(rep, sketch) of ``marks``: four bits of each token, an eighth of the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column("signature").flatten().to_numpy().view(np.uint32).reshape(-1, WIDTH)
            bits = (tokens >> np.uint32(28)).astype(np.uint8)
            words = (bits[:, ::2] | bits[:, 1::2] << 4).view(np.int64)
            ends = pa.array(np.arange(len(words) + 1, dtype=np.int32) * words.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.ListArray.from_arrays(ends, pa.array(words.ravel()))], ["rep", "sketch"])

    return marks.select("rep", "signature").mapInArrow(run, f"rep {kind}, sketch array<long>")


def agreeing(x: Column, y: Column) -> Column:
    """Places at which two sketches agree: all those at which the signatures do, and a sixteenth of the others."""

    def differing(word: int) -> Column:
        d = x[word].bitwiseXOR(y[word])
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        return F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))

    return F.lit(WIDTH) - reduce(Column.__add__, map(differing, range(WIDTH // 16)))


def similar(x: Column, y: Column) -> Column:
    """100 * intersection >= PERCENT * union, of two arrays of distinct hashes."""
    both = F.size(F.array_intersect(x, y))
    return 100 * both >= PERCENT * (F.size(x) + F.size(y) - both)


class Join:
    """The state of one join: sketches and texts of the representatives, and the classes found so far."""

    def __init__(self, marks: DataFrame, texts: DataFrame, kind: str, links: DataFrame):
        self.sketches, self.texts, self.kind = written(sketches(marks, kind)), texts, kind
        self.labels: DataFrame | None = None if links.isEmpty() else joined_classes(None, links)

    def labelled(self, nodes: DataFrame) -> DataFrame:
        """``nodes`` (node, rep) with the class of each document so far."""
        if self.labels is None:
            return nodes.withColumn("label", F.col("rep"))
        labels = self.labels.select(F.col("node").alias("rep"), "label")
        return nodes.join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))

    def apart(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` (a, b, ...) of different classes."""
        if self.labels is None:
            return pairs
        la, lb = (self.labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in "ab")
        found = pairs.join(la, "a", "left").join(lb, "b", "left")
        return found.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select(pairs.columns)

    def candidates(self, pairs: DataFrame) -> DataFrame:
        """(a, b, agree) of the pairs (x, y) that may be similar enough; different classes only."""
        a, b = F.least("x", "y"), F.greatest("x", "y")
        pairs = written(self.apart(pairs.where("x <> y").select(a.alias("a"), b.alias("b")).distinct()))
        held = (among(self.sketches, "rep", pairs.select(c)) for c in "ab")
        left, right = (x.select(F.col("rep").alias(c), F.col("sketch").alias(f"s{c}")) for c, x in zip("ab", held))
        met = pairs.join(left, "a").join(right, "b")
        return met.select("a", "b", agreeing(F.col("sa"), F.col("sb")).alias("agree")).where(F.col("agree") >= AGREE)

    def sets_of(self, ids: DataFrame) -> DataFrame:
        """(rep, set) of the documents in ``ids`` (one column) and of few others, which no join by ``rep`` meets: whatever the
        size of ``ids``, no text is shuffled."""
        return written(full_sets(among(self.texts, "rep", ids), self.kind))

    def confirm(self, pairs: DataFrame) -> None:
        """Joins the classes of the pairs (a, b) that the full sets confirm."""
        sets = self.sets_of(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")))
        held = (among(sets, "rep", pairs.select(c)) for c in "ab")
        left, right = (x.select(F.col("rep").alias(c), F.col("set").alias(f"s{c}")) for c, x in zip("ab", held))
        true = written(pairs.join(left, "a").join(right, "b").where(similar(F.col("sa"), F.col("sb"))).select("a", "b"))
        if not true.isEmpty():
            self.labels = joined_classes(self.labels, true)

    def compare_all(self, pool: DataFrame) -> None:
        """Joins the classes that any similar pair of a node of ``pool`` (node, rep, guest, label) links."""
        sets = self.sets_of(pool.select("rep")).where(F.size("set") > 0)
        true = written(dense_links(pool, sets, self.kind).distinct())
        if not true.isEmpty():
            self.labels = joined_classes(self.labels, true)

    def compare(self, pairs: DataFrame, best_first: bool = False) -> None:
        """Confirms candidate pairs (x, y). ``best_first``: each document's most promising pair before the others, of which
        those inside the classes so found need no test."""
        found = written(self.candidates(pairs))
        if found.isEmpty():
            return
        if best_first:
            best = found.groupBy("b").agg(F.max_by("a", "agree").alias("a")).select("a", "b")
            self.confirm(written(best))
            found = written(self.apart(found.join(best, ["a", "b"], "left_anti")))
            if found.isEmpty():
                return
        self.confirm(found.select("a", "b"))


def links_within(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, labels: list) -> list[tuple[int, int]]:
    """Links (row, row) that join the same rows as all similar pairs of a left and a right row with different labels do.

    ``sets`` are distinct shingle hashes. Shared shingles are counted exactly, as products of 0/1 matrices.
    """
    sizes = np.array([len(x) for x in sets])
    values, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1)[at]  # a shingle of one row is in no pair
    row = np.repeat(np.arange(len(sets)), sizes)[column >= 0]
    column = column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (start, start + COLUMNS))
        holds = np.zeros((len(sets), COLUMNS), np.float32)
        holds[row[a:b], column[a:b] - start] = 1
        both += holds[left] @ holds[right].T
    both = both.astype(np.int64)
    kinds = {x: i for i, x in enumerate(dict.fromkeys(labels))}
    label = np.array([kinds[x] for x in labels])
    near = 100 * both >= PERCENT * (sizes[left][:, None] + sizes[right][None, :] - both)
    near &= label[left][:, None] != label[right][None, :]
    linked = np.zeros((len(sets), len(sets)), bool)
    linked[np.ix_(left, right)] = near
    linked |= linked.T
    out, unseen = [], linked.any(axis=1)
    while unseen.any():
        ahead = [int(unseen.argmax())]
        unseen[ahead[0]] = False
        while ahead:
            x = ahead.pop()
            found = np.flatnonzero(linked[x] & unseen).tolist()
            unseen[found] = False
            out += [(x, y) for y in found]
            ahead += found
    return out


def dense_pools(nodes: DataFrame) -> DataFrame:
    """(node, rep, guest) of the dense ``nodes`` (node, rep, n, guest), all documents of all nodes, where nodes that hold much
    the same documents are one: a node goes to the largest one that half of its documents or more are in.

    A guest branches on, and so is only to be compared with the documents that don't.
    """
    hosts = nodes.where("not guest")
    home = F.max(F.struct("n", "node")).over(Window.partitionBy("rep"))["node"]
    counts = hosts.select("node", home.alias("home")).groupBy("node", "home").agg(F.count("*").alias("m"))
    pools = counts.groupBy("node").agg(F.max(F.struct("m", "home")).alias("top"), F.sum("m").alias("all"))
    pools = pools.select("node", F.when(2 * F.col("top.m") >= F.col("all"), F.col("top.home")).otherwise(F.col("node")).alias("pool"))
    members = nodes.join(pools, "node").groupBy("pool", "rep").agg(F.min("guest").alias("guest"))
    return members.withColumnRenamed("pool", "node")


def band(size: Column) -> Column:
    """Band of a set's size. Similar sets are in one band or in neighbouring ones: the smaller has PERCENT hundredths of the
    larger at least, and a band is a little wider than that (far more than logarithms are inexact)."""
    return F.floor(F.log(size) / F.lit(math.log(100.1 / PERCENT)))


def around(column: str) -> Column:
    """One row for each of the value in ``column`` and its two neighbours."""
    return F.explode(F.array(*(F.col(column) + i for i in (-1, 0, 1)))).alias(column)


def dense_rows(pool: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, xpart, ypart, part, rep, label, set): the documents of each pair of blocks that is to be compared. ``pool`` (node,
    rep, guest, label), ``sets`` (rep, set).

    Sizes of sets rule most pairs out: a guest without a host of its band or a neighbouring one is left out, and the blocks of
    a node of many blocks hold one band each and meet those of the bands beside it.
    """
    sets = sets.withColumn("band", band(F.size("set")))
    sizes = sets.groupBy("rep", "band").agg(F.sum(F.size("set")).alias("size"))
    pool = written(pool.join(sizes, "rep"))
    hosts = pool.where("not guest")
    guests = pool.where("guest").join(hosts.select("node", around("band")).distinct(), ["node", "band"])
    pool = written(hosts.unionByName(guests))
    shares = lambda by: pool.groupBy(*by).agg(F.count("*").alias("m"), F.sum("size").alias("s"))
    parts = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("s") / BLOCK_SHINGLES))
    # classes that fill a block have blocks of their own: these aren't compared with each other
    large = shares(["node", "guest", "label"]).where((F.col("m") >= BLOCK) | (F.col("s") >= BLOCK_SHINGLES))
    homes = pool.join(large.select("node", "guest", "label", F.lit(True).alias("own")), ["node", "guest", "label"], "left")
    homes = homes.withColumn("home", F.when(F.col("own"), F.xxhash64(F.col("label").cast("string"))).otherwise(F.lit(0)))
    cut = shares(["node", "guest"]).where("not guest").where(parts > UNCUT).select("node", F.lit(True).alias("cut"))
    homes = homes.join(cut, "node", "left").withColumn("cell", F.when(F.col("cut"), F.col("band")).otherwise(F.lit(0)))
    homes = written(homes.select("node", "guest", "home", "cell", "rep", "band", "label", "size"))
    many = homes.groupBy("node", "guest", "home", "cell").agg(F.count("*").alias("m"), F.sum("size").alias("s"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    many = many.select("node", "guest", "home", "cell", parts.alias("k"), F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("one"))
    blocks = many.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    key = F.xxhash64("guest", "home", "cell", "block")
    blocks = written(blocks.select("node", "cell", key.alias("part"), "guest", "one"))
    x, y = (blocks.select("node", "cell", F.col("part").alias(f"{c}part"), F.col("guest").alias(f"{c}guest"), F.col("one").alias(f"{c}one")) for c in "xy")
    x = x.select("node", around("cell"), "xpart", "xguest", "xone")
    met = x.join(y, ["node", "cell"]).where("xpart <= ypart and not (xguest and yguest) and (xone is null or yone is null or xone <> yone)")
    sides = F.when(F.col("xpart") == F.col("ypart"), F.array("xpart")).otherwise(F.array("xpart", "ypart"))
    tasks = met.select("node", "xpart", "ypart", F.explode(sides).alias("part"))
    placed = homes.join(many.select("node", "guest", "home", "cell", "k"), ["node", "guest", "home", "cell"])
    placed = placed.withColumn("block", F.pmod(F.xxhash64(F.col("rep").cast("string"), F.lit(1)), F.col("k")))
    placed = placed.select("node", key.alias("part"), "rep", "band", "label").join(tasks, ["node", "part"])
    held = among(sets, "rep", homes.select("rep"))
    return placed.join(held, ["rep", "band"]).select("node", "xpart", "ypart", "part", "rep", "label", "set")


def dense_links(pool: DataFrame, sets: DataFrame, kind: str) -> DataFrame:
    """(a, b) that link what the similar pairs of different labels in each node of ``pool`` (node, rep, guest, label) link;
    ``sets`` (rep, set). Blocks of documents are compared with each other, each pair of blocks in a group of its own."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part").to_numpy()
        left, right = (np.flatnonzero(part == table.column(c)[0].as_py()) for c in ("xpart", "ypart"))
        sets = [x.values.to_numpy().view(np.uint64) for chunk in table.column("set").chunks for x in chunk]
        links = links_within(sets, left, right, table.column("label").to_pylist())
        reps = table.column("rep").combine_chunks()
        a, b = (reps.take(pa.array([x[i] for x in links], pa.int64())) for i in (0, 1))
        return pa.table({"a": a, "b": b})

    return dense_rows(pool, sets).groupBy("node", "xpart", "ypart").applyInArrow(run, f"a {kind}, b {kind}")


def leaders(nodes: DataFrame) -> DataFrame:
    """(node, n, leader): a leader that depends on the node, found by a minimum that combines before the shuffle."""
    draw = F.xxhash64("node", F.col("rep").cast("string"), F.lit(0))
    return nodes.groupBy("node").agg(F.count("*").alias("n"), F.min_by("rep", draw).alias("leader")).where("n > 1")


def unresolved(join: Join, nodes: DataFrame) -> DataFrame:
    """Rows of ``nodes`` (node, rep, ...) that hold several classes, with label and n."""
    marked = join.labelled(nodes)
    several = marked.groupBy("node").agg(F.count("*").alias("n"), F.min("label").alias("_lo"), F.max("label").alias("_hi"))
    return marked.join(several.where("_lo <> _hi").select("node", "n"), "node")


def neighbours(nodes: DataFrame) -> DataFrame:
    """All pairs (x, y) of different classes in each of the small ``nodes`` (node, rep, label)."""
    x = nodes.select("node", F.col("rep").alias("x"), F.col("label").alias("lx"))
    y = nodes.select("node", F.col("rep").alias("y"), F.col("label").alias("ly"))
    return x.join(y, "node").where("x < y and lx <> ly").select("x", "y")


def linked(marks: DataFrame, texts: DataFrame, kind: str, links: DataFrame) -> DataFrame | None:
    """(node, label) of the documents that are linked with another: ``marks`` (rep, signature), ``texts`` (rep, text),
    ``links`` (a, b) known before."""
    join = Join(marks, texts, kind, links)
    nodes, dense = branch(marks, trees(), kind), []
    for depth in range(1, DEEPEST + 1):
        nodes = written(nodes)
        live = written(nodes.join(leaders(nodes).select("node", "leader"), "node"))  # nodes with one document end here
        if live.isEmpty():
            break
        stars = live.select(F.col("rep").alias("x"), F.col("leader").alias("y"))
        if depth == 1:  # most links are found here, and resolve most nodes
            join.compare(stars, best_first=True)
        several = written(unresolved(join, live.select("node", "rep", "above")))
        pairs = neighbours(several.where(F.col("n") <= SMALL))
        join.compare(pairs if depth == 1 else pairs.unionByName(stars))
        large = several.where(F.col("n") > SMALL)
        alike = F.col("n") >= F.lit(DENSE) * F.coalesce("above", F.lit(float("inf")))
        if depth == 1:  # nothing above: a document is dense if so many of its tokens lead to large nodes
            alike = F.count("*").over(Window.partitionBy("rep")) >= DENSE * chosen(trees())
        large = written(large.select("node", "rep", "n", (~alike if depth < DEEPEST else F.lit(False)).alias("guest")))
        dense.append(only(large, "node", large.where("not guest").select("node").distinct()))
        ahead = large.where("guest")
        if ahead.isEmpty():
            break
        ahead = ahead.groupBy("rep").agg(F.collect_list(F.struct("node", "n")).alias("nodes"))  # a signature is read once
        nodes = branch(among(marks, "rep", ahead.select("rep")).join(ahead, "rep"), 0, kind)
    pool = written(reduce(DataFrame.unionByName, dense)) if dense else None
    if pool is not None and not pool.isEmpty():
        join.compare_all(written(unresolved(join, dense_pools(pool))))
    return join.labels


def first_rows(filled: DataFrame, rows: DataFrame) -> DataFrame:
    """(rep, signature) of each representative of ``rows`` (doc, d1, d2, rep, m): once, of ``m`` rows of ``filled``. Only the
    signatures of documents that may have a copy, a repeated row or another text are shuffled."""
    odd = rows.where("doc <> rep or m > 1").select("doc", "d1", "d2", "rep")
    plain = among(filled, "doc", odd.select("doc"), inside=False)
    firsts = among(rows.where("doc = rep").select("doc", "d1", "d2"), "doc", odd.select("doc"))
    others = among(filled, "doc", odd.select("doc")).join(firsts, ["doc", "d1", "d2"])  # an anti join would be moved before the bit set
    return plain.unionByName(others.dropDuplicates(["doc", "d1", "d2"])).select(F.col("doc").alias("rep"), "signature")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, ``n_shingles``, ``component_id`` (smallest id it is linked with, itself included,
    over any number of links), ``kept`` (its id is the component's).

    Null, empty or blank text has no shingles and no links. Rows that repeat an id are one document with several texts and
    link what any of them links; a row with a null id has no component and is kept. Other columns are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    all_marks = written(signatures(df, id_col, text_col))
    filled = all_marks.where(F.col("doc").isNotNull() & (F.col("n_shingles") > 0))
    reps = filled.groupBy("d1", "d2").agg(F.min("doc").alias("rep"))
    rows = filled.groupBy("doc", "d1", "d2").agg(F.count("*").alias("m")).join(reps, ["d1", "d2"])
    rows = written(rows.select("doc", "d1", "d2", "rep", "m"))
    member = rows.select("doc", "rep").distinct()
    marks = written(first_rows(filled, rows))
    texts = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("rep"), F.col(text_col))
    several = member.groupBy("doc").agg(F.min("rep").alias("a"), F.max("rep").alias("_b")).where("a <> _b")
    links = written(member.join(several, "doc").where("rep <> a").select("a", F.col("rep").alias("b")))
    labels = linked(marks, texts, kind, links)
    if labels is not None:
        labels = labels.select(F.col("node").alias("rep"), "label")
        member = member.join(labels, "rep", "left").select("doc", F.coalesce("label", "rep").alias("rep"))
    classes = member.groupBy("doc").agg(F.min("rep").alias("component_id"))
    out = all_marks.select("doc", "n_shingles").join(classes, "doc", "left")
    component = F.coalesce("component_id", "doc").alias("component_id")
    return out.select(F.col("doc").alias(id_col), "n_shingles", component, F.col("doc").eqNullSafe(F.coalesce("component_id", "doc")).alias("kept"))
