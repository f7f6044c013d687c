"""Benchmark decontamination by Wu-Manber multi-pattern search.

A pattern is one window of words of a benchmark item, in normal form: lower-case words between single spaces, one space
before and one behind. Patterns of like length share a table of shifts: the block of bytes that ends where the shortest
pattern would end tells how far the search may move on. Where it may not, the patterns whose first bytes end in that block
are compared. Many places of a batch of documents are searched side by side, each over a stretch of its own.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import by_size, bytes_of

WINDOW = 13
#: Text of benchmark items whose tables a task builds at once; more items are searched for in further blocks.
BLOCK_BYTES = 2 << 20
BATCH_BYTES = 4 << 20
STRETCH = 2048
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

#: A-Z become a-z; digits, a-z and all bytes of characters beyond ASCII stay; the rest separates words.
NORMAL = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)
RESULT = "n_words long, n_hit long, n_items long, items_sha256 string"


def words(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def windows(text: bytes, width: int) -> list[bytes]:
    """The patterns of one item."""
    w = words(text)
    if not w:
        return []
    return [b" %b " % b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]


class Tables:
    """Shift table and suffix buckets of patterns whose lengths differ by less than a factor of two."""

    def __init__(self, patterns: list[tuple[int, bytes]]):
        self.ids = [i for i, _ in patterns]
        self.patterns = [p for _, p in patterns]
        self.m = min(map(len, self.patterns))
        self.block = 8 if self.m >= 16 else 4 if self.m >= 8 else 2
        heads = np.frombuffer(b"".join(p[: self.m] for p in self.patterns), np.uint8).reshape(-1, self.m)
        steps = self.m - self.block + 1
        bits = int(np.clip(np.ceil(np.log2(4 * heads.shape[0] * steps)), 12, 22))
        self.down = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, steps, np.int32)
        for j in range(steps):  # ends ever nearer to the end of the head: smaller shifts are written last
            self.shift[self.slot(np.ascontiguousarray(heads[:, j : j + self.block]))] = steps - 1 - j
        last = self.slot(np.ascontiguousarray(heads[:, steps - 1 :]))
        order = np.argsort(last, kind="stable")
        self.members = order
        self.bucket_slots, self.bucket_starts = np.unique(last[order], return_index=True)
        self.bucket_ends = np.append(self.bucket_starts[1:], len(order))
        self.first = self.load(np.ascontiguousarray(heads[:, : self.block]))

    def load(self, rows: np.ndarray) -> np.ndarray:
        return rows.view(f"<u{self.block}").ravel().astype(np.uint64)

    def slot(self, rows: np.ndarray) -> np.ndarray:
        return (self.load(rows) * MULTIPLIER) >> self.down

    def search(self, text: bytes) -> tuple[list[int], list[int]]:
        """Starts of the patterns that occur, and the pattern's id."""
        n, m, size = len(text), self.m, self.block
        if n < m:
            return [], []
        blocks = np.ndarray((n - size + 1,), f"<u{size}", text, strides=(1,))
        begin = np.arange(0, n - m + 1, STRETCH)
        at, end = begin + m, np.minimum(begin + STRETCH, n - m + 1) + m
        stops = []
        while at.size:
            shift = self.shift[(blocks[at - size].astype(np.uint64) * MULTIPLIER) >> self.down]
            zero = shift == 0
            if zero.any():
                stops.append(at[zero])
            at = at + np.maximum(shift, 1)
            inside = at < end
            if not inside.all():
                at, end = at[inside], end[inside]
        if not stops:
            return [], []
        starts = np.concatenate(stops) - m
        slots = (blocks[starts + m - size].astype(np.uint64) * MULTIPLIER) >> self.down
        where = np.minimum(np.searchsorted(self.bucket_slots, slots), len(self.bucket_slots) - 1)
        real = self.bucket_slots[where] == slots
        starts, where = starts[real], where[real]
        counts = self.bucket_ends[where] - self.bucket_starts[where]
        owner = np.repeat(np.arange(len(starts)), counts)
        member = self.members[
            np.arange(len(owner)) + np.repeat(self.bucket_starts[where] - (np.cumsum(counts) - counts), counts)
        ]
        alike = blocks[starts[owner]].astype(np.uint64) == self.first[member]
        found, which = [], []
        for start, k in zip(starts[owner[alike]].tolist(), member[alike].tolist()):
            if text.startswith(self.patterns[k], start):
                found.append(start)
                which.append(self.ids[k])
        return found, which


class Block:
    """The patterns of some items, by length, and which items each belongs to."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        owners: dict[bytes, set[str]] = {}
        for item, text in items:
            for pattern in windows(text, width):
                owners.setdefault(pattern, set()).add(item)
        self.owners = list(owners.values())
        self.n_words = [p.count(b" ") - 1 for p in owners]
        by_length: dict[int, list[tuple[int, bytes]]] = {}
        for k, pattern in enumerate(owners):
            by_length.setdefault(len(pattern).bit_length(), []).append((k, pattern))
        self.tables = [Tables(p) for p in by_length.values()]

    def search(self, text: bytes) -> tuple[list[int], list[int]]:
        starts, which = [], []
        for tables in self.tables:
            a, b = tables.search(text)
            starts += a
            which += b
        return starts, which


@lru_cache(maxsize=8)
def _built(items: tuple, width: int) -> Block:
    return Block(list(items), width)


def judge(texts: list[bytes], blocks: list[tuple], width: int) -> list[tuple[int, int, int, str]]:
    """(n_words, n_hit, n_items, items_sha256) of each text; ``blocks`` hold (item id as text, item text)."""
    parts = [words(t) for t in texts]
    n_words = np.array([len(p) for p in parts], np.int64)
    joined = [b" %b " % b" ".join(p) if p else b"" for p in parts]
    del parts
    whole = b"\n".join(joined)
    ends = np.cumsum([len(j) + 1 for j in joined])
    names: list[set] = [set() for _ in texts]
    n_hit = np.zeros(len(texts), np.int64)
    cover, spaces = None, None
    for items in blocks:
        block = _built(items, width)
        starts, which = block.search(whole)
        if not starts:
            continue
        if cover is None:
            spaces = np.flatnonzero(np.frombuffer(whole, np.uint8) == 32)
            cover = np.zeros(len(spaces) + 1, np.int64)
        first = np.searchsorted(spaces, starts)  # a word goes by the space before it
        np.add.at(cover, first, 1)
        np.add.at(cover, first + np.array([block.n_words[k] for k in which]), -1)
        for doc, k in zip(np.searchsorted(ends, starts, side="right").tolist(), which):
            names[doc] |= block.owners[k]
    if cover is not None:
        hit = np.flatnonzero(np.cumsum(cover)[:-1] > 0)
        n_hit = np.bincount(np.searchsorted(ends, spaces[hit], side="right"), minlength=len(texts))
    digest = lambda ids: hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
    none = digest(())
    return [(int(w), int(h), len(ids), digest(ids) if ids else none) for w, h, ids in zip(n_words, n_hit, names)]


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> list[Broadcast]:
    """The items, a block at a time, as broadcasts of at most ``BLOCK_BYTES`` of text (or one longer item)."""
    context = benchmark.sparkSession.sparkContext
    rows = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    blocks, some, size = [], [], 0
    for row in rows.select(F.col(id_col).cast("string"), F.col(text_col)).toLocalIterator():
        text = row[1].encode()
        if some and size + len(text) > BLOCK_BYTES:
            blocks.append(context.broadcast(tuple(some)))
            some, size = [], 0
        some.append((row[0], text))
        size += len(text)
    return [*blocks, context.broadcast(tuple(some))] if some else blocks


def benchmark_hits(text: Column, blocks: list[Broadcast], width: int = WINDOW) -> Column:
    """Struct of ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` of a text column."""

    @F.arrow_udf(RESULT)
    def hits(column: pa.Array) -> pa.Array:
        texts, rows = bytes_of(column), []
        for a, b in by_size([len(t) for t in texts], BATCH_BYTES):
            rows += judge(texts[a:b], [x.value for x in blocks], width)
        columns = list(zip(*rows)) or [[], [], [], []]
        arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
        return pa.StructArray.from_arrays(arrays, ["n_words", "n_hit", "n_items", "items_sha256"])

    return hits(text)


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontaminate(
    df: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WINDOW,
) -> DataFrame:
    """One row per row of ``df``: id, ``n_words``, ``n_hit`` (words inside occurring windows), ``n_items``,
    ``items_sha256`` (of the sorted, comma-joined item ids), ``contaminated``.

    Null or empty text has no words and is clean. Items without an id or words have no windows; items that share windows
    all count, repeated items once. A null document id stays null; repeated rows are judged one by one; other columns
    are not read. Without items every document is clean.
    """
    hits = benchmark_hits(F.col(text_col), item_blocks(benchmark, item_col, item_text_col), width)
    columns = [F.col(f"_h.{c}") for c in ("n_words", "n_hit", "n_items", "items_sha256")]
    verdict = contaminated(F.col("_h.n_hit"), F.col("_h.n_words")).alias("contaminated")
    return df.select(F.col(id_col), hits.alias("_h")).select(id_col, *columns, verdict)
