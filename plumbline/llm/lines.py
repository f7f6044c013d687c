"""Line dedup: range-partitioned line hashes, streamed in order of hash and document, give per-document bitmaps.

Texts stay where they are. A document sends one row per distinct line key: 128 bits of hash, its id and the line numbers.
Rows are range-partitioned by hash and document, so even one key's rows spread over several tasks, and sorted. One pass
over the order counts the documents of each key and passes on the lines to drop; keys that may go on in the neighbouring
partition leave a few open rows and one sum per partition, which are settled together afterwards.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import bytes_of, partitions, texts_of, written

SPACES = b" \t\n\v\f\r"
MIN_CHARS, MIN_DOCS = 20, 3
ROW = "h1 long, h2 long, doc {id}, version long, lines binary"
DECISION = ROW + ", kind int, n_docs long"
DROP, OPEN, SUM = 0, 1, 2


def keys(text: bytes, min_chars: int) -> dict[bytes, list[int]]:
    """Line numbers of each key that is long enough."""
    found: dict[bytes, list[int]] = {}
    for i, line in enumerate(text.split(b"\n")):
        key = line.strip(SPACES).lower()  # lower() of bytes changes A-Z only
        if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
            found.setdefault(key, []).append(i)
    return found


def hashed(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """One row per row of ``df`` and key. ``version`` tells apart rows with one id but different texts."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, high, low, lines = [], [], [], []
            for i, text in enumerate(bytes_of(batch.column(2))):
                for key, numbers in keys(text, min_chars).items():
                    h = xxhash.xxh3_128_intdigest(key)
                    which.append(i)
                    high.append(h >> 64)
                    low.append(h & 0xFFFFFFFFFFFFFFFF)
                    lines.append(np.array(numbers, "<i4").tobytes())
            at = pa.array(which, pa.int64())
            longs = [pa.array(np.array(h, np.uint64).view(np.int64)) for h in (high, low)]
            arrays = [*longs, batch.column(0).take(at), batch.column(1).take(at), pa.array(lines, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["h1", "h2", "doc", "version", "lines"])

    rows = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, ROW.format(id=kind))


def streamed(rows: DataFrame, min_docs: int) -> DataFrame:
    """Decisions of one pass over rows sorted by hash and document.

    A row is dropped once its key has ``min_docs`` documents or more in this partition and a later document among them.
    Of the first and the last key of the partition, rows not dropped stay open, and a sum tells how many documents the
    key has here and the last of them.
    """
    kind = rows.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, carried, first = None, 0, True  # rows of the key not ended yet; its documents already passed on

        def decide(table: pa.Table, n_before: int, last: bool):
            """Decisions of all keys but the last one (``last``: of all); the last key's rows and documents so far."""
            nonlocal first
            h1, h2 = (table.column(c).to_numpy() for c in ("h1", "h2"))
            docs = table.column("doc").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            n = len(docs)
            key_new = np.ones(n, bool)
            key_new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            doc_new = key_new.copy()
            doc_new[1:] |= docs[1:] != docs[:-1]
            begin = np.flatnonzero(key_new)
            key = np.cumsum(key_new) - 1
            n_docs = np.bincount(key[doc_new], minlength=len(begin))
            n_docs[0] += n_before
            doc = np.cumsum(doc_new) - 1
            last_doc = doc[np.append(begin[1:], n) - 1]
            drop = (n_docs[key] >= min_docs) & (doc < last_doc[key])
            closed = key < len(begin) - 1 if not last else np.ones(n, bool)
            edge = np.zeros(len(begin), bool)
            if first and (closed.any() or last):
                edge[0], first = True, False
            if last:
                edge[-1] = True
            still = edge[key] & ~drop
            kinds = np.full(n, -1)
            kinds[drop] = DROP
            kinds[still & closed] = OPEN
            counts = np.zeros(n, np.int64)
            out = [(np.flatnonzero(kinds >= 0), kinds, counts)]
            ends = np.append(begin[1:], n)[edge & (closed[begin])] - 1  # the last row stands for the key
            sums, totals = np.full(n, SUM), n_docs[key]
            out.append((ends, sums, totals))
            for at, k, c in out:
                if len(at):
                    part = table.take(pa.array(at))
                    yield part.append_column("kind", pa.array(k[at], pa.int32())).append_column("n_docs", pa.array(c[at]))
            if not last:
                rest = np.flatnonzero(~closed & ~drop)
                passed = int(n_docs[-1]) - len(np.unique(doc[rest]))
                yield table.take(pa.array(rest)), passed

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if carry is not None:
                table = pa.concat_tables([carry, table])
            for part in decide(table, carried, False):
                if isinstance(part, tuple):
                    carry, carried = part
                else:
                    yield from part.to_batches()
        if carry is not None:
            for part in decide(carry, carried, True):
                yield from part.to_batches()

    return rows.mapInArrow(run, DECISION.format(id=kind))


def dropped(df: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """(doc, version, lines): the line numbers each document loses, as it is found."""
    spark = df.sparkSession
    rows = written(hashed(df, id_col, text_col, min_chars))
    ordered = rows.repartitionByRange(partitions(spark), "h1", "h2", "doc").sortWithinPartitions("h1", "h2", "doc")
    decisions = written(streamed(ordered, min_docs))
    keys_of = ["h1", "h2"]
    sums = decisions.where(F.col("kind") == SUM).groupBy(keys_of).agg(F.sum("n_docs").alias("n"), F.max("doc").alias("last"))
    open_rows = decisions.where(F.col("kind") == OPEN).drop("n_docs").join(sums, keys_of)
    late = open_rows.where((F.col("n") >= min_docs) & (F.col("doc") < F.col("last")))
    columns = ["doc", "version", "lines"]
    return decisions.where(F.col("kind") == DROP).select(columns).unionByName(late.select(columns))


def bitmap(lists: pa.Array) -> pa.Array:
    """Compressed keep bitmap of a document from its dropped line numbers; lines past its end are kept."""
    out = []
    for lines in lists.to_pylist():
        numbers = np.frombuffer(b"".join(lines), "<i4")
        keep = np.ones((int(numbers.max()) // 8 + 1) * 8, bool)
        keep[numbers] = False
        out.append(zlib.compress(np.packbits(keep).tobytes(), 1))
    return pa.array(out, pa.binary())


def keep_bitmaps(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """(id, ``version``, ``keep``) of the documents that lose a line; ``version`` is Spark's xxhash64 of the text.

    The key of a line is the line without the ASCII white space at its ends, A-Z in lower case. A key of ``min_chars``
    characters or more in ``min_docs`` documents or more loses all its lines but those in its largest document id.
    Rows with a null id or text neither count nor lose lines; rows that repeat an id count as one document.
    """
    lists = dropped(df, id_col, text_col, min_chars, min_docs).groupBy("doc", "version").agg(F.collect_list("lines").alias("l"))
    return lists.select(F.col("doc").alias(id_col), "version", F.arrow_udf(bitmap, "binary")("l").alias("keep"))


def kept_lines(text: bytes, keep: bytes | None) -> tuple[list[bytes], int]:
    """The lines that stay, and the number of all lines."""
    lines = text.split(b"\n")
    if keep is None:
        return lines, len(lines)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[: len(lines)]
    return [line for i, line in enumerate(lines) if i >= len(bits) or bits[i]], len(lines)


def kept_text(text: Column, keep: Column) -> Column:
    @F.arrow_udf("string")
    def apply(texts: pa.Array, bitmaps: pa.Array) -> pa.Array:
        pairs = zip(texts.to_pylist(), bitmaps.to_pylist())
        return pa.array(
            [t if k is None or t is None else b"\n".join(kept_lines(t.encode(), k)[0]).decode() for t, k in pairs], pa.string()
        )

    return apply(text, keep)


def summary(texts: pa.Array, bitmaps: pa.Array) -> pa.Array:
    rows = []
    for text, keep in zip(texts_of(texts), bitmaps.to_pylist()):
        raw = text.encode()
        if keep is None:
            rows.append((raw.count(b"\n") + 1, 0, hashlib.sha256(raw).hexdigest()))
        else:
            lines, n = kept_lines(raw, keep)
            rows.append((n, n - len(lines), hashlib.sha256(b"\n".join(lines)).hexdigest()))
    columns = list(zip(*rows)) or [[], [], []]
    arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()))]
    return pa.StructArray.from_arrays(arrays, ["n_lines", "n_dropped", "kept_sha256"])


def with_bitmaps(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``_row``: struct of all columns of ``df``, ``_keep``: bitmap or null)."""
    bitmaps = keep_bitmaps(df, id_col, text_col).select(F.col(id_col).alias("_id"), F.col("version").alias("_v"), F.col("keep").alias("_keep"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    same = (F.col(f"_row.{id_col}") == F.col("_id")) & (F.xxhash64(f"_row.{text_col}") == F.col("_v"))
    return rows.join(bitmaps.hint("shuffle_hash"), same, "left").select("_row", "_keep")


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, ``n_lines``, ``n_dropped``, ``kept_sha256`` of the lines that stay, joined by \\n.

    Null or empty text is one empty line, which stays. See ``keep_bitmaps`` for keys, null ids and repeated rows. Other
    columns are not read. An empty table gives no rows.
    """
    rows = with_bitmaps(df.select(id_col, text_col), id_col, text_col)
    summed = F.arrow_udf(summary, "n_lines long, n_dropped long, kept_sha256 string")
    out = rows.select(F.col(f"_row.{id_col}"), summed(F.col(f"_row.{text_col}"), "_keep").alias("_s"))
    return out.select(id_col, "_s.n_lines", "_s.n_dropped", "_s.kept_sha256")


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the texts that stay; null texts stay null."""
    rows = with_bitmaps(df, id_col, text_col)
    columns = [
        (kept_text(F.col(f"_row.{c}"), F.col("_keep")) if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in df.columns
    ]
    return rows.select(*columns)
