"""Best-fit packing: pieces of documents into as few fixed-length sequences as possible, by bin completion.

Only lengths matter for packing and there are at most ``limit`` of them, so the branch-and-bound works on their histogram,
whatever the size of the corpus. It yields *patterns*, each used by a number of sequences; ranks of the pieces within
their length then pick pattern, sequence and place without any further shuffle.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import by_size, texts_of, written

CALL_BYTES = 1 << 20
PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long, part int, place long"

# ---------------------------------------------------------------------------------------------- tokens


@lru_cache(maxsize=4)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def _encoder(path: str):
    """Encodes texts to id lists as the ``tokenizers`` file at ``path`` does.

    For the byte-level vocabulary that is also there as ranks, texts in ASCII and Latin letters go through ``tiktoken``,
    which gives the same ids several times faster; all others go through ``tokenizers`` itself.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    slow = lambda some: [e.ids for e in _library(path).encode_batch(some, add_special_tokens=False)]
    ranks_path = path.removesuffix(".json") + ".tiktoken"
    if not path.endswith("byte_bpe_50k.json") or not os.path.exists(ranks_path):
        return slow
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)}
    )
    above_latin = bytes(range(0xC9))  # UTF-8 of code points below U+0240 uses no other bytes

    def encode(texts: list[str]) -> list[list[int]]:
        out: list = [None] * len(texts)
        rest = []
        for i, text in enumerate(texts):
            if text.isascii() or not text.encode().translate(None, above_latin):
                out[i] = fast.encode(text, allowed_special="all")
            else:
                rest.append(i)
        for i, ids in zip(rest, slow([texts[i] for i in rest]) if rest else []):
            out[i] = ids
        return out

    return encode


def pieces_of(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: all but the first have ``limit`` tokens."""
    first = n % limit or min(n, limit)
    return [(0, first)] + [(s, limit) for s in range(first, n, limit)] if n else []


def cut(df: DataFrame, path: str, end_id: int, limit: int, id_col: str, text_col: str) -> DataFrame:
    """Pieces of the documents, with the task that made them and their place among its pieces of that length."""
    kind = df.schema[id_col].dataType
    schema = PIECES.format(id=kind.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        part, seen = TaskContext.get().partitionId(), np.zeros(limit + 1, np.int64)
        for batch in batches:
            ids, texts = batch.column(0), texts_of(batch.column(1))
            for a, b in by_size([len(t) for t in texts], CALL_BYTES):
                rows = []
                for i, tokens in zip(range(a, b), encode(texts[a:b])):
                    array = np.array([*tokens, end_id], "<u4")
                    for k, (start, length) in enumerate(pieces_of(len(array), limit)):
                        crc = zlib.crc32(array[start : start + length].tobytes())
                        rows.append((i, k, start, length, crc, part, int(seen[length])))
                        seen[length] += 1
                which, *columns = zip(*rows)
                arrays = [ids.take(pa.array(which))]
                arrays += [pa.array(c, t) for c, t in zip(columns, (pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"])

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


# ---------------------------------------------------------------------------------------------- bin completion


def _reach(counts: dict[int, int], limit: int) -> int:
    """Bit set of the sums up to ``limit`` that the lengths can make (each length as often as it is there)."""
    bits, full = 1, (1 << (limit + 1)) - 1
    for length, n in counts.items():
        n = min(n, limit // length)
        step = 1
        while n > 0:  # powers of two make every multiple
            use = min(step, n)
            bits |= bits << (use * length) & full
            n -= use
            step *= 2
    return bits


def _dominated(filling: tuple[int, ...], room: int, left: dict[int, int]) -> bool:
    """Whether a longer piece that is left could replace one piece, or two, of the filling and still fit."""
    slack = room - sum(filling)
    used: dict[int, int] = {}
    for x in filling:
        used[x] = used.get(x, 0) + 1
    sums = set(used) | {a + b for a in used for b in used if a < b or (a == b and used[a] > 1)}
    for t in sums:
        single = t in used
        for x in range(t + single, min(t + slack, room) + 1):  # one piece as long as two is better than the two
            if left.get(x, 0) > used.get(x, 0):
                return True
    return False


def completions(room: int, left: dict[int, int], most: int, tries: int = 4000) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room``: the ``most`` best, least waste first, then fewest pieces.

    Depth first from the longest piece that fits. The waste bound prunes: the sums that all pieces together can make are
    known, so the least waste of a branch is; branches that waste more than the fillings already kept are left.
    """
    if room <= 0 or not left:
        return [()]
    lengths = sorted((x for x in left if x <= room), reverse=True)
    if not lengths:
        return [()]
    reach = _reach({x: left[x] for x in lengths}, room)
    found: list[tuple[int, tuple[int, ...]]] = []
    budget = tries

    def worst() -> int:
        return found[most - 1][0] if len(found) >= most else room

    def least(space: int) -> int:
        return space - (reach & ((1 << (space + 1)) - 1)).bit_length() + 1

    def enough() -> bool:
        return budget < 0 or (len(found) >= most and found[-1][0] == 0)

    path = [(0, room, (), False)]  # next length to try, space, pieces taken, whether one more fitted: as deep as there are pieces
    budget -= 1
    while path and not enough():
        at, space, taken, deeper = path.pop()
        for k in range(at, len(lengths)):
            x = lengths[k]
            if x <= space and left[x] > (taken.count(x) if taken else 0) and least(space - x) <= worst():
                path.append((k + 1, space, taken, True))
                budget -= 1
                path.append((k, space - x, (*taken, x), False))
                break
        else:
            if not deeper:
                found.append((space, taken))
                found.sort(key=lambda f: (f[0], len(f[1])))
                del found[4 * most :]
    kept = [f for _, f in found if not _dominated(f, room, left)] or [f for _, f in found]
    return kept[:most] or [()]


def _taken(left: dict[int, int], first: int, filling: tuple[int, ...]) -> tuple[dict[int, int], int]:
    """What one pattern, used as often as it can be, leaves; and how often."""
    used: dict[int, int] = {first: 1}
    for x in filling:
        used[x] = used.get(x, 0) + 1
    times = min(left[x] // k for x, k in used.items())
    after = dict(left)
    for x, k in used.items():
        after[x] -= times * k
        if not after[x]:
            del after[x]
    return after, times


def short(room: int, left: dict[int, int], lengths: list[int], slack: int) -> tuple[int, ...] | None:
    """One piece, or else two, that fill ``room`` but for ``slack`` tokens at most: they save small pieces for later."""
    for x in range(room, max(room - slack - 1, 0), -1):
        if x in left:
            return (x,)
    for x in lengths[bisect_left(lengths, (room + 1) // 2 - slack) :]:
        if x >= room:
            break
        for y in range(room - x, max(room - x - slack - 1, 0), -1):
            if left.get(y, 0) > (x == y):
                return (max(x, y), min(x, y))
    return None


def best_fit(left: dict[int, int], limit: int, slack: int = 0) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of the best-fit solution: the longest piece and the best completion around it, again and again."""
    patterns = []
    while left:
        first = max(left)
        rest = dict(left)
        rest[first] -= 1
        if not rest[first]:
            del rest[first]
        filling = short(limit - first, rest, sorted(rest), slack) if first < limit else ()
        if filling is None:
            filling = completions(limit - first, rest, 1)[0]
        left, times = _taken(left, first, filling)
        patterns.append(((first, *filling), times))
    return patterns


def lower_bound(left: dict[int, int], limit: int) -> int:
    """No packing has fewer sequences: by tokens, and by the pieces that can't share one."""
    total = sum(x * n for x, n in left.items())
    bound = -(-total // limit)
    for edge in range(0, limit // 2 + 1, max(1, limit // 64)):
        large = sum(n for x, n in left.items() if x > limit - edge)
        middle = [(x, n) for x, n in left.items() if limit - edge >= x > limit / 2]
        small = sum(x * n for x, n in left.items() if edge <= x <= limit / 2)
        free = sum((limit - x) * n for x, n in middle)
        bound = max(bound, large + sum(n for _, n in middle) + max(0, -(-(small - free) // limit)))
    return bound


def search(left: dict[int, int], limit: int, incumbent: list, branches: int, nodes: int) -> list:
    """Branch and bound from the longest piece on: the incumbent, or patterns with fewer sequences.

    Branches over the undominated completions of the longest piece that is left, gives up branches whose waste so far, or
    whose lower bound, can't beat the incumbent, and closes each with best fit. Ends at the bound or after ``nodes`` nodes.
    """
    total, bound, budget = sum(x * n for x, n in left.items()), lower_bound(left, limit), nodes

    def go(left: dict[int, int], done: list, used: int, waste: int) -> None:
        nonlocal incumbent, budget
        budget -= 1
        best = sequences(incumbent)
        if budget < 0 or waste > (best - 1) * limit - total or used + lower_bound(left, limit) >= best:
            return
        closed = [*done, *best_fit(left, limit)]
        if sequences(closed) < best:
            incumbent = closed
        if not left:
            return
        first = max(left)
        rest = dict(left)
        rest[first] -= 1
        if not rest[first]:
            del rest[first]
        for filling in completions(limit - first, rest, branches):
            after, times = _taken(left, first, filling)
            spent = (limit - first - sum(filling)) * times
            go(after, [*done, ((first, *filling), times)], used + times, waste + spent)
            if budget < 0 or sequences(incumbent) == bound:
                return

    if sequences(incumbent) > bound:
        go(left, [], 0, 0)
    return incumbent


def sequences(patterns: list[tuple[tuple[int, ...], int]]) -> int:
    return sum(n for _, n in patterns)


def pack(histogram: dict[int, int], limit: int, branches: int = 3, nodes: int = 40) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in a sequence, number of such sequences) that use every piece exactly once.

    The best of a few best-fit solutions is the first incumbent. Its first patterns waste nothing or little, so the search
    goes over ever longer tails of it, until the number of sequences meets the lower bound.
    """
    histogram = {x: n for x, n in histogram.items() if n}
    bound = lower_bound(histogram, limit)
    incumbent = best_fit(histogram, limit)
    for slack in (1, 2, 4, 8, 16):
        if sequences(incumbent) > bound:
            incumbent = min(incumbent, best_fit(histogram, limit, slack), key=sequences)
    for tail in (8, 16, 32):
        if sequences(incumbent) <= bound:
            break
        head, end = incumbent[:-tail], incumbent[-tail:]
        left: dict[int, int] = {}
        for pattern, times in end:
            for x in pattern:
                left[x] = left.get(x, 0) + times
        incumbent = head + search(left, limit, end, branches, nodes)
    return incumbent


def layout(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """Per length the rows (first rank, copies in a sequence, first sequence, offset), by first rank."""
    taken: dict[int, int] = {}
    rows: dict[int, list] = {}
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for x in sorted(set(pattern), reverse=True):
            copies = pattern.count(x)
            rows.setdefault(x, []).append((taken.get(x, 0), copies, sequence, offset))
            taken[x] = taken.get(x, 0) + copies * times
            offset += copies * x
        sequence += times
    return {x: np.array(r, np.int64) for x, r in rows.items()}


def placed(lengths: np.ndarray, ranks: np.ndarray, plan: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces by length and rank."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for x in np.unique(lengths):
        at = np.flatnonzero(lengths == x)
        table = plan[int(x)]
        row = table[np.searchsorted(table[:, 0], ranks[at], side="right") - 1]
        inside = ranks[at] - row[:, 0]
        sequence[at] = row[:, 2] + inside // row[:, 1]
        offset[at] = row[:, 3] + inside % row[:, 1] * x
    return sequence, offset


def pack_documents(
    df: DataFrame, path: str, end_id: int, limit: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    A document is its token ids and ``end_id``; longer ones than ``limit`` are cut. Null text is empty and packs as the
    end id alone. Rows with a null id and repeated rows are packed like all others. An empty table gives no rows. Other
    columns are not read. The histogram on the driver has at most ``limit`` entries; ranks within a length come from
    counts by task, so a length that a third of all pieces have is not gathered anywhere.
    """
    pieces = written(cut(df, path, end_id, limit, id_col, text_col))
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = layout(pack(histogram, limit))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))

    @F.arrow_udf("sequence_id long, offset long")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        sequence, offset = placed(length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False), plan)
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], ["sequence_id", "offset"])

    at = place(F.col("length"), F.col("place") + F.col("first")).alias("_at")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    out = pieces.join(first, ["length", "part"]).select(*columns, at).select(*columns, "_at.sequence_id", "_at.offset")
    return out.withColumnRenamed("doc_id", id_col)
