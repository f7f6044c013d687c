"""Phrases whose words belong together, by best-first branch and bound over prefixes.

Words are counted first, then pairs of frequent words. A phrase of three is an extension of its first pair, and its count is at
most the pair's: cut after one word, its score is at most ``SCALE * f(pair) / f(first word)``, which is known before any phrase
of three is counted; its last pair bounds it alike. So the frontier is expanded best first, a language at a time being no more
than a threshold in a table: in a round, only prefixes whose bound reaches the threshold are extended (one pass over the
texts), and so are pairs whose own score does, as their longer phrases decide whether they survive. A language is settled when
its surviving phrases at or above the threshold are as many as wanted: everything not expanded scores less than the last of
them, ties included. For the others the threshold sinks, to zero at the end.

The texts are searched with bit sets of fixed size made from the tables of words and pairs. They hold back most of what can't
count before the shuffle and may let more through, which the exact counts then drop.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import bytes_of, mixed, written
from .wordids import WordIds, slices

SCALE = 1_000_000
#: Bits of a bit set (4 MB), and how many times the wanted phrases a round's threshold is aimed at; then no threshold.
FILTER_BITS, DEPTHS = 25, (4, 32)
FEW_LANGUAGES = 10_000
LOWERED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
BREAK = re.compile(rb"[ \n]")
NOTHING, END = 0, 1  # the numbers of the empty word and of a break between pieces
GRAMS = "xyz"


class Words:
    """The words of some texts of one language as numbers, in order, with breaks between pieces and texts."""

    def __init__(self, lang: str, texts: list[bytes]):
        ids = WordIds(b"", b"\n")
        parts = [np.array([END])]
        for text in texts:
            for piece in slices(text.translate(LOWERED), BREAK):
                parts.append(ids.of(piece.replace(b"\n", b" \n ").split(b" ")))
            parts.append(np.array([END]))
        words = np.concatenate(parts)
        self.lang, self.of = lang, words[words != NOTHING]
        self.known = ids.words()
        self.hash = ids.hashes(salt(lang))[:, 0]
        self.strings = pa.array(self.known, pa.binary()).cast(pa.string())

    def rows(self, counts: np.ndarray, *words: np.ndarray) -> pa.RecordBatch:
        lang = pa.repeat(pa.scalar(self.lang, pa.string()), len(counts))
        columns = [lang, *(self.strings.take(pa.array(w)) for w in words), pa.array(counts, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["lang", *GRAMS[: len(words)], "f"])

    def singles(self) -> pa.RecordBatch:
        counts = np.bincount(self.of, minlength=len(self.known))
        counts[: END + 1] = 0
        words = np.flatnonzero(counts)
        return self.rows(counts[words], words)

    def neighbours(self, allowed: np.ndarray) -> np.ndarray:
        """Places of pairs of allowed words."""
        fine = allowed[self.of]
        return np.flatnonzero(fine[:-1] & fine[1:])

    def pairs(self, frequent: np.ndarray) -> pa.RecordBatch:
        allowed = has(frequent, self.hash)
        allowed[: END + 1] = False
        at = self.neighbours(allowed)
        keys, counts = np.unique((self.of[at] << 32) | self.of[at + 1], return_counts=True)
        return self.rows(counts, keys >> 32, keys & 0xFFFFFFFF)

    def triples(self, sets: dict[str, np.ndarray]) -> pa.RecordBatch:
        allowed = np.ones(len(self.known), bool)
        allowed[: END + 1] = False
        at = self.neighbours(allowed)
        keys, which = np.unique((self.of[at] << 32) | self.of[at + 1], return_inverse=True)
        hashes = pair_hash(self.hash[keys >> 32], self.hash[keys & 0xFFFFFFFF])
        flag = {name: has(bits, hashes)[which] for name, bits in sets.items()}
        i = np.flatnonzero(np.diff(at) == 1)  # the pair at i and the next share a word
        j = i + 1
        wanted = (flag["settles"][i] & flag["frequent"][j]) | (flag["frequent"][i] & flag["settles"][j]) | (flag["prefix"][i] & flag["suffix"][j])
        i = i[wanted]
        both, counts = np.unique((which[i].astype(np.int64) << 32) | which[i + 1], return_counts=True)
        first, second = keys[both >> 32], keys[both & 0xFFFFFFFF]
        return self.rows(counts, first >> 32, second >> 32, second & 0xFFFFFFFF)


def salt(lang: str) -> bytes:
    return lang.encode() + b"\n"


def pair_hash(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return mixed(x * np.uint64(0x9E3779B97F4A7C15) + y)


def place(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - FILTER_BITS)


def has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = place(hashes)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def bit_set(df: DataFrame, columns: str) -> np.ndarray:
    """Bits of the words or pairs of ``df`` (lang and ``columns``): a fixed size, however many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = []
            for lang, *words in zip(*(batch.column(c).to_pylist() for c in ("lang", *columns))):
                ids = WordIds()
                at = ids.of([w.encode() for w in words])
                own = ids.hashes(salt(lang))[:, 0][at]
                hashes.append(own[0] if len(own) == 1 else pair_hash(own[:1], own[1:])[0])
            yield pa.RecordBatch.from_arrays([pa.array(place(np.array(hashes, np.uint64)).astype(np.int64))], ["at"])

    places = df.select("lang", *columns).mapInArrow(run, "at long")
    words = places.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), "<i8")
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint8)


def counted(texts: DataFrame, size: int, sets: dict[str, np.ndarray]) -> DataFrame:
    """(lang, words, f): contiguous occurrences of ``size`` words that the bit sets let through."""
    shared = texts.sparkSession.sparkContext.broadcast(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), bytes_of(batch.column(1))):
                by_lang.setdefault(lang, []).append(text)
            for lang, own in by_lang.items():
                words = Words(lang, own)
                if size == 1:
                    yield words.singles()
                elif size == 2:
                    yield words.pairs(shared.value["word"])
                else:
                    yield words.triples(shared.value)

    columns = list(GRAMS[:size])
    found = texts.select("lang", "text").mapInArrow(run, "lang string, " + "".join(f"{c} string, " for c in columns) + "f long")
    return found.groupBy("lang", *columns).agg(F.sum("f").alias("f"))


def score(a: str, left: str, right: str) -> Column:
    """floor(SCALE * a * a / (left * right)), exact: counts below 10^15 keep products within 38 digits."""
    d = "decimal(15,0)"
    return F.expr(f"(cast({a} as {d}) * cast({a} as {d}) * {SCALE}) div (cast({left} as {d}) * cast({right} as {d}))")


def reaches(a: str, whole: str) -> Column:
    """floor(SCALE * a / whole) >= least, exact."""
    return F.expr(f"{SCALE} * cast({a} as decimal(15,0)) >= least * cast({whole} as decimal(15,0))")


def scored_pairs(counts: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, x, y, f, fx, fy, score) of pairs."""
    fx = words.select("lang", "x", F.col("f").alias("fx"))
    fy = words.select("lang", F.col("x").alias("y"), F.col("f").alias("fy"))
    return counts.join(fx, ["lang", "x"]).join(fy, ["lang", "y"]).select("lang", "x", "y", "f", "fx", "fy", score("f", "fx", "fy").alias("score"))


def scored_triples(counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(lang, x, y, z, f, l, r, score): the lowest cut, of equal ones the first."""
    front = pairs.select("lang", "x", "y", "fx", F.col("f").alias("fxy"))
    back = pairs.select("lang", F.col("x").alias("y"), F.col("y").alias("z"), F.col("f").alias("fyz"), F.col("fy").alias("fz"))
    rows = counts.join(front, ["lang", "x", "y"]).join(back, ["lang", "y", "z"])
    rows = rows.withColumn("s1", score("f", "fx", "fyz")).withColumn("s2", score("f", "fxy", "fz"))
    first = F.col("s1") <= F.col("s2")
    lowest = {"l": F.when(first, F.col("fx")).otherwise(F.col("fxy")), "r": F.when(first, F.col("fyz")).otherwise(F.col("fz")), "score": F.least("s1", "s2")}
    return rows.select("lang", "x", "y", "z", "f", *(c.alias(k) for k, c in lowest.items()))


def per_language(df: DataFrame) -> DataFrame:
    """A table with a row per language, to be joined without dealing the other side out by language: broadcast while the
    languages are few, which is checked, and joined as any table beyond."""
    rows = written(df)
    return F.broadcast(rows) if rows.count() <= FEW_LANGUAGES else rows


def thresholds(pairs: DataFrame, depth: int | None) -> DataFrame:
    """(lang, least): the score of the ``depth``-th pair of each language; 0 where there are fewer, or without a depth."""
    if depth is None:
        return pairs.select("lang", F.lit(0).cast("long").alias("least")).distinct()
    ranked = pairs.select("lang", "score", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"))).alias("i"))
    best = ranked.where(F.col("i") <= depth).groupBy("lang").agg(F.min("score").alias("low"), F.count("*").alias("n"))
    return best.select("lang", F.when(F.col("n") < depth, 0).otherwise(F.col("low")).cast("long").alias("least"))


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", top: int = 2000, least_count: int = 10, share: int = 50, depths: tuple[int, ...] = DEPTHS
) -> DataFrame:
    """The ``top`` phrases of two or three words of each language: (lang, rank, phrase, a, l, r, n, score).

    Texts are lower-cased (A-Z), cut at ``.,;:!?`` and line ends, and split at spaces and tabs. A phrase with ``a`` >=
    ``least_count`` occurrences scores floor(1000000 a a / (l r)) at its lowest cut; a pair inside a phrase of three with at
    least ``share`` percent of its occurrences is dropped. Order: score, a (both descending), phrase in byte order. Null
    texts are empty; a null language is ``und``. Rows that repeat count as often as they are there. Other columns aren't
    looked at. A language without such phrases, and an empty table, give no rows.
    """
    texts = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text"))
    words = written(counted(texts, 1, {}))
    totals = per_language(words.groupBy("lang").agg(F.sum("f").alias("n")))
    frequent = words.where(F.col("f") >= least_count)
    counts = counted(texts, 2, {"word": bit_set(frequent, "x")}).where(F.col("f") >= least_count)
    pairs = written(scored_pairs(counts, frequent))
    known = bit_set(pairs, "xy")
    unsettled, found = pairs, None
    for depth in (*(d * top for d in depths), None):
        low = per_language(thresholds(unsettled, depth))
        rows = unsettled.join(low, "lang")
        marks = [reaches("f", "fx").alias("prefix"), reaches("f", "fy").alias("suffix"), (F.col("score") >= F.col("least")).alias("settles")]
        marked = written(rows.select(*unsettled.columns, "least", *marks))
        sets = {name: bit_set(marked.where(name), "xy") for name in ("prefix", "suffix", "settles")} | {"frequent": known}
        triples = written(scored_triples(counted(texts, 3, sets).where(F.col("f") >= least_count), pairs))
        survivors = written(surviving(marked, triples, low, share))
        enough = survivors.groupBy("lang").agg(F.count("*").alias("n"))
        state = low.join(enough, "lang", "left").select("lang", ((F.col("least") == 0) | (F.coalesce("n", F.lit(0)) >= top)).alias("settled"))
        state = written(state)
        own = survivors.join(per_language(state.where("settled").select("lang")), "lang", "left_semi")
        found = own if found is None else found.unionByName(own)
        again = per_language(state.where("not settled").select("lang"))
        if again.isEmpty():
            break
        unsettled = pairs.join(again, "lang", "left_semi")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def surviving(pairs: DataFrame, triples: DataFrame, low: DataFrame, share: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) at or above each language's threshold, without pairs that a longer phrase holds."""
    inside = triples.select("lang", "x", "y", "f").unionByName(triples.select("lang", F.col("y").alias("x"), F.col("z").alias("y"), "f"))
    longest = inside.groupBy("lang", "x", "y").agg(F.max("f").alias("longer"))
    left = pairs.where("settles").join(longest, ["lang", "x", "y"], "left").where(F.coalesce(100 * F.col("longer") < share * F.col("f"), F.lit(True)))
    two = left.select("lang", F.concat_ws(" ", "x", "y").alias("phrase"), F.col("f").alias("a"), F.col("fx").alias("l"), F.col("fy").alias("r"), "score")
    three = triples.join(low, "lang").where(F.col("score") >= F.col("least"))
    return two.unionByName(three.select("lang", F.concat_ws(" ", "x", "y", "z").alias("phrase"), F.col("f").alias("a"), "l", "r", "score"))
