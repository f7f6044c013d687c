"""Repeated windows, phrases and hard negatives against plain Python, on rows with every odd case."""

import random
from collections import Counter

import numpy as np
import pytest
from plain import negatives, phrases, prose, without_windows

from plumbline.llm import collocations, countmin, hardneg
from plumbline.llm.wordids import WordIds, rolled, slices


def got(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("width", [1, 2, 3, 5, 7, 8, 20])
def test_rolled_hashes_are_the_polynomials(width):
    x = np.random.default_rng(1).integers(0, 1 << 63, 60).astype(np.uint64)
    want = [sum(int(x[i + j]) * pow(77, width - 1 - j) for j in range(width)) % (1 << 64) for i in range(60 - width + 1)]
    assert rolled(x, width, 77).tolist() == want
    assert len(rolled(x[: width - 1], width, 77)) == 0


def test_slices_keep_words_whole():
    data = b" ".join([b"abc"] * 50) + b"  " + b"x" * 40
    assert b"".join(slices(data, countmin.SPACE, 7)) == data
    assert [w for s in slices(data, countmin.SPACE, 7) for w in s.split()] == data.split()
    assert WordIds(b"a").of([b"b", b"a", b"b"]).tolist() == [1, 0, 1]


@pytest.mark.parametrize("unit_bytes, shard_windows", [(1 << 20, 1 << 20), (700, 300)])
def test_repeated_windows(docs, rows, unit_bytes, shard_windows):
    out = countmin.without_repeats(docs, 20, unit_bytes=unit_bytes, shard_windows=shard_windows)
    want = Counter((d, k, n, g) for (d, _), (n, g, k) in zip(rows, without_windows(rows, 20)))
    assert got(out.select("doc_id", "text", "n_words", "n_removed")) == want
    assert sum(g > 0 for _, _, _, g in want) > 10


def test_crowded_sketch_loses_nothing(spark, rows, docs, monkeypatch):
    monkeypatch.setattr(countmin, "MOST_ROW_BITS", 3)  # every window is estimated repeated
    out = countmin.without_repeats(docs.coalesce(2), 20, unit_bytes=5000)
    want = Counter((d, n, g) for (d, _), (n, g, _) in zip(rows, without_windows(rows, 20)))
    assert got(out.select("doc_id", "n_words", "n_removed")) == want


def test_text_ids_and_no_rows(spark, docs, rows, none):
    out = countmin.without_repeats(docs.selectExpr("cast(doc_id as string) as doc_id", "text"), 20)
    named = [(None if d is None else str(d), t) for d, t in rows]
    want = Counter((d, n, g) for (d, _), (n, g, _) in zip(named, without_windows(named, 20)))
    assert got(out.select("doc_id", "n_words", "n_removed")) == want
    assert countmin.without_repeats(none, 20).count() == 0


def phrase_rows():
    r = random.Random(5)
    vocabulary = prose(60, 3).split()
    fixed = [f"{a} {b}" for a, b in zip(prose(12, 8, "uvw").split(), prose(12, 9, "xyz").split())] + ["New York city", "é ü", "ab\tab ab ab"]
    rows = [(None, "en"), ("", "en"), (" . ,;", None), ("x" * 3000, "de"), (None, None)]
    for i in range(160):
        words = [r.choice(fixed) if r.random() < 0.3 else r.choice(vocabulary) + r.choice(["", "", ".", "\n", ","]) for _ in range(40)]
        rows.append((" ".join(words), ["en", "de", None][i % 3]))
    return rows + rows[-8:]


@pytest.mark.parametrize("top, least, depths", [(2000, 5, (4, 32)), (7, 5, (1, 2, 4)), (20, 3, (1,)), (3, 4, (2, 8))])
def test_phrases(spark, top, least, depths):
    rows = phrase_rows()
    docs = spark.createDataFrame([(t, lang, "x", i) for i, (t, lang) in enumerate(rows)], "text string, lang string, phrase string, f int").repartition(4)
    want = Counter(phrases(rows, top, least))
    assert got(collocations.collocations(docs, top=top, least_count=least, depths=depths)) == want
    assert len({lang for lang, *_ in want}) == 3


def test_phrases_with_full_filters(spark, monkeypatch):
    monkeypatch.setattr(collocations, "has", lambda bits, hashes: np.ones(len(hashes), bool))
    rows = phrase_rows()[:40]
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert got(collocations.collocations(docs, top=50, least_count=3)) == Counter(phrases(rows, 50, 3))
    assert collocations.collocations(docs.limit(0)).count() == 0


def vectors(n=400, dim=24, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 40, (6, dim // 4)).repeat(4, axis=1)  # segments differ in their means
    rows = [(i, int(i % 6), (centres[i % 6] * r.uniform(0.5, 1.1) + r.normal(0, 12, dim)).astype(int).tolist()) for i in range(n)]
    rows += [(n + i, i % 3, rows[0][2]) for i in range(9)]  # ties
    rows += [(None, 1, rows[1][2]), (n + 20, None, rows[1][2]), (n + 21, 1, None), (n + 22, 1, [1, None]), (n + 23, 1, []), (n + 24, 2, rows[3][2][:5])]
    return rows + [(5, 3, rows[7][2]), (5, 3, rows[7][2]), rows[10], rows[10]]


@pytest.mark.parametrize("block_rows, anchor_bytes", [(2048, 4 << 20), (50, 2000)])
def test_hard_negatives(spark, block_rows, anchor_bytes, monkeypatch):
    monkeypatch.setattr(hardneg, "TILE", 16)
    rows = vectors()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<long>, query string").repartition(3)
    out = hardneg.hard_negatives(df, "id % 10 = 0", block_rows=block_rows, anchor_bytes=anchor_bytes)
    want = Counter(negatives(rows, lambda a: a % 10 == 0))
    assert got(out) == want
    assert len(want) > 200
    assert hardneg.hard_negatives(df.limit(0), "id % 10 = 0").count() == 0


def test_scores_beyond_doubles(spark):
    rows = [(i, i % 2, [(1 << 31) + i, 3 * i, -(1 << 30)]) for i in range(30)] + [(100 + i, i % 2, [1 << 62, i, -i]) for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<long>")
    assert got(hardneg.hard_negatives(df, "id % 5 = 0")) == Counter(negatives(rows, lambda a: a % 5 == 0))


def test_bounds_hold_and_prune():
    rows = [r for r in vectors() if r[1] is not None and r[2] and None not in r[2] and len(r[2]) == 24]
    import pyarrow as pa

    data = hardneg.padded(pa.array([v for _, _, v in rows]))
    means, deviations = hardneg.summaries(data)
    row = {"n": len(data), "dim": data.shape[1], "kind": data.dtype.str, "ids": np.arange(len(data)).astype("<i8").tobytes(), "labels": [""] * len(data)}
    block = hardneg.Block(row | {"data": data.tobytes(), "means": means.tobytes(), "deviations": deviations.tobytes()})
    exact = data.astype(np.int64) @ data.astype(np.int64).T
    widths = []
    for m, d in block.features():
        middle, spread = m @ m.T, d @ d.T
        assert (exact <= middle + spread + 1e-6).all() and (exact >= middle - spread - 1e-6).all()
        widths.append(spread.mean())
    assert widths[0] > widths[1] > widths[2]
