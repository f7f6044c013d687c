"""Operators on documents against plain Python, on rows with every odd case."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from plain import base_counts, bench_words, components, edited, hits, line_dedup, prose, removed, sha, shingles
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, lines, neardup, packing, quality, suffixes, tokens
from plumbline.llm.queries import vocabulary


def got(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_token_counts(docs, rows, none):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = [len(model.encode(t or "")) for _, t in rows]
    want = Counter((d, len((t or "").encode()), k, k > 300) for (d, t), k in zip(rows, n))
    assert got(tokens.count_tokens(docs, path, 300), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert tokens.count_tokens(none, path, 300).count() == 0
    words = vocabulary("word_bpe_49k.json")
    assert tokens.count_tokens(docs, words, 300).count() == len(rows)


@pytest.mark.parametrize("text", ["a  b " * 900, "x" * 9000, "<s> </s> ▁▁ a▁ b " * 400, "\n\t " * 3000, "日本 語\x00 " * 900, " " * 5000])
def test_cut_texts_have_the_same_tokens(text):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for limit in (1, 7, 100):
        assert sum(len(model.encode(p)) for p in tokens.cut(text, limit)) == len(model.encode(text))
    assert tokens.count([text], path)[0] == len(model.encode(text))


def library_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_fast_ids_are_the_library_s():
    latin = [f"{a}{chr(c)}{b} {chr(c)}{chr(c)} 1{chr(c)}" for c in range(0x250) for a, b in (("x", "y"), (" ", "\n"))]
    odd = ["<|endoftext|>a <|endoftext|>", "it's I'LL we'd  \n\n x", "日本語 text", "ͅ²   \U0001f600", "\r\n  \u0085 z"]
    assert packing._encoder(vocabulary("byte_bpe_50k.json"))(latin + odd) == library_ids(latin + odd)


def test_packing(docs, rows, none):
    path = vocabulary("byte_bpe_50k.json")
    out = packing.pack_documents(docs, path, 2, 256).toPandas()
    whole = [np.array([*ids, 2], "<u4") for ids in library_ids([t for _, t in rows])]
    want = Counter()
    for (d, _), ids in zip(rows, whole):
        cuts = [0, *range(len(ids) % 256 or min(256, len(ids)), len(ids), 256), len(ids)]
        want.update((d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    made = zip(*(out[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")))
    assert Counter((None if math.isnan(d) else int(d), *r) for d, *r in made) == want
    for _, sequence in out.sort_values("offset").groupby("sequence_id"):
        assert sequence.offset.tolist() == [0, *sequence.length.cumsum()[:-1]]
        assert sequence.length.sum() <= 256
    assert out.sequence_id.nunique() <= -(-out.length.sum() // 256) + 1
    assert packing.pack_documents(none, path, 2, 256).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_patterns_use_every_piece(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 101, rng.integers(1, 300)).tolist()
    patterns = packing.pack(dict(Counter(lengths)), 100)
    used = Counter()
    for pattern, n in patterns:
        assert sum(pattern) <= 100
        for x in pattern:
            used[x] += n
    assert used == Counter(lengths)
    n = packing.sequences(patterns)
    bound = packing.lower_bound(dict(Counter(lengths)), 100)
    assert bound <= n <= bound + 2


def optimum(items, room):
    """Fewest bins, by trying every placement."""
    items = sorted(items, reverse=True)
    best = len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for k in {b: j for j, b in enumerate(bins)}.values():
            if bins[k] >= items[i]:
                go(i + 1, [*bins[:k], bins[k] - items[i], *bins[k + 1 :]])
        go(i + 1, [*bins, room - items[i]])

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(12))
def test_packing_is_optimal_on_small_sets(seed):
    items = np.random.default_rng(seed).integers(10, 70, 11).tolist()
    assert packing.sequences(packing.pack(dict(Counter(items)), 100)) == optimum(items, 100)


@pytest.mark.parametrize("histogram", [{1: 5000}, {1: 5000, 2: 3, 1020: 2}, {1: 1500, 1024: 4, 700: 3}])
def test_many_pieces_of_one_token(histogram):
    patterns = packing.pack(histogram, 1024)
    used = Counter()
    for pattern, n in patterns:
        assert sum(pattern) <= 1024
        used.update({x: n * k for x, k in Counter(pattern).items()})
    assert used == histogram
    assert packing.sequences(patterns) == packing.lower_bound(histogram, 1024)


def test_decontamination(spark, docs, rows, none):
    texts = dict(rows)
    items = [(1, texts[30][:400]), (2, None), (3, ""), (4, "One"), (5, " ".join(texts[70].split()[100:112])), (6, texts[30][:400].upper()),
             (None, texts[10]), (7, "The SAME words-again; same"), (1, texts[30][:400]), (8, "日本 " * 13)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = Counter((d, *hits(t, items)) for d, t in rows)
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert got(decontaminate.decontaminate(docs, bench), *columns) == want
    assert sum(r[5] for r in want) >= 3
    assert decontaminate.decontaminate(none, bench).count() == 0
    clean = got(decontaminate.decontaminate(docs, bench.where("item_id < 0")), *columns)
    assert clean == Counter((d, len(bench_words(t)), 0, 0, sha(b""), False) for d, t in rows)


def test_benchmark_in_several_blocks(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    items = [(i, t[:300]) for i, t in rows if i is not None and i >= 10 and i < 60]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert len(decontaminate.item_blocks(bench, "item_id", "text")) > 3
    want = Counter((d, *hits(t, items)) for d, t in rows if d != 70)
    made = decontaminate.decontaminate(docs.where("doc_id <> 70 or doc_id is null"), bench)
    assert got(made, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want


def test_near_duplicates(docs, rows, none):
    classes = components(rows)
    want = Counter((d, len(shingles(t)), classes.get(d), d == classes.get(d)) for d, t in rows)
    assert got(neardup.near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept") == want
    assert neardup.near_duplicates(none).count() == 0


def test_near_duplicates_in_large_nodes(spark, monkeypatch):
    """Chains, dense groups and shared passages with small nodes, so that trees branch and leaders change."""
    monkeypatch.setattr(neardup, "SMALL", 3)
    base, passage = prose(150, 5), prose(80, 6)
    rows = [(i, edited(base, 0.02, i)) for i in range(60)]
    rows += [(100 + i, f"{passage} {prose(60, 200 + i)}") for i in range(30)]
    link = prose(100, 8).split()
    rows += [(200 + i, " ".join(link[i * 6 :] + prose(i * 6, 400).split())) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()}
    assert made == components(rows)


def test_dense_pool_just_below_the_threshold(spark):
    """Over 512 documents of one origin, most pairs below the threshold: every link counts, and brute force finds them all."""
    base = prose(120, 50)
    rows = [(i, edited(base, 0.028 + 0.003 * (i % 5), i)) for i in range(700)]
    rows += [(1000 + i, edited(base, 0.01, 5000 + i)) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    made = {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()}
    assert made == components(rows)
    assert len(set(made.values())) > 50


@pytest.mark.parametrize("seed", range(3))
def test_links_of_dense_blocks(spark, monkeypatch, seed):
    """Pools of several blocks, guests and classes known before, against every pair."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "COLUMNS", 64)
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 60, 100)
    sets = {i: np.unique(np.concatenate([base[rng.random(100) < 0.86], rng.integers(0, 1 << 60, 5)])).tolist() for i in range(90)}
    members = [(n, i, bool(i % 3 == 0), i % 40 if i < 80 else 7) for n in (5, 6) for i in range(90) if (i < 60) == (n == 5) or i % 10 == 0]
    pool = spark.createDataFrame(members, "node long, rep long, guest boolean, label long")
    links = neardup.dense_links(pool, spark.createDataFrame(list(sets.items()), "rep long, set array<long>"), "long").collect()
    near = lambda a, b: 4 * len(a & b) >= 3 * len(a | b)
    want = {
        (i, j) for n, i, g, x in members for m, j, h, y in members
        if n == m and i < j and not (g and h) and x != y and near(set(sets[i]), set(sets[j]))
    }
    made = {(min(a, b), max(a, b)) for a, b in links}
    assert made <= want and len(want) > 20

    def classes(pairs):
        top = {i: i for i in sets}
        for i, j in sorted(pairs):
            lo, hi = sorted((top[i], top[j]))
            top = {k: lo if v == hi else v for k, v in top.items()}
        return top

    assert classes(made) == classes(want)


def test_bands_of_similar_sets_are_neighbours(spark):
    """Every size up to 3,000 with the largest that may be similar to it, and sizes of many digits."""
    sizes = [*range(1, 3000), *(10**k + i for k in range(4, 10) for i in range(-9, 9))]
    df = spark.createDataFrame([(n, n * 100 // neardup.PERCENT) for n in sizes], "n long, m long")
    apart = [r.d for r in df.select((neardup.band(F.col("m")) - neardup.band(F.col("n"))).alias("d")).collect()]
    assert set(apart) == {0, 1}


def test_dense_blocks_meet_only_where_sizes_allow_a_link(spark, monkeypatch):
    """Hosts of very different sizes share no group, a guest without a host of about its size is in none, no link is lost."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 60, 700)
    members = [(10, i, False) for i in range(12)] + [(600, 20 + i, False) for i in range(12)] + [(12, 40, True), (590, 41, True)]
    members += [(90, 50 + i, True) for i in range(30)]
    sets = {i: base[: n + i % 3].tolist() for n, i, _ in members}
    pool = spark.createDataFrame([(1, i, guest, i) for _, i, guest in members], "node long, rep long, guest boolean, label long")
    held = spark.createDataFrame(list(sets.items()), "rep long, set array<long>")
    groups = {}
    for r in neardup.dense_rows(pool, held).collect():
        groups.setdefault((r.xpart, r.ypart), []).append(r.rep)
    assert {x for reps in groups.values() for x in reps} == {i for n, i, _ in members if n != 90}
    assert all(len({len(sets[x]) > 100 for x in reps}) == 1 and len(reps) == len(set(reps)) for reps in groups.values())
    links = {frozenset(r) for r in neardup.dense_links(pool, held, "long").collect()}
    top = {i: i for i in sets}
    for i, j in sorted(map(sorted, links)):
        top = {k: min(top[i], top[j]) if v in (top[i], top[j]) else v for k, v in top.items()}
    assert {i: x for i, x in top.items() if x != i} == {**dict.fromkeys([*range(1, 12), 40], 0), **dict.fromkeys([*range(21, 32), 41], 20)}


def test_texts_are_not_shuffled_by_pairs(spark, monkeypatch):
    """However many documents are confirmed: a join by key would shuffle their texts once it is no broadcast."""
    read, full_sets = [], neardup.full_sets
    monkeypatch.setattr(neardup, "full_sets", lambda df, kind: read.append(df) or full_sets(df, kind))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        base = prose(80, 3)
        texts = spark.createDataFrame([(i, base if i < 3 else prose(80, i)) for i in range(20)], "rep long, text string")
        marks = neardup.signatures(texts, "rep", "text").select(F.col("doc").alias("rep"), "signature")
        join = neardup.Join(marks, texts, "long", spark.createDataFrame([], "a long, b long"))
        join.confirm(spark.createDataFrame([(0, 1), (2, 5)], "a long, b long"))
        assert {tuple(r) for r in join.labels.collect()} == {(0, 0), (1, 0)}
        join.compare_all(spark.createDataFrame([(9, i, False, max(i, 1)) for i in (1, 2, 6)], "node long, rep long, guest boolean, label long"))
        assert {tuple(r) for r in join.labels.collect()} == {(0, 0), (1, 0), (2, 0)}
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in read]
        assert len(plans) == 2 and not any("SortMergeJoin" in p or "ShuffledHashJoin" in p for p in plans)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_signature_is_read_once_for_all_nodes_of_a_document(spark):
    """Children of several nodes of a document in one row; pools without a join of all memberships by document."""
    marks = [neardup.minwise(neardup.shingles(prose(60, i).encode())) for i in range(3)]
    held = {0: [(5, 40), (6, 50), (7, 60)], 1: [], 2: [(6, 50)]}
    df = spark.createDataFrame([(i, m.tolist(), held[i]) for i, m in enumerate(marks)], "rep long, signature array<int>, nodes array<struct<node: long, n: long>>")
    made = Counter(map(tuple, neardup.branch(df.coalesce(1), 0, "long").collect()))
    want = Counter()
    for i, nodes in held.items():
        for node, n in nodes:
            tree = np.array([node], np.uint64)
            for place in np.flatnonzero(neardup.mixed(tree ^ neardup._PLACES) < neardup._CHANCE):
                token = marks[i].view(np.uint32).astype(np.uint64)[place : place + 1]
                want[int(neardup.mixed(neardup.mixed(tree + neardup._PLACES[place]) ^ token).view(np.int64)[0]), i, n] += 1
    assert made == want and want
    nodes = spark.createDataFrame([(n, r, 40 - n, False) for n in range(4) for r in range(40 - n)], "node long, rep long, n long, guest boolean")
    pools = neardup.dense_pools(nodes)
    assert {tuple(r) for r in pools.collect()} == {(0, r, False) for r in range(40)}
    assert "Join Inner, (rep" not in pools._jdf.queryExecution().optimizedPlan().toString()


def test_sketches_lose_no_agreement(spark):
    """An eighth of the signature, and never fewer places than the signatures agree at."""
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**31), 2**31, neardup.WIDTH).astype(np.int32)
    marks = [base] + [np.where(rng.random(neardup.WIDTH) < share, base, rng.integers(-(2**31), 2**31, neardup.WIDTH)).astype(np.int32) for share in (1, 0.9, 0.57, 0)]
    df = spark.createDataFrame([(i, m.tolist()) for i, m in enumerate(marks)], "rep long, signature array<int>")
    made = neardup.sketches(df, "long")
    assert all(8 * len(r.sketch) * 8 == 4 * neardup.WIDTH for r in made.collect())
    first = made.where("rep = 0").select(F.col("sketch").alias("s0"))
    agree = {r.rep: r.n for r in made.crossJoin(first).select("rep", neardup.agreeing(F.col("sketch"), F.col("s0")).alias("n")).collect()}
    top = [m.view(np.uint32) >> 28 for m in marks]
    assert agree == {i: int((t == top[0]).sum()) for i, t in enumerate(top)}
    assert all(agree[i] >= int((m == base).sum()) for i, m in enumerate(marks)) and agree[1] == neardup.WIDTH


def test_signature_of_each_representative_once(spark):
    """Copies, repeated rows and ids with several texts among documents that have neither."""
    rows = [(i, i, 0, [i]) for i in range(1, 40)] + [(50, 7, 0, [7]), (60, 7, 0, [7]), (3, 3, 0, [3]), (5, 7, 0, [7]), (5, 90, 0, [90]), (8, 91, 0, [91])]
    filled = spark.createDataFrame(rows, "doc long, d1 long, d2 long, signature array<int>").repartition(3)
    reps = filled.groupBy("d1", "d2").agg(F.min("doc").alias("rep"))
    known = filled.groupBy("doc", "d1", "d2").agg(F.count("*").alias("m")).join(reps, ["d1", "d2"])
    made = Counter((r.rep, *r.signature) for r in neardup.first_rows(filled, known).collect())
    least = {}
    for d, d1, _, _ in rows:
        least[d1] = min(d, least.get(d1, d))
    assert made == Counter((d, d1) for d1, d in least.items())


def test_bit_sets_hold_rows_back_before_the_shuffle(spark):
    """Spark moves a semi or anti join to before the bit set, and then shuffles every text or signature."""
    texts = spark.createDataFrame([(i % 90, f"t{i}") for i in range(100)] + [(None, "n")], "rep long, text string")
    ids = spark.createDataFrame([(i,) for i in (3, 5, 95)], "id long")
    found = neardup.only(texts, "rep", ids)
    assert sorted(map(tuple, found.collect())) == [(3, "t3"), (3, "t93"), (5, "t5"), (5, "t95")]
    marks = [(i, i, 0, [i]) for i in range(40)] + [(50, 7, 0, [7])]
    filled = spark.createDataFrame(marks, "doc long, d1 long, d2 long, signature array<int>")
    known = spark.createDataFrame([(d, a, b, a, 1) for d, a, b, _ in marks], "doc long, d1 long, d2 long, rep long, m long")
    signed = neardup.first_rows(filled, known).where("rep >= 0")
    for df in (found, signed):
        lines = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
        joins = [i for i, x in enumerate(lines) if "Join Inner" in x]
        assert not any("LeftSemi" in x or "LeftAnti" in x for x in lines)
        assert any("getbit" in lines[j] for i in joins for j in joins if i < j)  # the bit set is below the join by key


def test_pairs_at_the_threshold_pass_the_signature():
    chance = neardup.PERCENT / 100
    lost = sum(math.comb(neardup.WIDTH, k) * chance**k * (1 - chance) ** (neardup.WIDTH - k) for k in range(neardup.AGREE))
    assert lost < 1e-5


def test_ids_with_several_texts_join_their_groups(spark):
    a, b = prose(60, 1), prose(60, 2)
    rows = [(1, a), (2, b), (5, a), (5, b), (7, b + " z"), (8, prose(60, 3))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()} == {1: 1, 2: 1, 5: 1, 7: 1, 8: 8}


@pytest.mark.parametrize("batch, bucket", [(8 << 20, 16 << 20), (4000, 3000)])
def test_repeated_passages(docs, rows, none, monkeypatch, batch, bucket):
    monkeypatch.setattr(suffixes, "BATCH_BYTES", batch)
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", bucket)
    monkeypatch.setattr(suffixes, "SAMPLE_BUCKET_BYTES", 2 * bucket)
    by = removed(rows)
    want = Counter((d, *by[d, t or ""]) for d, t in rows)
    assert got(suffixes.dedup_passages(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert suffixes.dedup_passages(none).count() == 0


def test_every_difference_is_covered():
    assert {(a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER} == set(range(suffixes.PERIOD))


def test_passages_just_long_enough(spark):
    r = prose(400, 3)
    rows = [(1, r[:500]), (2, "#" * 30 + r[100:199] + "#" * 30), (3, "$" * 31 + r[200:300] + "$"), (4, r[7:107]), (5, "%" + r[300:450] + "%" * 99 + r[0:100])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    by = removed(rows)
    made = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.dedup_passages(df).collect()}
    assert made == {d: by[d, t] for d, t in rows}
    assert made[2][1] == 0 and made[3][1] == 100


def test_line_dedup(docs, rows, none):
    want = Counter((d, *r) for (d, _), r in zip(rows, line_dedup(rows)))
    assert got(lines.line_dedup(docs), "doc_id", "n_lines", "n_dropped", "kept_sha256") == want
    assert lines.line_dedup(none).count() == 0
    texts = lines.without_repeats(docs)
    assert texts.columns == docs.columns and texts.count() == len(rows)


def test_line_dedup_of_one_line_over_many_partitions(spark):
    shared = "a line that every document has"
    rows = [(i, f"{shared}\nown line number {i:05d} of it\n{shared}" if i % 3 else f"x\ntwo have this line, {i // 9:05d}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        made = got(lines.line_dedup(df), "doc_id", "n_lines", "n_dropped", "kept_sha256")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert made == Counter((d, *r) for (d, _), r in zip(rows, line_dedup(rows)))


def test_quality(spark, docs, rows, none):
    small = docs.where("doc_id <> 70 or doc_id is null")
    out = quality.quality(small, None)
    kept = [(d, t) for d, t in rows if d != 70]
    want = Counter((d, *(c := base_counts(t)), f := c[0] < 50 or 100 * c[4] > 50 * c[0], not f) for d, t in kept)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert got(out, *columns) == want
    assert quality.quality(none, None).count() == 0
    assert quality.train(none, spark.createDataFrame([], "doc_id long, quality int")) is None


def junk(n, seed):
    return " ".join(f"{w}{'#*$%&'[i % 5] * 3}" for i, w in enumerate(prose(n, seed).split()))


def test_field_learns_lines(spark):
    good = [(i, "\n".join(prose(20, 1000 + 7 * i + k).capitalize() + "." for k in range(5))) for i in range(40)]
    bad = [(100 + i, "\n".join(junk(20, 3000 + 7 * i + k) for k in range(5))) for i in range(40)]
    mixed = [(200 + i, "\n".join([g.split("\n")[0], *b.split("\n")[1:]])) for i, ((_, g), (_, b)) in enumerate(zip(good, bad))]
    df = spark.createDataFrame(good + bad + mixed, "doc_id long, text string")
    labels = spark.createDataFrame([(d, 1) for d, _ in good[:20]] + [(d, 0) for d, _ in bad[:20]] + [(None, 1), (999, None)], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality.quality(df, quality.train(df, labels)).collect()}
    assert all(out[d].kept for d, _ in good)
    assert not any(out[d].kept for d, _ in bad + mixed)


def test_viterbi_finds_the_best_path():
    import itertools

    rng = np.random.default_rng(1)
    field = quality.Field(np.zeros((1, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    lengths = np.array([3, 0, 5, 1, 4])
    scores = rng.normal(size=(13, 2))
    states = quality.viterbi(scores, lengths, field)
    at = 0
    for n in lengths:
        own = scores[at : at + n]

        def total(path, own=own):
            steps = sum(field.transition[a, b] for a, b in zip(path, path[1:]))
            return field.start[path[0]] + steps + sum(own[i, s] for i, s in enumerate(path))

        if n:
            assert tuple(states[at : at + n]) == max(itertools.product((0, 1), repeat=int(n)), key=total)
        at += n
