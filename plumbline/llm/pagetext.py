"""Main text of web pages: markup blocks, and a suffix array over the token streams of each host.

Pages are dealt into groups of some ``GROUP_BYTES`` by host; a larger host is cut into several. The visible words of a host's
pages in a group are concatenated and their suffixes ranked by prefix doubling; suffixes from different pages that share
``LEAST`` words or more are repeats of the host's template, and all words they cover are boilerplate. Only the groups of hosts
that were cut tell each other their windows of ``LEAST`` words: first a few bits of each, packed, then the whole hashes of
those whose bits another group has too. Runs that stay unique are text. Markup then has the last word: what it names as menu,
notice or the like goes even if unique, and what it names as the article stays even if another page repeats it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import WORD_HASHES, mixed, partitions, ranges, windows_of

LEAST = 8
#: HTML of the pages of a group, as expected; a longer page makes its group longer.
GROUP_BYTES = 8 << 20
#: Hosts are counted by so many buckets of their hash; a bucket of more than a group is cut by page.
BUCKETS = 1 << 16
#: Groups of a bucket whose windows one task compares (a slice holds as much as so many groups).
SLICE_GROUPS = 4
ROW = "page_id {id}, url string, text string, n_chars long, n_words long, n_repeated long"
PAGE = "key long, parts long, _id {id}, _url string, _host string, _flags binary, _size long, _text binary"
SENT = "bucket long, slice long, key long, n long, data binary"
EXACT = "bucket long, slice long, key long, pages binary, counts binary, data binary"
FLAGS = "key long, slice long, n long, data binary"

# Fixed values of HTML: element names by their role.
RAW = "script style noscript template textarea title iframe noembed noframes xmp svg math select"
VOID = "area base br col embed hr img input link meta param source track wbr"
BLOCK = (
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary "
    "table tbody tfoot thead tr ul"
)
OUTSIDE = "head nav aside footer header form menu dialog button fieldset object audio video canvas map"
INSIDE = "article main"
ROLES = "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar"
NAMES = (
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices alert newsletter subscribe subscription signup sidebar aside menu nav navbar navigation breadcrumb "
    "breadcrumbs header masthead footer comment comments commentlist disqus reply replies respond share sharing social "
    "related recommended widget popup modal overlay login search toolbar pagination pager skip"
)
RAW, VOID, BLOCK, OUTSIDE, INSIDE, ROLES, NAMES = (frozenset(x.split()) for x in (RAW, VOID, BLOCK, OUTSIDE, INSIDE, ROLES, NAMES))
CLOSES_P = BLOCK - {"body", "html", "head"}

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(sorted(RAW)) + r")\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PARTS = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")


def unwanted(name: str, rest: str) -> bool:
    """Whether an element, by its name and attributes, holds no article text."""
    if name in OUTSIDE:
        return True
    if not rest or name in INSIDE or name in ("body", "html"):
        return False
    for key, *values in ATTRIBUTE.findall(rest):
        key, value = key.lower(), "".join(values).lower()
        if key in ("class", "id") and not NAMES.isdisjoint(PARTS.split(value)):
            return True
        if key == "role" and not ROLES.isdisjoint(value.split()):
            return True
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        if key == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def blocks(page: str) -> list[tuple[str, bool, bool]]:
    """(text, wanted, inside an article) of the page's blocks with text, in order.

    Character references are decoded and white space becomes single spaces. A block ends where a block element starts or
    ends; other elements, line breaks and cells do not end it. Unclosed elements end with what holds them.
    """
    out: list[tuple[str, bool, bool]] = []
    stack: list[tuple[str, bool, bool]] = []
    parts: list[str] = []
    bad = good = False
    at = 0

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((text, not bad, good))

    for m in MARKUP.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name in BLOCK:
            flush()
        elif name in ("br", "td", "th"):
            parts.append(" ")
        if m["end"]:
            if any(n == name for n, _, _ in stack):
                while stack.pop()[0] != name:
                    pass
                bad, good = stack[-1][1:] if stack else (False, False)
            continue
        if name in CLOSES_P and stack and any(n == "p" for n, _, _ in stack[-8:]):
            k = max(i for i, (n, _, _) in enumerate(stack) if n == "p")
            if not any(n in BLOCK for n, _, _ in stack[k + 1 :]):  # a block ends an open paragraph
                del stack[k:]
                bad, good = stack[-1][1:] if stack else (False, False)
        if name in VOID or m["rest"].endswith("/"):
            continue
        bad, good = bad or unwanted(name, m["rest"]), good or name in INSIDE
        stack.append((name, bad, good))
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def repeated(streams: list[np.ndarray], least: int = LEAST, known: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """Which words of each stream lie in ``least`` words or more that another, different stream has too.

    ``known``: of each stream, which windows of ``least`` words are known to be repeated in streams that aren't here.
    """
    first: dict[bytes, int] = {}
    own = [first.setdefault(s.tobytes(), i) for i, s in enumerate(streams)]  # copies of a page are one page
    marks = [np.zeros(len(s), bool) for s in streams]
    firsts = sorted(set(own))
    if len(firsts) > 1:
        lengths = np.array([len(streams[i]) + 1 for i in firsts])
        ends = np.cumsum(lengths)
        text = np.zeros(ends[-1], np.uint64)
        text[np.setdiff1d(np.arange(ends[-1]), ends - 1, assume_unique=True)] = np.concatenate([streams[i] for i in firsts])
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + len(firsts)
        rank[ends - 1] = np.arange(len(firsts))  # each page ends with a word of its own
        depth = 1
        while depth < least:  # ranks by the first ``depth`` words give those by twice as many
            step = min(depth, least - depth)
            after = np.full(len(rank), -1, np.int64)
            after[:-step] = rank[step:]
            rank = np.unique(rank * (len(rank) + len(firsts) + 2) + after, return_inverse=True)[1]
            depth += step
        order = np.argsort(rank, kind="stable")  # the suffix array
        begin = np.flatnonzero(np.append(True, rank[order][1:] != rank[order][:-1]))
        page = np.repeat(np.arange(len(firsts)), lengths)[order]
        several = np.minimum.reduceat(page, begin) != np.maximum.reduceat(page, begin)
        starts = order[np.repeat(several, np.diff(np.append(begin, len(order))))]
        cover = np.zeros(len(text) + least + 1, np.int64)
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + least, -1)
        covered = np.cumsum(cover)[: len(text)] > 0
        for i, end, n in zip(firsts, ends, lengths):
            marks[i] = covered[end - n : end - 1]
    marks = [marks[i] for i in own]
    for mark, starts in zip(marks, known or []):
        for k in range(least if len(starts) else 0):
            mark[k : k + len(starts)] |= starts
    return marks


def main_texts(pages: list[str], least: int = LEAST) -> list[tuple[str, int, int]]:
    """(main text, words, repeated words) of pages of one host."""
    return texts_of_blocks([blocks(p) for p in pages], least)


def texts_of_blocks(parsed: list[list[tuple[str, bool, bool]]], least: int = LEAST, known: list | None = None) -> list[tuple[str, int, int]]:
    """(main text, words, repeated words) of the blocks of pages of one host; ``known`` as for ``repeated``."""
    words = [[t.encode().split() for t, _, _ in b] for b in parsed]
    streams = [WORD_HASHES.of([w for ws in page for w in ws]) for page in words]
    out = []
    for page, page_words, mark in zip(parsed, words, repeated(streams, least, known)):
        ends = np.cumsum([len(w) for w in page_words])
        article = any(wanted and inside for _, wanted, inside in page)
        kept = []
        for (text, wanted, inside), w, end in zip(page, page_words, ends):
            unique = 2 * int(mark[end - len(w) : end].sum()) < len(w)
            if wanted and (inside if article else unique):
                kept.append(text)
        out.append(("\n".join(kept), len(mark), int(mark.sum())))
    return out


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def parsed_pages(df: DataFrame, kind: str) -> DataFrame:
    """Pages (key, parts, id, url, host, html) with their blocks instead of the html: flags (1 wanted, 2 inside an article) and
    the compressed texts, a line each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags, sizes, texts = [], [], []
            for page in batch.column(5).to_pylist():
                found = blocks(page or "")
                text = "\n".join(t for t, _, _ in found).encode()
                flags.append(bytes(wanted + 2 * inside for _, wanted, inside in found))
                sizes.append(len(text))
                texts.append(pa.compress(text, codec="zstd", asbytes=True) if text else b"")
            arrays = [*batch.columns[:5], pa.array(flags, pa.binary()), pa.array(sizes, pa.int64()), pa.array(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "parts", "_id", "_url", "_host", "_flags", "_size", "_text"])

    return df.select("key", "parts", "_id", "_url", "_host", "_html").mapInArrow(run, PAGE.format(id=kind))


def texts_in(pages: pa.Table) -> list[bytes]:
    rows = zip(pages.column("_size").to_pylist(), pages.column("_text").to_pylist())
    return [pa.decompress(x, decompressed_size=n, codec="zstd", asbytes=True) if n else b"" for n, x in rows]


def host_seed(host: str) -> int:
    return xxhash.xxh3_64_intdigest(host.encode())


def windows_in(pages: pa.Table, texts: list[bytes] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of host and ``LEAST`` words from each word on, page after page; how many each page has; the pages' digests (host
    and words)."""
    words = [t.split() for t in (texts_in(pages) if texts is None else texts)]
    seeds = np.array([host_seed(h) for h in pages.column("_host").to_pylist()], np.uint64)
    sizes = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(sizes)
    stream = WORD_HASHES.of([x for w in words for x in w])
    own = [stream[e - n : e].tobytes() for e, n in zip(ends, sizes)]
    digests = np.array([xxhash.xxh3_64_intdigest(x, int(seed)) for x, seed in zip(own, seeds)], np.uint64)
    counts = np.maximum(sizes - LEAST + 1, 0)
    windows = windows_of(stream, LEAST)[ranges(ends - sizes, counts)]  # none that crosses pages
    return mixed(windows ^ np.repeat(seeds, counts)), counts, digests


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])[: len(x)]]


def parts_of(pages: pa.Table) -> int:
    """Groups that the bucket of these pages is cut into."""
    return pages.column("parts")[0].as_py() if pages.num_rows else 1


def slices_of(windows: np.ndarray, parts: int) -> tuple[np.ndarray, int]:
    """Slice of each window, by its first 24 bits, and how many slices there are."""
    n = -(-parts // SLICE_GROUPS)
    return ((windows >> np.uint64(40)) * np.uint64(n)) >> np.uint64(24), n


def short(windows: np.ndarray, parts: int) -> np.ndarray:
    """The first bits of windows: so many that few of all groups' windows share them by chance."""
    return windows >> np.uint64(64 - min(64, 27 + parts.bit_length()))


def packed_numbers(x: np.ndarray) -> bytes:
    """Ascending numbers as their differences, first all lowest bytes, then all second bytes and so on, compressed."""
    planes = np.diff(x, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked_numbers(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def slices_sent(windows: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(slice, ascending short windows) of a group."""
    windows = distinct(windows)
    at, n = slices_of(windows, parts)
    cuts = np.searchsorted(at, np.arange(n + 1, dtype=np.uint64))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        if a < b:
            yield k, distinct(short(windows[a:b], parts))


def met_elsewhere(pages: DataFrame) -> DataFrame:
    """(key, slice, n, data): which of the n short windows of a slice of a group another group of the bucket has, as bits."""

    def send(group: pa.Table) -> pa.Table:
        parts = parts_of(group)
        rows = list(slices_sent(windows_in(group)[0], parts)) if parts > 1 else []
        key = group.column("key")[0].as_py()
        made = {"bucket": [key >> 32] * len(rows), "slice": [k for k, _ in rows], "key": [key] * len(rows)}
        made |= {"n": [len(x) for _, x in rows], "data": [packed_numbers(x) for _, x in rows]}
        return pa.table(made, schema=pa.schema([(c, pa.binary() if c == "data" else pa.int64()) for c in made]))

    def count(table: pa.Table) -> pa.Table:
        sizes = table.column("n").to_pylist()
        own = [unpacked_numbers(x, n) for x, n in zip(table.column("data").to_pylist(), sizes)]
        values = np.sort(np.concatenate(own))
        several = values[1:][values[1:] == values[:-1]]
        bits = [np.packbits(np.isin(x, several)).tobytes() for x in own]
        return pa.table({"key": table.column("key"), "slice": table.column("slice"), "n": table.column("n"), "data": pa.array(bits, pa.binary())})

    return pages.groupBy("key").applyInArrow(send, SENT).groupBy("bucket", "slice").applyInArrow(count, FLAGS)


def repeats(pages: DataFrame) -> DataFrame:
    """(key, data): windows of a group's pages, as 64-bit hashes, that are in different pages of the host, in several groups
    or in one; of groups of cut buckets, those only that other groups may have. Copies of a page are one page."""

    def send(group: pa.Table, flags: pa.Table) -> pa.Table:
        rows, key = [], group.column("key")[0].as_py() if group.num_rows else 0
        if flags.num_rows and group.num_rows:
            parts, marks = parts_of(group), {}
            for k, n, data in zip(*(flags.column(c).to_pylist() for c in ("slice", "n", "data"))):
                marks[k] = np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)
            windows, counts, digests = windows_in(group)
            owners = np.repeat(digests, counts)
            kept = [np.empty(0, np.uint64)] + [x[marks[k]] for k, x in slices_sent(windows, parts)]
            found = np.isin(short(windows, parts), np.concatenate(kept))
            windows, owners = windows[found], owners[found]
            order = np.lexsort((windows, owners))  # by page
            windows, owners = windows[order], owners[order]
            new = np.append(True, (windows[1:] != windows[:-1]) | (owners[1:] != owners[:-1]))[: len(windows)]
            windows, owners = windows[new], owners[new]
            at, _ = slices_of(windows, parts)
            for k in np.unique(at):
                names, counts = np.unique(owners[at == k], return_counts=True)
                rows.append((key >> 32, int(k), key, names.tobytes(), counts.astype(np.int64).tobytes(), windows[at == k].tobytes()))
        kinds = [("bucket", pa.int64()), ("slice", pa.int64()), ("key", pa.int64()), ("pages", pa.binary()), ("counts", pa.binary()), ("data", pa.binary())]
        return pa.table([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], schema=pa.schema(kinds))

    def count(table: pa.Table) -> pa.Table:
        numbers = lambda c, t: [np.frombuffer(x, t) for x in table.column(c).to_pylist()]
        own, names, counts = numbers("data", np.uint64), numbers("pages", np.uint64), numbers("counts", np.int64)
        windows, pages = np.concatenate(own), np.concatenate([np.repeat(x, n) for x, n in zip(names, counts)])
        order = np.argsort(windows, kind="stable")
        windows, pages = windows[order], pages[order]
        begin = np.flatnonzero(np.append(True, windows[1:] != windows[:-1]))
        several = windows[begin[np.minimum.reduceat(pages, begin) != np.maximum.reduceat(pages, begin)]]
        found = [np.unique(x[np.isin(x, several)]).tobytes() for x in own]
        return pa.table({"key": table.column("key"), "data": pa.array(found, pa.binary())})

    sent = pages.groupBy("key").cogroup(met_elsewhere(pages).groupBy("key")).applyInArrow(send, EXACT)
    return sent.groupBy("bucket", "slice").applyInArrow(count, "key long, data binary")


def dealt(rows: DataFrame) -> DataFrame:
    """Pages (_id, _url, _html, _host) with the ``key`` of their group and the ``parts`` of their host's bucket.

    Buckets of up to ``GROUP_BYTES`` share groups; a larger one is cut by a hash of the whole page, so copies part by id.
    The bytes of at most ``BUCKETS`` buckets are all that is broadcast.
    """
    bucket = F.pmod(F.xxhash64("_host"), F.lit(BUCKETS))
    bytes_in = rows.groupBy(bucket.alias("_in")).agg(F.sum(F.coalesce(F.octet_length("_html"), F.lit(0)).cast("long")).alias("_bytes"))
    sizes = bytes_in.collect()  # at most BUCKETS rows
    groups = max(1, -(-sum(r["_bytes"] for r in sizes) // GROUP_BYTES))
    cut = [(r["_in"], -(-r["_bytes"] // GROUP_BYTES)) for r in sizes if r["_bytes"] > GROUP_BYTES]
    parts = rows.sparkSession.createDataFrame(cut, "_in long, _parts long")
    rows = rows.withColumn("_bucket", bucket).join(F.broadcast(parts), F.col("_bucket") == F.col("_in"), "left")
    rows = rows.withColumn("parts", F.coalesce("_parts", F.lit(1).cast("long")))
    part = F.pmod(F.xxhash64("_id", "_url", "_html"), F.col("parts"))
    key = F.when(F.col("parts") > 1, F.shiftleft(F.col("_bucket") + (groups >> 32) + 1, 32) + part).otherwise(F.pmod("_bucket", F.lit(groups)))
    return rows.withColumn("key", key)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``df``: id, url, ``text``, ``n_chars``, ``n_words`` (visible words), ``n_repeated`` (of them, inside
    repeats of the host).

    ``text``: of a page with an ``article`` or ``main`` element, its blocks but for menus, notices and the like inside; of
    another page, the blocks outside of such whose words are mostly unique on the host. Null or empty html gives an empty
    text. Pages without a host (null url) are one host. Null ids and repeated rows stay; pages with equal words count as one
    page, so copies don't make each other boilerplate. A host of any size is cut into groups of ``GROUP_BYTES``; repeats are
    looked for over all of them. Other columns are not read.
    """
    id_kind = df.schema[id_col].dataType.simpleString()
    columns = ["page_id", "url", "text", "n_chars", "n_words", "n_repeated"]

    def run(group: pa.Table, found: pa.Table) -> pa.Table:
        known = np.unique(np.concatenate([np.empty(0, np.uint64)] + [np.frombuffer(x, np.uint64) for x in found.column("data").to_pylist()]))
        flags, rows = group.column("_flags").to_pylist(), texts_in(group)
        made: list = [("", 0, 0)] * len(rows)
        by_host: dict[str, list[int]] = {}
        for i, host in enumerate(group.column("_host").to_pylist()):
            by_host.setdefault(host, []).append(i)
        for host, at in by_host.items():
            parsed = [[(t, bool(f & 1), bool(f & 2)) for t, f in zip(rows[i].decode().split("\n"), flags[i])] for i in at]
            repeated_at = None
            if len(known):  # all pages at once: the known windows are sorted once
                windows, counts, _ = windows_in(group.take(pa.array(at)), [rows[i] for i in at])
                repeated_at = np.split(np.isin(windows, known), np.cumsum(counts)[:-1])
            for i, out in zip(at, texts_of_blocks(parsed, LEAST, repeated_at)):
                made[i] = out
        texts, n_words, n_repeated = zip(*made) if made else ((), (), ())
        longs = [pa.array(x, pa.int64()) for x in ([len(t) for t in texts], n_words, n_repeated)]
        return pa.table([group.column("_id"), group.column("_url"), pa.array(texts, pa.string()), *longs], columns)

    rows = df.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"), host_of(F.col(url_col)).alias("_host"))
    pages = parsed_pages(dealt(rows), id_kind).repartition(partitions(df.sparkSession), "key")
    out = pages.groupBy("key").cogroup(repeats(pages).groupBy("key")).applyInArrow(run, ROW.format(id=id_kind))
    return out.withColumnsRenamed({"page_id": id_col, "url": url_col})
