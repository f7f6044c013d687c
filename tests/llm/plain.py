"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import random
import re

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def bench_words(text):
    return BENCH_WORD.findall((text or "").translate(LOWER))


def hits(text, items, width=13):
    w = bench_words(text)
    hit, found = [False] * len(w), set()
    for item, item_text in items:
        iw = bench_words(item_text)
        for k in range(max(1, len(iw) - width + 1)) if iw and item is not None else ():
            window = iw[k : k + width]
            for i in range(len(w) - len(window) + 1):
                if w[i : i + len(window)] == window:
                    found.add(str(item))
                    hit[i : i + len(window)] = [True] * len(window)
    n = sum(hit)
    return len(w), n, len(found), sha(",".join(sorted(found)).encode()), n > 0 and 20 * n >= len(w)


def shingles(text, width=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def components(rows, percent=75):
    """{id: smallest id it is linked with} of (id, text) rows."""
    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in root}


def removed(rows, length=100):
    """{(id, text): (n_bytes, n_removed, n_spans, kept_sha256)} of (id, text) rows."""
    seen, out = set(), {}
    for d, t in sorted(set((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1].encode())):
        b = t.encode()
        gone = [False] * len(b)
        for p in range(len(b) - length + 1) if d is not None else ():
            window = b[p : p + length]
            if window in seen:
                gone[p : p + length] = [True] * length
            seen.add(window)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d, t] = (len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone) if not g)))
    return out


def base_counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = [windows.count(x) > 1 for x in windows]
    mark = [any(twice[max(0, i - 2) : i + 1]) for i in range(len(w))]
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), sum(mark)


def line_dedup(rows, min_chars=20, min_docs=3):
    """[(n_lines, n_dropped, kept_sha256)] of (id, text) rows, in their order."""
    docs: dict = {}
    for d, t in rows:
        for line in (t or "").split("\n") if d is not None else ():
            docs.setdefault(line.strip(SPACES).translate(LOWER), set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        keep = []
        for line in lines:
            key = line.strip(SPACES).translate(LOWER)
            hot = d is not None and len(key) >= min_chars and len(docs.get(key, ())) >= min_docs
            if not hot or d == max(docs[key]):
                keep.append(line)
        out.append((len(lines), len(lines) - len(keep), sha("\n".join(keep).encode())))
    return out


def prose(n, seed, alphabet="aeinorst"):
    r = random.Random(seed)
    return " ".join("".join(r.choices(alphabet, k=r.randint(1, 8))) for _ in range(n))


def edited(text, share, seed):
    r = random.Random(seed)
    return " ".join(w if r.random() > share else w + "x" for w in text.split(" "))


def without_windows(rows, width):
    """[(n_words, n_removed, kept words)] of (id, text) rows, in their order."""
    words = [WORD.findall(t or "") for _, t in rows]
    holders: dict = {}
    for (d, _), w in zip(rows, words):
        for i in range(len(w) - width + 1) if d is not None else ():
            holders.setdefault(tuple(w[i : i + width]), set()).add(d)
    out = []
    for (d, _), w in zip(rows, words):
        gone, seen = [False] * len(w), set()
        for i in range(len(w) - width + 1) if d is not None else ():
            window = tuple(w[i : i + width])
            if window in seen or min(holders[window]) < d:
                gone[i : i + width] = [True] * width
            seen.add(window)
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def phrases(rows, top, least, share=50):
    """(lang, rank, phrase, a, l, r, n, score) of (text, lang) rows."""
    counts: dict = {}
    for text, lang in rows:
        own = counts.setdefault(lang or "und", {})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    own[tuple(w[i : i + k])] = own.get(tuple(w[i : i + k]), 0) + 1
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        longer: dict = {}
        for p, c in candidates.items():
            for pair in (p[:2], p[1:]) if len(p) == 3 else ():
                longer[pair] = max(longer.get(pair, 0), c)
        scored = []
        for p, a in candidates.items():
            if 100 * longer.get(p, 0) < share * a:
                score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n, -s))
    return out


def negatives(rows, is_anchor, positives=5, k=5, percent=80):
    """(anchor, positive, rank, negative, scores) of (id, label, vector) rows."""
    first: dict = {}
    for d, label, v in rows:
        if d is not None and label is not None and v is not None and None not in v:
            first[d] = min(first.get(d, (str(label), v)), (str(label), v))
    out = []
    for a, (label, v) in first.items():
        if is_anchor(a):
            clip = lambda s: min(max(s, -(2**63) + 1), 2**63 - 1)
            scored = sorted((-clip(sum(x * y for x, y in zip(v, w))), b, other) for b, (other, w) in first.items() if b != a)
            for s, p, _ in [x for x in scored if x[2] == label][:positives]:
                fits = [(-n, b) for n, b, other in scored if other != label and percent * -s <= 100 * -n <= 100 * -s]
                out += [(a, p, i + 1, b, -s, n) for i, (n, b) in enumerate(fits[:k])]
    return out
