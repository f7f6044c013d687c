"""Main text, URL filters and quotation linking against written-down results and plain Python."""

import re
from collections import Counter

import numpy as np
import pytest
from plain import prose

from plumbline.llm import linkgraph, pagetext, quotes

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p><p>no";</script></head>
<body><header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></ul></nav><!-- <p>no</p> --><div class="cookie-notice">We
use cookies</div><div class="side-bar"><p>no</p></div><article><h1>Head&shy;line &lt;1&gt;</h1><p>First   <b>bold<br>next</b>
line<p>Second&nbsp;&eacute; <a href=x>link</a>ed<ul><li>one<li>two</ul><table><tr><td>a</td><td>b</td></tr></table>
<form><input name=q><button>Go</button></form><aside>no</aside><div class="ad">no</div><noscript>no</noscript>
<section id="comments"><p>no<p>no</section><pre>x
 y</pre>tail</article><footer>&copy; no</footer></body></html>"""


def test_blocks_of_an_article():
    text, _, _ = pagetext.main_texts([PAGE])[0]
    assert text == "Head\xadline <1>\nFirst bold next line\nSecond é linked\none\ntwo\na b\nx y\ntail"


@pytest.mark.parametrize(
    "page, want",
    [
        ("", ""), ("plain text", "plain text"), ("a < b & c", "a < b & c"), ("<p>cut off in a ta<b", "cut off in a ta"),
        ("<article><p>open <i>never closed", "open never closed"), ("</p></div>x", "x"), ("<p>a</p>\n\n<p> \t</p><p>b", "a\nb"),
        ("<div hidden>no</div><div role=navigation>no</div><main>yes<nav>no</nav></main>no", "yes"),
        ("<p>&#x41;&#66;&am</p>", "AB&am"), ("<script>a<b</script>c<!-- d", "c"), ("<P CLASS='AD'>no</P><P>yes</P>", "yes"),
    ],
)
def test_odd_pages(page, want):
    assert pagetext.main_texts([page])[0][0] == want


def marked(streams, least):
    """Which words lie in a window that another, different stream has."""
    windows = {}
    for s in {tuple(s) for s in streams}:
        for i in range(len(s) - least + 1):
            windows.setdefault(s[i : i + least], set()).add(s)
    out = []
    for s in map(tuple, streams):
        mark = [False] * len(s)
        for i in range(len(s) - least + 1):
            if len(windows[s[i : i + least]]) > 1:
                mark[i : i + least] = [True] * least
        out.append(mark)
    return out


@pytest.mark.parametrize("seed", range(10))
def test_suffix_array_marks_repeats(seed):
    rng = np.random.default_rng(seed)
    streams = [rng.integers(0, 3, rng.integers(0, 40)).astype(np.uint64) for _ in range(6)]
    streams += [streams[0], np.zeros(0, np.uint64)]
    for least in (1, 3, 8):
        assert [m.tolist() for m in pagetext.repeated(streams, least)] == marked([s.tolist() for s in streams], least)


@pytest.fixture(scope="module")
def pages(spark):
    menu = "home about contact imprint products services and many more things to see"
    rows = [(i, f"http://h{i % 2}.example.org/en/{i}", f"<div>{menu}</div><div><p>{prose(30, i)}</div><div>{menu} again</div>", "x") for i in range(12)]
    rows += [(20, None, None, "x"), (None, "http://H0.example.org", f"<article>{menu}</article>", "x"), (21, "no host", "", "x")]
    rows += [(22, "http://h0.example.org/a", rows[0][2], "x")] * 2
    return spark.createDataFrame(rows, "page_id long, url string, html string, text string"), rows


def test_template_of_a_host(spark, pages):
    df, rows = pages
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    made = pagetext.extract(df).collect()
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert Counter(r.page_id for r in made) == Counter(r[0] for r in rows)
    for r in made:
        want = prose(30, r.page_id % 22) if r.page_id is not None and r.page_id != 20 and r.page_id != 21 else "" if r.page_id else None
        if want is not None:
            assert (r.text, r.n_chars) == (want, len(want))
        else:
            assert r.text.startswith("home about")
    assert pagetext.extract(df.where("page_id < 0")).count() == 0


@pytest.mark.parametrize("shuffle, group", [(1, 8 << 20), (7, 8 << 20), (7, 300), (1, 1)])
def test_template_over_groups_and_partitions(spark, monkeypatch, shuffle, group):
    """A page keeps the same text whichever pages are its neighbours."""
    monkeypatch.setattr(pagetext, "GROUP_BYTES", group)
    menu = "home about contact imprint products services and many more things to see"
    rows = [(i, f"http://h{i % 2}.org/{i}", f"<div>{menu} on h{i % 2}</div><p>{prose(30, i)}</p><p>{prose(20, 100 + i // 12)}</p>") for i in range(24)]
    rows += [(30, "http://alone.org/", f"<p>{menu}</p>")] + [(40 + i, "http://copies.org/", f"<p>{prose(30, 200)}</p>") for i in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(shuffle))
    made = {r.page_id: (r.text, r.n_repeated) for r in pagetext.extract(df).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", old)
    want = {i: (prose(30, i), len(f"{menu} on h".split()) + 20) for i in range(24)}
    assert made == want | {30: (menu, 0)} | {40 + i: (prose(30, 200), 0) for i in range(3)}


def judged(url):
    """host, path, (rule, verdict)"""
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    best = None
    for r in linkgraph.RULES:
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (not best or len(r.name) > len(best.name)):
            best = r
    return host, path, best and best.name, best and best.verdict


def test_url_rules(spark):
    urls = [None, "", "x", "HTTP://A.Example.NET/en/1?q=/", "http://example.net/en", "http://notexample.net/en/1", "a://b.org/fr/x#y", "a://org/fr/", "a://b.com",
            "a://example.com/de/", "a://xexample.com/de/1", "a://s.example.com/de/1", "a://x.net?/en/", "a://x.org/fr", "a://b://c.net/", "a:///p", "É://É.NET/É", "a\nb://x.net/\n/y"]
    rows = [(i, u, None, "x") for i, u in enumerate(urls)] + [(None, urls[3], "", "x"), (3, urls[3], "<a href=//b.net/>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    made = linkgraph.filtered(df).collect()
    want = Counter((i, *judged(u)[:3]) for i, u, _, _ in rows)
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in made) == want
    by = {u: judged(u)[3] for u in urls}
    assert all(by[urls[r.page_id]] in (None, r.verdict) for r in made if r.page_id is not None)
    assert all(r.verdict in ("allow", "block") for r in made)
    assert linkgraph.filtered(df.where("page_id < 0")).count() == 0


def ranks(edges, seeds, damping=linkgraph.DAMPING, rounds=linkgraph.ROUNDS):
    total = Counter()
    for (s, _), w in edges.items():
        total[s] += w
    now = dict(seeds)
    for _ in range(rounds):
        new = {h: (1 - damping) * x for h, x in seeds.items()}
        for (s, t), w in edges.items():
            if s in now:
                new[t] = new.get(t, 0) + damping * now[s] * w / total[s]
        now = new
    return now


def test_propagation(spark):
    edges = {("a", "b"): 2.0, ("a", "c"): 1.0, ("b", "c"): 1.0, ("c", "a"): 3.0, ("c", "d"): 1.0, ("e", "a"): 1.0}
    seeds = {"a": 0.75, "e": 0.25}
    graph = spark.createDataFrame([(s, t, w) for (s, t), w in edges.items()], "source string, target string, weight double")
    made = linkgraph.propagated(graph, spark.createDataFrame(list(seeds.items()), "host string, start double"))
    assert {r.host: r.score for r in made.collect()} == pytest.approx(ranks(edges, seeds))


def test_links_decide_where_no_rule_does(spark):
    rows = [(i, f"http://bad{i}.net/", "") for i in range(5)] + [(10 + i, f"http://good{i}.org/fr/", "<a class=x href='https://Liked.info/a?b'>y</a>") for i in range(5)]
    rows += [(20, "http://spam.info/", "".join(f'<A HREF="http://bad{i}.net/x">z</A>' for i in range(5))), (21, "http://liked.info/", "<a href=/own>"), (22, "http://other.info/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    edges = {(r.source, r.target): r.weight for r in linkgraph.host_edges(df, "url", "html").collect()}
    assert edges == {("spam.info", f"bad{i}.net"): 1.0 for i in range(5)} | {(f"good{i}.org", "liked.info"): 1.0 for i in range(5)}
    verdict = {r.page_id: r.verdict for r in linkgraph.filtered(df).collect()}
    assert (verdict[20], verdict[21], verdict[22]) == ("block", "allow", "allow")


CHAT = [
    (1, 0, "user", "Hello there, friends.\n\nHow do I open the box?"),
    (1, 1, "assistant", "> How do I  OPEN the box?\nWith a key."),
    (1, 2, "user", "Is anyone else here?"),
    (1, 3, "user", "On Monday, A wrote:\n>> how do i open\n>> the box?\n> With a key.\n\nWhich key?"),
    (1, 4, "assistant", "> Is anyone else here?\nYes."),
    (1, 5, "user", "> nobody wrote this\nOdd."),
    (2, 0, "user", "How do I open the box?"),
    (2, 1, None, "> How do I open the box?\n> Is anyone else here?\n\n\n\nNo idea.\n"),
    (3, 0, "user", None), (3, 1, "user", ""), (None, 0, "user", "> Odd.\nx"), (4, None, "user", "y"), (1, 5, "user", "> nobody wrote this\nOdd."),
]


def test_quotes_are_linked(spark):
    df = spark.createDataFrame([(*r, "x") for r in CHAT], "conv_id long, turn long, role string, text string, parent string")
    made = quotes.reply_ordered(df).collect()
    assert len(made) == len(CHAT)
    by = {(r.conv_id, r.turn): r for r in made}
    assert {k: r.parent for k, r in by.items() if r.parent is not None} == {(1, 1): 0, (1, 3): 1, (1, 4): 2, (2, 1): 0}
    assert [by[1, t].thread for t in range(6)] == [0, 0, 2, 0, 2, 5]
    assert [by[1, t].text for t in (1, 3, 4)] == ["With a key.", "Which key?", "Yes."]
    assert by[2, 1].chat == "<|user|>\nNo idea.\n"
    order = [r.turn for r in sorted((r for r in made if r.conv_id == 1), key=lambda r: r.position)]
    assert order == [0, 1, 3, 2, 4, 5, 5]
    for conv in (1, 2, 3, 4, None):
        own = sorted(r.position for r in made if r.conv_id == conv)
        assert own == list(range(len(own)))
    assert quotes.reply_ordered(df.where("turn < 0")).count() == 0


def test_one_long_conversation_with_one_common_line(spark, monkeypatch):
    monkeypatch.setattr(quotes, "RUN", 16)
    rows = [(1, t, "user", "> the common line\nI say\nthe common line" if t % 5 == 0 else f"> unique passage {t - 3}\nunique passage {t}") for t in range(300)]
    made = {r.turn: r for r in quotes.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for t in range(300):
        if t % 5 == 0:
            assert made[t].parent == (t - 5 if t else None)
        else:
            assert made[t].parent == (t - 3 if (t - 3) % 5 and t >= 3 else None)


@pytest.mark.parametrize("seed", range(5))
def test_packed_windows(seed):
    """Numbers come back whole; short windows of a slice stay in order; a window's slice follows from its short form."""
    rng = np.random.default_rng(seed)
    windows = rng.integers(0, 1 << 64, 500 * seed, np.uint64, endpoint=False)
    windows = np.concatenate([windows, windows[:50], np.array([0, (1 << 64) - 1], np.uint64)])
    assert pagetext.unpacked_numbers(pagetext.packed_numbers(pagetext.distinct(windows)), len(set(windows.tolist()))).tolist() == sorted(set(windows.tolist()))
    for parts in (2, 9, 70):
        at, n = pagetext.slices_of(windows, parts)
        sent = dict(pagetext.slices_sent(windows, parts))
        assert max(sent) < n
        want = {int(k): sorted(set(pagetext.short(windows[at == k], parts).tolist())) for k in np.unique(at)}
        assert {k: x.tolist() for k, x in sent.items()} == want
    assert not list(pagetext.slices_sent(np.empty(0, np.uint64), 3))
