"""URL filters by link-graph propagation, in DataFrame operations only.

Links of the pages become weighted edges between hosts. Trust flows along them from allowed hosts, distrust against them from
blocked hosts, both as personalised PageRank by power iteration. Rules decide where one fits; elsewhere the host's balance of
trust and distrust does.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMPING, ROUNDS = 0.85, 12
#: A host is blocked if its distrust exceeds its trust by more than this share of what one host would have on average.
MARGIN = 0.5


@dataclass(frozen=True)
class Rule:
    """``block`` or ``allow`` a host with all its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def longest(rules: tuple[Rule, ...], host: Column, path: Column, value) -> Column:
    """``value`` of the longest rule that fits; ties go to the rule named first."""
    out = F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.name)):
        out = F.when(fits(rule, host, path), F.lit(value(rule))).otherwise(out)
    return out


def host_edges(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(source, target, weight): links between hosts, each page's links to one host counted once; loops left out.

    A link is a ``href`` of an ``a`` element with a host of its own, or a relative one, which stays on the host.
    """
    link = r"(?i)<a\s[^>]*?href\s*=\s*[\"']?([^\"'\s>]+)"
    links = F.array_distinct(F.transform(F.regexp_extract_all(F.col(html_col), F.lit(link), 1), _target))
    rows = pages.select(host_of(F.col(url_col)).alias("source"), F.explode(links).alias("target"))
    rows = rows.where("source <> '' and target <> '' and source <> target")
    return rows.groupBy("source", "target").agg(F.count("*").cast("double").alias("weight"))


def _target(link: Column) -> Column:
    link = F.regexp_replace(link, "&amp;", "&")
    return F.when(link.rlike(r"^(?i)https?://"), host_of(link)).when(link.startswith("//"), host_of(F.concat(F.lit("http:"), link))).otherwise("")


def site_edges(hosts: DataFrame) -> DataFrame:
    """(source, target, weight): each host and its parent domains, both ways, so that a site's subdomains share a standing.

    Parents have at least two labels. The number of edges is the hosts' number of labels.
    """
    labels = F.split("host", "\\.")
    n = F.size(labels)
    parents = hosts.where(F.col("host").contains(".")).select("host", F.array_join(F.slice(labels, F.lit(2), F.greatest(n - 1, F.lit(1))), ".").alias("parent"))
    parents = parents.where(F.col("parent").contains(".")).distinct()
    up = parents.select(F.col("host").alias("source"), F.col("parent").alias("target"), F.lit(1.0).alias("weight"))
    down = parents.select(F.col("parent").alias("source"), F.col("host").alias("target"), F.lit(1.0).alias("weight"))
    return up.unionByName(down)


def propagated(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, score): personalised PageRank over ``edges`` from ``seeds`` (host, start; the starts sum to 1).

    What reaches a host without outgoing edges ends there. Sums combine before the shuffle, so a host that very many others
    link to is no single task's work.
    """
    out = edges.groupBy("source").agg(F.sum("weight").alias("total"))
    shares = written(edges.join(out, "source").select("source", "target", (F.col("weight") / F.col("total")).alias("share")))
    restart = seeds.select("host", ((1 - damping) * F.col("start")).alias("score"))
    ranks = seeds.select("host", F.col("start").alias("score"))
    for k in range(rounds):
        moved = shares.join(ranks.withColumnRenamed("host", "source"), "source")
        moved = moved.select(F.col("target").alias("host"), (damping * F.col("share") * F.col("score")).alias("score"))
        ranks = moved.unionByName(restart).groupBy("host").agg(F.sum("score").alias("score"))
        if k % 4 == 3:
            ranks = written(ranks)
    return ranks


def filtered(
    pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", margin: float = MARGIN
) -> DataFrame:
    """One row per row of ``pages``: id, ``host``, ``path``, ``rule``, ``verdict``, ``trust``, ``distrust``.

    A rule fits a host and its subdomains where the path starts with the rule's; the longest wins and decides. Other pages
    are blocked if their host's distrust exceeds its trust by ``margin`` times the mean score of a host. Seeds are the hosts
    of pages that a rule decides, weighted by those pages: allowed ones send trust along links, blocked ones distrust
    against them. A null url, or one without ``://``, has an empty host and path, no rule, no standing, and is allowed. Null
    html has no links. Repeated rows are judged one by one. Other columns are not read.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    known = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    ruled = known.select(id_col, "host", "path", longest(rules, F.col("host"), F.col("path"), lambda r: r.name).alias("rule"), longest(rules, F.col("host"), F.col("path"), lambda r: r.verdict).alias("_by_rule"))
    hosts = written(
        ruled.where("host <> ''").groupBy("host").agg(
            F.count(F.when(F.col("_by_rule") == "allow", 1)).alias("allowed"), F.count(F.when(F.col("_by_rule") == "block", 1)).alias("blocked")
        )
    )
    edges = written(host_edges(pages, url_col, html_col).unionByName(site_edges(hosts)).groupBy("source", "target").agg(F.sum("weight").alias("weight")))
    against = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "weight")

    sums = hosts.agg(F.count("*").alias("hosts"), F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked")).first()

    def scores(graph: DataFrame, count: str, name: str) -> DataFrame:
        seeds = hosts.where(f"{count} > 0").select("host", (F.col(count) / F.lit(sums[count] or 1)).alias("start"))
        return propagated(graph, written(seeds)).withColumnRenamed("score", name)

    standing = hosts.select("host").join(scores(edges, "allowed", "trust"), "host", "left").join(scores(against, "blocked", "distrust"), "host", "left")
    standing = standing.fillna(0.0, ["trust", "distrust"])
    standing = standing.withColumn("_bad", F.col("distrust") - F.col("trust") > margin / (sums["hosts"] or 1))
    out = ruled.join(standing, "host", "left")
    verdict = F.coalesce("_by_rule", F.when(F.col("_bad"), "block").otherwise("allow")).alias("verdict")
    digits = [F.round(F.coalesce(c, F.lit(0.0)), 12).alias(c) for c in ("trust", "distrust")]
    return out.select(id_col, "host", "path", "rule", verdict, *digits)
