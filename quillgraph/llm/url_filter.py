"""URL verdicts from host rules and, where none applies, from trust and distrust that spread over the link graph.

Everything is DataFrame work. Links are taken from the pages' anchors; they make weighted edges between hosts.
Trust is a personalised PageRank from the hosts with allowed urls, along the links; distrust is one from the
hosts with blocked urls, against the links, since a page answers for what it points to. Each host's verdict is
``block`` when its distrust outweighs its trust by more than ``threshold``.

Urls are folded to one row for each host before any shuffle, edges to one row for each pair of hosts, so a
host with a third of all pages is one combined row for each task. Each step of the iteration, of which there are as
many as it takes to settle, joins the edges with the ranks of hosts; ranks are staged in the shared folder, where every executor can read them.

Defined results: a null url or one without ``://`` has an empty host and path and no rule, and its verdict is
that of the empty host: allow, unless links say otherwise. Null html has no links. Repeated rows are judged
alike and count again. Null ids pass through. An empty table gives no rows. Of rules of one length that fit the
same url the first in order of text counts. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import discard, stage

DAMPING, ROUNDS, TOLERANCE, THRESHOLD = 0.85, 12, 1e-8, 0.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From after the first :// up to a slash, question mark, hash or the end, A to Z in lower case."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark, hash or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """(rule, verdict) as a struct: the longest rule that fits the host or a domain above it and the path's start."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1]), reverse=False):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n) over anchors with an absolute or protocol-relative address on another host."""
    target = F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""), F.lit(1))).alias("target")
    found = pages.select(host_of(F.col("url")).alias("src"), target).select("src", host_of(F.when(F.col("target").startswith("//"), F.concat(F.lit("x:"), "target")).otherwise(F.col("target"))).alias("dst"))
    return found.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, rank): personalised PageRank of ``seeds`` (host, seed; shares that sum to 1) along ``edges`` (src, dst, share).

    Rank that no edge carries on goes back to the seeds. One stage per round holds a row for each host. At least ``rounds``
    rounds are made, then more until one changes the ranks by ``tolerance`` or less, summed over hosts, and brings rank to
    no further host. So every host that a way leads to has some rank, however far from the seeds it is.
    """
    ranks = stage(seeds.select("host", "seed", F.col("seed").alias("rank")), "url_ranks")
    made = 0
    while True:
        moved = edges.join(ranks, edges.src == ranks.host).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("came"))
        joined = ranks.select("host", "seed", F.col("rank").alias("was")).join(moved, F.col("host") == F.col("dst"), "left").select("host", "seed", "was", (damping * F.coalesce("came", F.lit(0.0))).alias("came"))
        lost = joined.agg((1 - F.coalesce(F.sum("came"), F.lit(0.0))).alias("rest"))
        new = stage(joined.join(F.broadcast(lost)).select("host", "seed", "was", (F.col("came") + F.col("rest") * F.col("seed")).alias("rank")), "url_ranks")
        discard(ranks)
        made += 1
        ranks = new
        if made >= rounds:
            step = new.agg(F.coalesce(F.sum(F.abs(F.col("rank") - F.col("was"))), F.lit(0.0)).alias("change"), F.count_if((F.col("was") == 0) & (F.col("rank") > 0)).alias("reached")).first()
            if step.change <= tolerance and not step.reached:
                return ranks


def _shares(hosts: DataFrame, weight: str) -> DataFrame:
    total = hosts.agg(F.sum(weight).alias("all"))
    return hosts.join(F.broadcast(total)).select("host", F.coalesce(F.col(weight) / F.nullif("all", F.lit(0)), F.lit(0.0)).cast("double").alias("seed"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], threshold: float = THRESHOLD, rounds: int = ROUNDS) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages`` (page_id, url, html)."""
    url = F.col("url").cast("string")
    host, path = host_of(url), path_of(url)
    judged = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("by", rule_of(F.col("host"), F.col("path"), rules))
    links = stage(host_links(pages.select(url.alias("url"), F.col("html").cast("string").alias("html"))), "url_links")
    allowed, blocked = (F.count(F.when(F.col("by.verdict") == v, 1)).alias(v) for v in ("allow", "block"))
    known = judged.groupBy("host").agg(allowed, blocked)
    linked = links.select(F.explode(F.array("src", "dst")).alias("host")).distinct()
    hosts = stage(known.join(linked, "host", "full").select("host", F.coalesce("allow", F.lit(0)).alias("allow"), F.coalesce("block", F.lit(0)).alias("block")), "url_hosts")
    ways = []
    for source, target in (("src", "dst"), ("dst", "src")):
        out = links.groupBy(source).agg(F.sum("n").alias("total"))
        ways.append(links.join(out, source).select(F.col(source).alias("src"), F.col(target).alias("dst"), (F.col("n") / F.col("total")).alias("share")))
    trust = spread(_shares(hosts, "allow"), ways[0], rounds=rounds).select("host", F.col("rank").alias("trust"))
    distrust = spread(_shares(hosts, "block"), ways[1], rounds=rounds).select("host", F.col("rank").alias("distrust"))
    verdicts = trust.join(distrust, "host").select("host", F.when(F.col("distrust") - F.col("trust") > threshold, "block").otherwise("allow").alias("spread_verdict"))
    return judged.join(verdicts, "host", "left").select("page_id", "host", "path", F.col("by.rule").alias("rule"), F.coalesce("by.verdict", "spread_verdict", F.lit("allow")).alias("verdict"))
