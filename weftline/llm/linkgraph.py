"""Verdicts on URLs by rules, and by trust that spreads over the links between hosts.

A rule names a host, with all its subdomains, and the beginning of a path; of the rules
that fit a URL the longest decides. Hosts are judged from the pages the rules decide: a
host of which at least half the pages are blocked is a blocked seed, one with allowed and no
blocked pages a trusted seed. Trust spreads from the trusted seeds along the links between
hosts (personalised PageRank), distrust from the blocked seeds against them. A host is
blocked when its distrust is at least ``MIN_DISTRUST`` of a seed's own and larger than its trust;
pages without a rule get the verdict of their host.

All steps are DataFrame operations. Page rows are never moved for the rules; links become
counts per pair of hosts before they are shuffled. Hosts without links, NULL URLs (an empty
host, never judged) and NULL pages are allowed unless a rule says otherwise. Repeated pages
count as often as they occur. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
DAMPING = 0.85
ROUNDS = 10
CUT_EVERY = 5
MIN_DISTRUST = 0.1

Rule = tuple[str, str, str]  # verdict, host, path


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for NULL and without ``://``."""
    host = F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest fitting rule as a struct of ``rule`` and ``verdict``, or NULL."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, prefix in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """``src``, ``dst``, ``weight``: share of the links of a host that lead to another host."""
    links = F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), lambda h: F.translate(h, UPPER, LOWER))
    targets = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.array_distinct(links)).alias("dst"))
    counted = targets.where("src <> dst and dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    total = counted.groupBy("src").agg(F.sum("n").alias("total"))
    return counted.join(total, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("weight"))


def spread(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """``host``, ``trust``, ``distrust`` after ``ROUNDS`` rounds from ``seeds`` (``host``, ``trust``, ``distrust``).

    Trust goes along the edges, distrust against them, in shares of the links that a host has or gets.
    """
    into = edges.groupBy("dst").agg(F.sum("weight").alias("total"))
    back = edges.join(into, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("weight") / F.col("total")).alias("weight"))
    ways = edges.withColumn("along", F.lit(True)).union(back.withColumn("along", F.lit(False)))
    ways = cut_lineage(ways, "links")
    start = seeds.select("host", ((1 - DAMPING) * F.col("trust")).alias("trust"), ((1 - DAMPING) * F.col("distrust")).alias("distrust"))
    now = start
    for i in range(ROUNDS):
        moved = now.join(ways, F.col("host") == F.col("src")).select(
            F.col("dst").alias("host"),
            F.when(F.col("along"), DAMPING * F.col("trust") * F.col("weight")).otherwise(0.0).alias("trust"),
            F.when(F.col("along"), 0.0).otherwise(DAMPING * F.col("distrust") * F.col("weight")).alias("distrust"),
        )
        now = start.union(moved).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        if (i + 1) % CUT_EVERY == 0:
            now = cut_lineage(now, "trust")
    return now


def judge(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Per row of ``pages`` (``page_id``, ``url``, ``html``): ``host``, ``path``, ``rule``, ``verdict``."""
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    ruled = parts.withColumn("_rule", longest_rule(F.col("host"), F.col("path"), rules))
    decided = F.col("_rule.verdict")
    share = ruled.where("host <> ''").groupBy("host").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(decided == "allow", 1)).alias("allowed"),
        F.count(F.when(decided == "block", 1)).alias("blocked"),
    )
    seeds = share.select(
        "host",
        F.when((F.col("allowed") > 0) & (F.col("blocked") == 0), 1.0).otherwise(0.0).alias("trust"),
        F.when(2 * F.col("blocked") >= F.col("n"), 1.0).otherwise(0.0).alias("distrust"),
    )
    scores = spread(cut_lineage(seeds.where("trust > 0 or distrust > 0"), "seeds"), host_edges(parts))
    least = (1 - DAMPING) * MIN_DISTRUST
    bad = scores.where((F.col("distrust") >= least) & (F.col("distrust") > F.col("trust"))).select("host", F.lit(True).alias("_bad"))
    rows = ruled.select("page_id", "host", "path", "_rule").join(bad, "host", "left")
    by_host = F.when(F.col("_bad"), "block").otherwise("allow")
    return rows.select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), by_host).alias("verdict")
    )
