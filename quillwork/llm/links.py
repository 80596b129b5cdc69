"""URL filter by rules and by trust that spreads over links between hosts (operator 8).

Two scores run over host edges. Trust is a personalised PageRank from hosts whose pages the rules allow, along the
links. Distrust is the reversed one, from hosts whose pages the rules block: the share of a host's own links that
lead to distrusted hosts, damped at each step, which the number of other linkers does not thin out. Scores are
long integers in units of 1/UNIT, rounded down edge by edge, so that the order of summing has no effect.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Scratch

UNIT = 10**12
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
LINK = r"(?i)\bhref\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s>]+)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def fitting_rule(rules: dict[str, str], host: str = "host", path: str = "path") -> Column:
    """The longest of a short list of rules ("host/path" to verdict) that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        own, _, rest = rule.partition("/")
        out = F.when(((F.col(host) == own) | F.endswith(F.col(host), F.lit(f".{own}"))) & F.startswith(F.col(path), F.lit(f"/{rest}")), rule).otherwise(out)
    return out


def host_edges(pages: DataFrame, host: str = "host", html: str = "html") -> DataFrame:
    """src, dst and the number of links between different hosts. Links without a host stay on their own; pages without one
    have no links."""
    found = pages.where(F.col(host) != "").select(F.col(host).alias("src"), F.explode(F.regexp_extract_all(html, F.lit(LINK), 1)).alias("dst"))
    return found.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("links"))


def rounds(keep: float, tolerance: float) -> int:
    """After so many rounds no score is further than ``tolerance`` from its limit."""
    return math.ceil(math.log(tolerance) / math.log(keep))


def spread(scratch: Scratch, hosts: DataFrame, edges: DataFrame, *, keep: float = 0.85, tolerance: float = 1e-3) -> DataFrame:
    """host, trust ``t`` and distrust ``d`` from ``hosts`` (host, trust, distrust: seeds in units), at most ``tolerance`` off.

    A host without a link onwards keeps the trust that would have left it; a host's distrust is its own at least.
    A round shrinks what is missing by ``keep``; rounds end when the last change shows that little enough is missing.
    """
    out = edges.groupBy(F.col("src").alias("host")).agg(F.sum("links").alias("out"))
    into = edges.select(F.col("dst").alias("host")).distinct()
    nodes = hosts.join(out, "host", "full").join(into, "host", "full").select("host", *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("trust", "distrust", "out")))
    state = scratch.cut(nodes.withColumn("t", F.col("trust")).withColumn("d", F.col("distrust")))
    shares = scratch.cut(edges.join(out.withColumnRenamed("host", "src"), "src").select("src", "dst", (F.col("links") / F.col("out")).alias("share")))
    little = tolerance * (1 - keep) / keep * UNIT
    for _ in range(rounds(keep, tolerance)):
        scored = state.where("t > 0 or d > 0").select("host", "t", "d")
        trust = shares.join(scored.where("t > 0").withColumnRenamed("host", "src"), "src").select(F.col("dst").alias("host"), F.floor(F.col("t") * F.col("share")).alias("a"), F.lit(0).cast("long").alias("b"))
        distrust = shares.join(scored.where("d > 0").withColumnRenamed("host", "dst"), "dst").select(F.col("src").alias("host"), F.lit(0).cast("long").alias("a"), F.floor(F.col("d") * F.col("share")).alias("b"))
        got = trust.unionAll(distrust).groupBy("host").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        a, b = (F.coalesce(c, F.lit(0)) for c in ("a", "b"))
        moved = state.join(got, "host", "left").select(
            "host", "trust", "distrust", "out", F.col("t").alias("t0"), F.col("d").alias("d0"),
            F.round((1 - keep) * F.col("trust") + keep * F.when(F.col("out") > 0, a).otherwise(a + F.col("t"))).cast("long").alias("t"),
            F.greatest("distrust", F.round(keep * b).cast("long")).alias("d"),
        )
        last, state = state, scratch.cut(moved)
        scratch.drop(last)
        change = state.agg(F.sum(F.abs(F.col("t") - F.col("t0"))).alias("t"), F.max(F.abs(F.col("d") - F.col("d0"))).alias("d")).first()
        if (change.t or 0) <= little and (change.d or 0) <= little:
            break
    return state.select("host", "t", "d")


def judge(pages: DataFrame, rules: dict[str, str], *, url: str = "url", html: str = "html", threshold: float = 0.5, keep: float = 0.85, tolerance: float = 1e-3) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (the longest fitting one, or null) and ``verdict``.

    A rule decides where one fits. Elsewhere a page is blocked if its host's distrust is at least ``threshold`` and more
    than its trust; a host starts with the share of its pages that rules allow, or block. A null url, or one without
    "://", has an empty host and path; such pages have nothing in common, so they seed and link nothing and are
    allowed. Repeated pages count as often as they come; an empty table gives an empty one; input columns named like
    an output are replaced.
    """
    new = {"host", "path", "rule", "verdict"}
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in new]
    parsed = pages.select(*kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    ruled = parsed.withColumn("rule", fitting_rule(rules))
    by_rule = F.coalesce(*(F.when(F.col("rule") == r, v) for r, v in rules.items())) if rules else F.lit(None).cast("string")
    share = lambda v: F.floor(F.lit(UNIT) * (F.count_if(by_rule == v) / F.count("*")))
    hosts = ruled.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    with Scratch(pages.sparkSession) as scratch:
        edges = scratch.cut(host_edges(parsed, "host", html))
        scores = spread(scratch, hosts, edges, keep=keep, tolerance=tolerance)
        bad = scratch.keep(scratch.cut(scores.where((F.col("d") >= int(threshold * UNIT)) & (F.col("d") > F.col("t"))).select("host", F.lit("block").alias("verdict"))))
    return ruled.join(bad, "host", "left").select(*kept, "host", "path", "rule", F.coalesce(by_rule, F.col("verdict"), F.lit("allow")).alias("verdict"))
