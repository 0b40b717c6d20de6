"""URL filter by rules and by trust that spreads over the host graph.

Rules decide the pages they fit.  For the rest, two personalised PageRanks run over the graph of hosts:
trust starts on hosts with pages that a rule allows and follows the edges; distrust starts on
hosts with pages that a rule blocks and follows the edges backwards (who points at a bad host
is suspect).  Both start with the number of pages that the rules judged so, hence the two scores of a
host compare directly: a host with more distrust than ``ratio`` times its trust is blocked.  Scores are
not rounded or divided by the size of the table; they are compared up to a relative ``TOLERANCE``.

Rounds go on until no score grows by more than ``SETTLED`` of itself, so trust and distrust reach every
host they can reach, however long the way (0.85 a link: doubles end after about 4,000 links).

Edges: links from a page to another host (weighted by the pages that carry the link), and each host
with the domain above it, both ways, as hosts of one domain share an owner.  Relative links
stay on the host and add no edge.  Everything is DataFrame work on the (host, host) table, which a
map-side sum shrinks before any shuffle; a rank round is one join and one sum.  A graph of at most ``SMALL`` edges
runs the same rounds in the driver's memory.

Defined results: a null url or one without ``://`` has an empty host and path, no rule, and is
allowed, as it has no host to hold anything against; a null html has no links; repeated rows are
judged alike; null page ids are kept; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import cut, join_checked

#: (host, path, verdict): fits the host and its subdomains if the url's path starts with the path.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
DAMPING = 0.85
#: Rounds end when no score changes by more than this share of itself.
SETTLED = 1e-11
#: Relative difference up to which trust and distrust count as equal, far above what unsettled rounds and the
#: order of sums leave.
TOLERANCE = 1e-9
#: Edges (both directions) up to which the rounds run in the driver.
SMALL = 100_000
RATIO = 1.0
#: Rules become one expression; longer lists belong in a table joined on host suffixes.
MOST_RULES = 1000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null; of equally long ones a block wins."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules, at most {MOST_RULES} fit one expression")
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[2] == "block", r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def link_hosts(html: Column) -> Column:
    """Hosts of the links of a page that name one."""
    pattern = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(pattern), 1)
    return F.array_distinct(F.transform(found, lambda h: F.translate(h, _UPPER, _LOWER)))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) from ``host`` and ``links`` of the pages, without loops."""
    links = (pages.select("host", F.explode("links").alias("dst")).where("host != '' and dst != host")
             .groupBy(F.col("host").alias("src"), "dst").agg(F.count(F.lit(1)).cast("double").alias("weight")))
    hosts = pages.select("host").union(links.select("dst")).where("host != ''").distinct()
    # every domain above a host that still has two labels: a.b.c.d gives (a.b.c.d, b.c.d), (b.c.d, c.d)
    labels = F.split("host", r"\.")
    chain = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
                        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    steps = (hosts.withColumn("chain", chain).select(F.explode(F.arrays_zip(
        F.slice("chain", 1, F.greatest(F.size("chain") - 1, F.lit(0))).alias("low"),
        F.slice("chain", 2, F.greatest(F.size("chain") - 1, F.lit(0))).alias("high"))).alias("x"))
        .select("x.low", "x.high").distinct())
    above = steps.select(F.col("low").alias("src"), F.col("high").alias("dst"), F.lit(1.0).alias("weight")).union(
        steps.select(F.col("high").alias("src"), F.col("low").alias("dst"), F.lit(1.0).alias("weight")))
    return links.union(above).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def _settle(messages: DataFrame, start: DataFrame, damping: float, rounds: int | None) -> DataFrame:
    """The rounds of ``propagate`` in the driver, for small graphs."""
    edges, seeds = messages.toArrow(), start.toArrow()
    hosts = seeds["host"].to_pylist()
    at = {h: i for i, h in enumerate(hosts)}
    sender, receiver = (np.array([at[h] for h in edges[c].to_pylist()], np.int64) for c in ("sender", "receiver"))
    ranks = []
    for kind in ("trust", "distrust"):
        share, seed = edges[f"{kind}_share"].to_numpy(), seeds[f"{kind}_seed"].to_numpy().astype(float)
        rank, done = seed, 0
        while rounds is None or done < rounds:
            new = (1 - damping) * seed + damping * np.bincount(receiver, rank[sender] * share, len(hosts))
            change, rank, done = np.abs(new - rank), new, done + 1
            if rounds is None and (change <= SETTLED * new).all():
                break
        ranks.append(rank)
    return start.sparkSession.createDataFrame(list(zip(hosts, *(r.tolist() for r in ranks))), "host string, trust double, distrust double")


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int | None = None, small: int = SMALL) -> DataFrame:
    """(host, trust, distrust) from ``edges`` (src, dst, weight) and ``seeds`` (host, trust, distrust), after the
    rounds given or else when all scores have settled.

    A message table holds each edge once forwards (for trust) and once backwards (for distrust), with the
    share of its sender.  The mass of hosts without edges in a direction leaves the graph.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    into = edges.groupBy("dst").agg(F.sum("weight").alias("total"))
    ahead = edges.join(out, "src").select(
        F.col("src").alias("sender"), F.col("dst").alias("receiver"), (F.col("weight") / F.col("total")).alias("trust_share"),
        F.lit(0.0).alias("distrust_share"))
    back = edges.join(into, "dst").select(
        F.col("dst").alias("sender"), F.col("src").alias("receiver"), F.lit(0.0).alias("trust_share"),
        (F.col("weight") / F.col("total")).alias("distrust_share"))
    messages = cut(ahead.union(back).groupBy("sender", "receiver").agg(
        F.sum("trust_share").alias("trust_share"), F.sum("distrust_share").alias("distrust_share")), "host-messages")
    start = cut(seeds.select("host", F.col("trust").alias("trust_seed"), F.col("distrust").alias("distrust_seed"))
                .unionByName(messages.select(F.col("sender").alias("host"), F.lit(0.0).alias("trust_seed"),
                                             F.lit(0.0).alias("distrust_seed")).distinct())
                .groupBy("host").agg(F.sum("trust_seed").alias("trust_seed"), F.sum("distrust_seed").alias("distrust_seed")),
                "host-seeds")
    if messages.count() <= small and start.count() <= small:
        return _settle(messages, start, damping, rounds)
    rank = start.select("host", F.col("trust_seed").alias("trust"), F.col("distrust_seed").alias("distrust"))
    moves = F.lit(False)
    for kind in ("trust", "distrust"):
        moves = moves | (F.abs(F.col(kind) - F.col(f"{kind}_before")) > SETTLED * F.col(kind))
    done = 0
    while rounds is None or done < rounds:
        got = (messages.join(rank, messages.sender == rank.host).groupBy("receiver").agg(
            F.sum(F.col("trust") * F.col("trust_share")).alias("trust_in"),
            F.sum(F.col("distrust") * F.col("distrust_share")).alias("distrust_in")))

        def mixed(kind):
            return (F.lit(1 - damping) * F.col(f"{kind}_seed")
                    + F.lit(damping) * F.coalesce(F.col(f"{kind}_in"), F.lit(0.0))).alias(kind)

        before = rank.select(F.col("host").alias("same"), F.col("trust").alias("trust_before"), F.col("distrust").alias("distrust_before"))
        step = cut(start.join(got, start.host == got.receiver, "left").join(before, start.host == before.same)
                   .select("host", mixed("trust"), mixed("distrust"), "trust_before", "distrust_before"), "host-rank")
        rank, done = step.select("host", "trust", "distrust"), done + 1
        if rounds is None and step.where(moves).isEmpty():
            break
    return rank


def judge(pages: DataFrame, rules=RULES, damping: float = DAMPING, rounds: int | None = None, ratio: float = RATIO) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust, for every page."""
    parsed = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host_of(F.col("url")).alias("host"),
                          path_of(F.col("url")).alias("path"), link_hosts(F.col("html")).alias("links"))
    parsed = cut(parsed.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)), "pages-parsed")
    seeds = parsed.where("host != ''").groupBy("host").agg(
        F.count(F.when(F.col("fit.verdict") == "allow", 1)).cast("double").alias("trust"),
        F.count(F.when(F.col("fit.verdict") == "block", 1)).cast("double").alias("distrust"))
    rank = propagate(cut(host_edges(parsed), "host-edges"), seeds, damping, rounds)
    joined = join_checked(parsed.drop("links"), rank, ["host"], "left", "host-scores")
    own = F.when(F.col("distrust") > F.col("trust") * (ratio * (1 + TOLERANCE)), "block").otherwise("allow")
    return joined.select("page_id", "host", "path", F.col("fit.rule").alias("rule"),
                         F.coalesce(F.col("fit.verdict"), own).alias("verdict"), "trust", "distrust")
