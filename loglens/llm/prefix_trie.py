"""Prefix trie of conversations with a depth-band rollup of subtree totals.

Nodes are found without walking the tree.  Turn ``d`` of a conversation becomes two 64-bit hashes bound to its
depth, split into four 32-bit parts; the running sums of the parts name the prefix (128 bits), so the
conversations that share a prefix meet in a plain grouped count.

Totals of subtrees (leaves, saved tokens) are rolled up by bands of ``BAND`` depths.  Every node explodes only to its
ancestors within its band, at most ``BAND`` rows.  The tops of the bands then form a tree of their own that is
``BAND`` times flatter; its totals come from the same rollup, one level up, and a completed top's total goes once
more to the ancestors above it in the next band.  A tree of depth D takes log D / log BAND levels.

Scale: turns are dealt by ranges of (conversation, turn), so a conversation of any length spreads over
tasks; positions and running sums inside a range are completed by the sums of the ranges before it (one row per
conversation and range).  Nodes of many members collapse in the partial aggregates.  The members that end in
a node are hashed in ascending runs of ids (``ENDS`` ids a run at most); a node with several runs streams them
through one digest, whose input cannot be split.  All steps but that digest are JVM expressions.

Defined results: rows without conv_id belong to no conversation; a null role or text is the empty one; turns go by
turn (null first), then role, then text, so ties and repeated rows have one order (repeated rows are
turns of their own); other columns are not read; an empty table has no nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglens.llm.common import cut, map_arrow

#: Depths of a band.
BAND = 8
#: Turns that a conversation takes from its base are fewer than this; bases repeat every BASES ids.
HEADS = 9
BASES = 5
#: Ids of one run of a node's ends span less than this.
ENDS = 4096

_PARTS = ["p1", "p2", "p3", "p4"]
_KEY = ["depth", "a", "b"]


def _halves(x: Column) -> list[Column]:
    return [F.shiftrightunsigned(x, 32), x.bitwiseAND(0xFFFFFFFF)]


def _bound(depth: Column) -> list[Column]:
    """The four parts of a turn's hash at a depth."""
    return [h.alias(p) for p, h in zip(_PARTS, [
        half for seed in (1, 2) for half in _halves(F.xxhash64(F.lit(seed), depth, "h1", "h2"))])]


def _packed(high: str, low: str) -> Column:
    return F.shiftleft(F.col(high).bitwiseAND(0xFFFFFFFF), 32).bitwiseOR(F.col(low).bitwiseAND(0xFFFFFFFF))


def ordered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, run, pos (from 1 within the conversation), h1, h2 and bytes of every turn.

    A run is the part of a conversation in one range of the sort; the result is a written table.
    """
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # the last key parts equal rows, so that copies of a row can lie in several ranges; their order changes nothing
    rows = rows.withColumn("copy", F.monotonically_increasing_id())
    keys = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("text"), F.col("copy")]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    placed = cut(dealt.select("conv_id", F.shiftright(at, 33).alias("run"), at.alias("at"),
                              F.xxhash64(F.lit(1), "role", "text").alias("h1"), F.xxhash64(F.lit(2), "role", "text").alias("h2"),
                              F.octet_length("text").cast("bigint").alias("bytes")), "trie-turns")
    runs = placed.groupBy("conv_id", "run").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("conv_id", "run", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("shift"))
    return cut(placed.join(runs, ["conv_id", "run"]).select("conv_id", "run", (F.col("at") + F.col("shift")).alias("pos"),
                                                          "h1", "h2", "bytes"), "trie-positions")


def rebuilt(turns: DataFrame) -> DataFrame:
    """The visits of rebuilt conversations: conv_id, depth, the node's key (a, b), its parent's (up_a, up_b), the
    bytes of its last text and whether the conversation ends there.  Every conversation visits the root."""
    placed = ordered_turns(turns)
    lengths = placed.groupBy("conv_id").agg(F.max("pos").alias("own"))
    # the first turns of bases, with running sums of their parts
    upto = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    heads = (placed.where((F.col("pos") < HEADS) & (F.col("conv_id") % BASES == 0))
             .select("conv_id", "pos", "bytes", *_bound(F.col("pos")))
             .select("conv_id", "pos", "bytes", *[F.col(p).alias("m" + p) for p in _PARTS], *[F.sum(p).over(upto).alias(p) for p in _PARTS]))
    heads = cut(heads.withColumnRenamed("conv_id", "base"), "trie-heads")
    # per conversation: turns taken from the base, turns left out of its own, where its own sums start
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    bases = lengths.where(F.col("conv_id") % BASES == 0).select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    convs = (lengths.withColumn("skip", taken).withColumn("base", F.col("conv_id") - F.col("conv_id") % BASES)
             .join(bases, "base", "left").withColumn("take", F.least("skip", F.coalesce("base_own", F.lit(0)))))
    last = heads.select("base", F.col("pos").alias("take"), *_PARTS)
    convs = convs.join(last, ["base", "take"], "left").select(
        "conv_id", "base", "skip", "take", (F.col("take") + F.greatest(F.col("own") - F.col("skip"), F.lit(0))).alias("length"),
        *[F.coalesce(p, F.lit(0)).alias("s" + p) for p in _PARTS])
    convs = cut(convs, "trie-conversations")
    shared = convs.select("conv_id", "base", "take", "length").join(heads, "base").where("pos <= take").select(
        "conv_id", F.col("pos").alias("depth"), "bytes", "length", *["m" + p for p in _PARTS], *_PARTS)
    # own turns: running sums inside a run, then the sums of the conversation's runs before it
    within = Window.partitionBy("conv_id", "run").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    known = placed.select("conv_id", "run").distinct().join(convs, "conv_id")
    own = (placed.join(known.select("conv_id", "run", "skip", "take", "length"), ["conv_id", "run"]).where("pos > skip")
           .withColumn("depth", F.col("pos") - F.col("skip") + F.col("take"))
           .select("conv_id", "run", "depth", "bytes", "length", *_bound(F.col("depth")))
           .select("conv_id", "run", "depth", "bytes", "length", *[F.col(p).alias("m" + p) for p in _PARTS],
                   *[F.sum(p).over(within).alias(p) for p in _PARTS]))
    own = cut(own, "trie-own")
    earlier = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    sums = own.groupBy("conv_id", "run").agg(*[F.max(p).alias(p) for p in _PARTS])  # parts are not negative
    sums = sums.select("conv_id", "run", *[F.coalesce(F.sum(p).over(earlier), F.lit(0)).alias("r" + p) for p in _PARTS])
    sums = sums.join(convs.select("conv_id", *["s" + p for p in _PARTS]), "conv_id").select(
        "conv_id", "run", *[(F.col("r" + p) + F.col("s" + p)).alias("r" + p) for p in _PARTS])
    own = own.join(sums, ["conv_id", "run"]).select(
        "conv_id", "depth", "bytes", "length", *["m" + p for p in _PARTS], *[(F.col(p) + F.col("r" + p)).alias(p) for p in _PARTS])
    keyed = shared.unionByName(own).withColumns({"u" + p: F.col(p) - F.col("m" + p) for p in _PARTS}).select(
        "conv_id", "depth", _packed("p1", "p2").alias("a"), _packed("p3", "p4").alias("b"), _packed("up1", "up2").alias("up_a"),
        _packed("up3", "up4").alias("up_b"), "bytes", (F.col("depth") == F.col("length")).alias("ends"))
    zero = F.lit(0).cast("bigint")
    roots = convs.select("conv_id", zero.alias("depth"), zero.alias("a"), zero.alias("b"), zero.alias("up_a"), zero.alias("up_b"),
                         zero.alias("bytes"), (F.col("length") == 0).alias("ends"))
    return cut(keyed.unionByName(roots), "trie-visits")


def trie_nodes(visits: DataFrame) -> DataFrame:
    """depth, a, b, up_a, up_b, conv_id (smallest member), n_convs, n_ends, bytes of every node."""
    return cut(visits.groupBy(*_KEY).agg(
        F.max("up_a").alias("up_a"), F.max("up_b").alias("up_b"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
        F.count_if("ends").alias("n_ends"), F.max("bytes").alias("bytes")), "trie-nodes")


def rollup(nodes: DataFrame, visits: DataFrame, sums: list[str], band: int = BAND) -> DataFrame:
    """depth, a, b and, for each column of ``sums``, its total over the node's subtree.

    ``nodes`` has depth, a, b, conv_id (a member) and the columns; ``visits`` has conv_id, depth, a, b for every
    conversation and depth.
    """
    level = F.floor(F.col("depth") / band)
    # the nodes that a conversation visits in a band, at most ``band`` of them
    bands = cut(visits.groupBy("conv_id", level.alias("band"))
                .agg(F.collect_list(F.struct(*_KEY)).alias("visited")), "trie-bands")
    deepest = nodes.agg(F.max("depth")).first()[0]

    def given(rows: DataFrame, kept: Column) -> DataFrame:
        """What rows (conv_id, band, depth and sums) give to the nodes of the band that ``kept`` lets through."""
        met = rows.join(bands, ["conv_id", "band"]).select(F.col("depth").alias("from"), F.explode("visited").alias("v"), *sums)
        return met.where(kept).select("v.*", *sums)

    up = nodes.select("conv_id", level.alias("band"), "depth", *sums)
    inside = F.col("v.depth") <= F.col("from")
    if deepest is None or deepest < band:
        return given(up, inside).groupBy(*_KEY).agg(*[F.sum(s).alias(s) for s in sums])
    top = F.col("v.depth") % band == 0
    # totals of each band's top over its own band, and the top's member
    tops = nodes.where(F.col("depth") % band == 0).select(*_KEY, "conv_id", *[F.lit(0).cast("bigint").alias(s) for s in sums])
    tops = tops.unionByName(given(up, inside & top).withColumn("conv_id", F.lit(None).cast("bigint")))
    tops = tops.groupBy(*_KEY).agg(F.max("conv_id").alias("conv_id"), *[F.sum(s).alias(s) for s in sums])
    tops = cut(tops.withColumn("depth", (F.col("depth") / band).cast("bigint")), "trie-tops")
    above = visits.where(F.col("depth") % band == 0).withColumn("depth", (F.col("depth") / band).cast("bigint"))
    done = rollup(tops, cut(above.select("conv_id", *_KEY), "trie-top-visits"), sums, band)
    done = cut(done.join(tops.select(*_KEY, "conv_id"), _KEY), "trie-top-totals")
    # completed tops give their totals to the band above
    down = done.where("depth > 0").select("conv_id", (F.col("depth") - 1).alias("band"), (F.col("depth") * band).alias("depth"), *sums)
    rest = given(up, inside & ~top).unionByName(given(down, ~top)).groupBy(*_KEY).agg(*[F.sum(s).alias(s) for s in sums])
    return rest.unionByName(done.withColumn("depth", F.col("depth") * band).select(*_KEY, *sums))


def _stream_digests(batches):
    """One SHA-256 per node over its runs of ids, which arrive in order."""
    import hashlib

    import pyarrow as pa

    node, digest, out = None, None, []

    def flush():
        keys = list(zip(*out)) or [[]] * 4
        out.clear()
        return pa.RecordBatch.from_arrays([*(pa.array(k, pa.int64()) for k in keys[:3]), pa.array(keys[3], pa.string())],
                                          [*_KEY, "ends_sha256"])

    for batch in batches:
        for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*_KEY, "ids"))):
            if key != node:
                if node is not None:
                    out.append((*node, digest.hexdigest()))
                node, digest = key, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if len(out) >= 10_000:
            yield flush()
    if node is not None:
        out.append((*node, digest.hexdigest()))
    if out:
        yield flush()


def ends(visits: DataFrame) -> DataFrame:
    """depth, a, b and the digest of the ascending ids that end there, for nodes where any does."""
    run = F.floor(F.col("conv_id") / ENDS)
    runs = visits.where("ends").groupBy(*_KEY, run.alias("run")).agg(F.collect_list("conv_id").alias("ids"))
    runs = cut(runs.select(*_KEY, "run", F.array_join(F.transform(F.array_sort("ids"), lambda x: x.cast("string")), ",").alias("ids")),
               "trie-ends")
    count = runs.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("runs"), F.max("ids").alias("ids"))
    single = count.where("runs = 1").select(*_KEY, F.sha2("ids", 256).alias("ends_sha256"))
    several = runs.join(count.where("runs > 1").select(*_KEY), _KEY, "left_semi")
    dealt = several.repartition(*_KEY).sortWithinPartitions(*_KEY, "run").select(*_KEY, "ids")
    return single.unionByName(map_arrow(dealt, _stream_digests, "depth bigint, a bigint, b bigint, ends_sha256 string"))


def trie(turns: DataFrame, band: int = BAND) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (see the module's head)."""
    visits = rebuilt(turns)
    nodes = trie_nodes(visits)
    own = nodes.select(*_KEY, "conv_id", (F.col("n_convs") == F.col("n_ends")).cast("bigint").alias("n_leaves"),
                       ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    totals = rollup(own, visits.select("conv_id", *_KEY), ["n_leaves", "saved_tokens"], band)
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")) \
        .agg(F.count(F.lit(1)).alias("n_children"))
    # one row per node from each side: no key is hot here
    out = (nodes.join(totals, _KEY).join(children, _KEY, "left").join(ends(visits), _KEY, "left"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"),
                           F.col("conv_id").alias("parent_conv_id"))
    # a parent of many children is split by adaptive execution: its own side has one row
    out = out.join(parents, ["depth", "up_a", "up_b"], "left")
    return out.select("conv_id", F.col("depth").cast("bigint").alias("depth"), "parent_conv_id", "n_convs",
                      F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"), "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def oracle() -> str:
    """The same rows in DuckDB: prefixes as joined digests, every pair of a node and an ancestor spelled out."""
    return f"""
WITH RECURSIVE bits AS (
  SELECT i AS byte, 0 AS k, CAST(i AS BIGINT) AS v FROM range(256) r(i)
  UNION ALL SELECT byte, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, CAST(3988292384 AS BIGINT)) ELSE v >> 1 END FROM bits WHERE k < 8),
crc_table AS (SELECT byte, v FROM bits WHERE k = 8),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
        ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
lengths AS (SELECT conv_id, max(pos) AS own FROM t GROUP BY conv_id),
digits AS (
  SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, 0 AS k, CAST(4294967295 AS BIGINT) AS v FROM lengths
  UNION ALL SELECT d.conv_id, d.s, d.k + 1, xor(d.v >> 8, c.v) FROM digits d
    JOIN crc_table c ON c.byte = xor(d.v, CAST(ascii(substr(d.s, d.k + 1, 1)) AS BIGINT)) & 255 WHERE d.k < length(d.s)),
convs AS (SELECT l.conv_id, l.own, l.conv_id - l.conv_id % {BASES} AS base, xor(d.v, CAST(4294967295 AS BIGINT)) % {HEADS} AS h
  FROM lengths l JOIN digits d ON d.conv_id = l.conv_id AND d.k = length(d.s)),
taken AS (SELECT c.*, least(c.h, coalesce(b.own, 0)) AS take FROM convs c LEFT JOIN lengths b ON b.conv_id = c.base),
turns AS (
  SELECT c.conv_id, t.pos AS depth, t.role, t.text FROM taken c JOIN t ON t.conv_id = c.base AND t.pos <= c.take
  UNION ALL SELECT c.conv_id, t.pos - c.h + c.take, t.role, t.text FROM taken c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
visits AS (
  SELECT conv_id, depth, string_agg(sha256(length(role) || ':' || role || text), ',') OVER (PARTITION BY conv_id ORDER BY depth) AS prefix,
    strlen(text) AS bytes, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM turns
  UNION ALL SELECT conv_id, 0, '', 0, conv_id NOT IN (SELECT conv_id FROM turns) FROM lengths),
nodes AS (SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes,
    coalesce(sha256(string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id)), sha256('')) AS ends_sha256,
    count_if(ends) = count(*) AS leaf FROM visits GROUP BY depth, prefix),
above AS (SELECT n.depth, n.prefix, v.prefix AS up, p.conv_id AS parent_conv_id FROM nodes n
  JOIN visits v ON v.conv_id = n.conv_id AND v.depth = n.depth - 1 JOIN nodes p ON p.depth = v.depth AND p.prefix = v.prefix),
children AS (SELECT depth - 1 AS depth, up AS prefix, count(*) AS n FROM above GROUP BY 1, 2),
totals AS (SELECT v.depth, v.prefix, count_if(n.leaf) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved FROM nodes n
  JOIN visits v ON v.conv_id = n.conv_id AND v.depth <= n.depth GROUP BY 1, 2)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, a.parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs,
  CAST(coalesce(c.n, 0) AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens,
  n.ends_sha256
FROM nodes n JOIN totals s ON s.depth = n.depth AND s.prefix = n.prefix
LEFT JOIN above a ON a.depth = n.depth AND a.prefix = n.prefix LEFT JOIN children c ON c.depth = n.depth AND c.prefix = n.prefix
"""
