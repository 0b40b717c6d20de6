"""Isolation forest (Liu, Ting & Zhou, 2008) grown and applied as Spark jobs.

* sampling - every tree takes the psi = min(max_samples, n) training rows of smallest keyed hash, found in
  one pass without global row numbers (``draw_samples``);
* growing - all trees together, level by level, as windows over (tree, node) in one stage; feature and cut
  come from a hash of (seed, tree, node), so no Python runs and trees don't depend on partitions (``grow_forest``);
* scoring - an Arrow-batched ``pandas_udf``; the packed node arrays (at most
  ``n_trees x (2 psi - 1)`` nodes, fixed by the parameters) are broadcast and
  every tree is walked for a whole batch at once with numpy indexing.

Path length of a row in a tree = edges to its leaf + c(leaf size);
score s = 2 ** (-mean path / c(psi)); the pipeline reports
``anomaly_score = s - quantile(s_train, 1 - contamination)`` (higher = more
anomalous; 0 is the contamination cut).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglens.schema import MAX_SAMPLES, N_ESTIMATORS, RANDOM_STATE
from loglens.session import ship_package

EULER_GAMMA = 0.5772156649015329

NODE_SCHEMA = T.StructType([
    T.StructField("tree_id", T.IntegerType(), False),
    T.StructField("node_id", T.IntegerType(), False),
    T.StructField("depth", T.IntegerType(), False),
    T.StructField("feature", T.IntegerType(), False),   # -1 for a leaf
    T.StructField("threshold", T.DoubleType(), True),  # x <= threshold goes left
    T.StructField("left", T.IntegerType(), False),
    T.StructField("right", T.IntegerType(), False),
    T.StructField("size", T.LongType(), False),
])


def average_path_length(n) -> np.ndarray:
    """c(n) = 2 H(n-1) - 2 (n-1)/n, H(i) ~ ln(i) + Euler's constant; c(1)=0, c(2)=1."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    two = n == 2
    big = n > 2
    out[two] = 1.0
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER_GAMMA) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def max_depth_for(psi: int) -> int:
    return int(math.ceil(math.log2(max(psi, 2))))


# ---- sampling: per-tree bottom-k by a keyed hash ---------------------------------
# A row's key is hashed once; tree t ranks rows by (a_t x + b_t) mod HASH_PRIME.  Both engines of
# the oracle check compute the same numbers, so the drawn rows themselves can be compared.

HASH_PRIME = 2_147_483_647
#: Trees draw from a pool of this many times the rows that all trees need; smaller tables are their own pool.
POOL_FACTOR = 8


def hash_text(seed: int, *parts) -> str:
    return ":".join(str(p) for p in (seed, *parts))


def _hash32(text: Column, first: int = 1) -> Column:
    """A 32-bit number from an MD5 digest's hex digits ``first`` to ``first + 7``."""
    return F.conv(F.substring(F.md5(text.cast("binary")), first, 8), 16, 10).cast("bigint")


def tree_coefficients(n_trees: int, seed: int) -> tuple[list[int], list[int]]:
    """Multiplier and offset of every tree's hash."""
    import hashlib

    def number(*parts) -> int:
        return int(hashlib.md5(hash_text(seed, *parts).encode()).hexdigest()[:8], 16)

    return ([1 + number("a", t) % (HASH_PRIME - 1) for t in range(n_trees)], [number("b", t) % HASH_PRIME for t in range(n_trees)])


def pool_bound(n_rows: int, n_trees: int, psi: int) -> int:
    """Rows whose 32-bit hash lies below this are the pool (all of them for tables up to the pool's size)."""
    pool = POOL_FACTOR * n_trees * psi
    return 1 << 32 if n_rows <= pool else max(1, (1 << 32) * pool // n_rows)


def rank_bound(n_rows: int, n_trees: int, psi: int) -> int:
    """Only hashes below this can be among a tree's psi smallest (to eight standard deviations and more)."""
    pool = min(n_rows, POOL_FACTOR * n_trees * psi)
    wanted = psi + 8 * math.isqrt(psi) + 32
    return HASH_PRIME if 2 * wanted >= pool else HASH_PRIME * wanted // pool


def draw_samples(rows: DataFrame, key_cols: Sequence[str], n_rows: int, n_trees: int = N_ESTIMATORS,
                 max_samples: int = MAX_SAMPLES, seed: int = RANDOM_STATE) -> DataFrame:
    """``rows`` with a ``tree_id``: for every tree its psi = min(max_samples, n_rows) rows of smallest hash.

    ``key_cols`` must tell all rows apart.  One narrow pass: a row outside the pool costs one hash, rows of the
    pool are ranked per tree, and only hashes that can be among the smallest leave the task, about
    ``1.6 psi`` rows a tree.  No global row numbers and no join.
    """
    psi = min(max_samples, n_rows)
    if not psi:
        return rows.withColumn("tree_id", F.lit(0)).limit(0)
    a, b = tree_coefficients(n_trees, seed)
    text = F.concat_ws(":", F.lit(str(seed)), F.lit("row"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key_cols])
    gate, limit = pool_bound(n_rows, n_trees, psi), rank_bound(n_rows, n_trees, psi)
    pool = rows.where(_hash32(text, 9) < gate) if gate < 1 << 32 else rows
    pool = pool.withColumn("_x", _hash32(text) % HASH_PRIME)

    def coefficient(values):
        return F.element_at(F.lit(values).cast("array<bigint>"), F.col("tree_id") + 1)

    dealt = (pool.withColumn("tree_id", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))))
             .withColumn("_h", (coefficient(a) * F.col("_x") + coefficient(b)) % HASH_PRIME).where(F.col("_h") < limit))
    rank = F.row_number().over(Window.partitionBy("tree_id").orderBy("_h", *key_cols))
    return dealt.withColumn("_rank", rank).where(F.col("_rank") <= psi).drop("_x", "_h", "_rank")


# ---- growing: all trees level by level -----------------------------------------------

def _uniform(seed: int, salt: str) -> Column:
    """A number in [0, 1) that belongs to a node of a tree."""
    return _hash32(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), F.col("tree_id").cast("string"), F.col("node_id").cast("string"))) / F.lit(float(1 << 32))


def grow_forest(samples: DataFrame, feature_cols: Sequence[str], psi: int, seed: int = RANDOM_STATE) -> DataFrame:
    """``samples`` (tree_id, features...) -> node table (NODE_SCHEMA).

    Level-synchronous: at every level each (tree, node) group finds its size and the range of every feature by a window,
    picks one of the features that vary and a cut between its least and greatest value, and sends its rows to nodes
    ``2 i + 1`` and ``2 i + 2``.  Rows are dealt by tree once, and every level's window keeps that
    partitioning, so all levels run in one stage of JVM expressions.  Feature and cut come from a hash of (seed, tree,
    node): trees don't depend on the order or the partitions of the rows.
    """
    cols = list(feature_cols)
    depth_limit = max_depth_for(psi)
    node = Window.partitionBy("tree_id", "node_id")
    index = F.array(*[F.lit(i) for i in range(len(cols))])
    # trees are few rows but much work: adaptive execution would put them into a few tasks, a given count spreads them
    tasks = max(1, 2 * samples.sparkSession.sparkContext.defaultParallelism)
    rows = samples.select("tree_id", F.array(*[F.col(c).cast("double") for c in cols]).alias("_x")).repartition(tasks, "tree_id")
    rows = rows.select(F.col("tree_id").cast("int").alias("tree_id"), *[F.col("_x")[i].alias(f"_f{i}") for i in range(len(cols))],
                       F.lit(0).alias("node_id"), F.lit(False).alias("_done"),
                       F.array().cast("array<struct<node_id:int,depth:int,feature:int,threshold:double,size:bigint>>").alias("_path"))
    features = [f"_f{i}" for i in range(len(cols))]
    # every level has the same columns; only its depth differs
    ranges = [F.count(F.lit(1)).over(node).alias("_size"), F.array(*[F.min(f).over(node) for f in features]).alias("_low"),
              F.array(*[F.max(f).over(node) for f in features]).alias("_high")]
    varying = F.filter(index, lambda i: F.get("_high", i) > F.get("_low", i)).alias("_varying")
    pick = F.floor(_uniform(seed, "feature") * F.size("_varying")).cast("int")
    chosen = F.when(F.col("_size") > 1, F.get("_varying", pick)).alias("_feature")
    low, high = F.get("_low", F.col("_feature")), F.get("_high", F.col("_feature"))
    cut = low + _uniform(seed, "cut") * (high - low)
    cut = F.when(cut >= high, low).otherwise(cut).alias("_cut")
    value = F.get(F.array(*features), F.col("_feature")).alias("_value")
    leaf = F.col("_done") | F.col("_feature").isNull()
    child = 2 * F.col("node_id") + F.when(F.col("_value") <= F.col("_cut"), 1).otherwise(2)
    moved = F.when(leaf, F.col("node_id")).otherwise(child).cast("int").alias("node_id")
    for level in range(depth_limit + 1):
        rows = rows.select("*", *ranges).select("*", varying if level < depth_limit else F.array().cast("array<int>").alias("_varying"))
        rows = rows.select("*", chosen).select("*", cut, value)
        here = F.struct("node_id", F.lit(level).alias("depth"), F.coalesce("_feature", F.lit(-1)).alias("feature"),
                        F.col("_cut").alias("threshold"), F.col("_size").alias("size"))
        path = F.when(F.col("_done"), F.col("_path")).otherwise(F.array_append("_path", here)).alias("_path")
        rows = rows.select("tree_id", *features, moved, leaf.alias("_done"), path)
    seen = rows.select("tree_id", F.explode("_path").alias("n")).select("tree_id", "n.*")
    nodes = seen.groupBy("tree_id", "node_id").agg(*[F.first(c).alias(c) for c in ("depth", "feature", "threshold", "size")])
    inner = F.col("feature") >= 0
    return nodes.select(
        "tree_id", "node_id", "depth", "feature", "threshold",
        F.when(inner, 2 * F.col("node_id") + 1).otherwise(-1).cast("int").alias("left"),
        F.when(inner, 2 * F.col("node_id") + 2).otherwise(-1).cast("int").alias("right"), "size")


#: Rows walked at a time: the walk's arrays (rows x trees) stay in a core's cache.
WALK_ROWS = 64


@dataclass
class PackedForest:
    """Flat node arrays of all trees (global node indices, int32)."""
    feature: np.ndarray      # split feature (0 at leaves)
    threshold: np.ndarray    # +inf at leaves, so a leaf "goes left" ...
    children: np.ndarray     # (nodes, 2): left, right; a leaf points to itself
    leaf_value: np.ndarray   # depth + c(size) at leaves
    roots: np.ndarray
    max_depth: int
    psi: int

    @classmethod
    def from_nodes(cls, nodes: pd.DataFrame, psi: int) -> PackedForest:
        nodes = nodes.sort_values(["tree_id", "node_id"], kind="mergesort").reset_index(drop=True)
        tree, node = nodes["tree_id"].to_numpy(np.int64), nodes["node_id"].to_numpy(np.int64)
        key = tree * (1 << 32) + node  # sorted: a child's place is found by its key
        offsets = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]]) if len(tree) else np.zeros(0, np.int64)
        is_leaf = nodes["feature"].to_numpy() < 0
        own = np.arange(len(nodes))
        left, right = (np.where(is_leaf, own, np.searchsorted(key, tree * (1 << 32) + nodes[side].to_numpy(np.int64)))
                       for side in ("left", "right"))
        leaf_value = np.where(is_leaf, nodes["depth"].to_numpy() + average_path_length(nodes["size"].to_numpy()), 0.0)
        return cls(
            feature=np.where(is_leaf, 0, nodes["feature"].to_numpy()).astype(np.int32),
            threshold=np.nan_to_num(nodes["threshold"].to_numpy(dtype=np.float64), nan=np.inf),
            children=np.stack([left, right], axis=1).astype(np.int32),
            leaf_value=leaf_value.astype(np.float64), roots=offsets.astype(np.int32),
            max_depth=int(nodes["depth"].max()) if len(nodes) else 0, psi=psi)

    def path_lengths(self, X: np.ndarray) -> np.ndarray:
        """Mean path length of each row of X over all trees (all trees walked together, ``WALK_ROWS`` rows at a time)."""
        X = np.ascontiguousarray(X, dtype=np.float64)
        feature, children, roots = (a.astype(np.intp) for a in (self.feature, self.children.ravel(), self.roots))
        out = np.empty(X.shape[0])
        for start in range(0, X.shape[0], WALK_ROWS):
            block = X[start:start + WALK_ROWS]
            values, first = block.ravel(), (np.arange(len(block), dtype=np.intp) * X.shape[1])[:, None]
            node = np.repeat(roots[None, :], len(block), axis=0)
            place, x, cut, right = np.empty_like(node), np.empty(node.shape), np.empty(node.shape), np.empty(node.shape, bool)
            for _ in range(self.max_depth):  # every index is in range; "clip" lets numpy write to ``out`` directly
                np.take(feature, node, out=place, mode="clip")
                place += first
                np.take(values, place, out=x, mode="clip")
                np.take(self.threshold, node, out=cut, mode="clip")
                np.greater(x, cut, out=right)
                node *= 2
                node += right
                np.take(children, node, out=place, mode="clip")
                node, place = place, node
            out[start:start + WALK_ROWS] = self.leaf_value[node].mean(axis=1)
        return out

    def scores(self, X: np.ndarray) -> np.ndarray:
        """s = 2 ** (-E[h] / c(psi)), in (0, 1]."""
        return np.power(2.0, -self.path_lengths(X) / average_path_length([self.psi])[0])


def score_column(spark: SparkSession, packed: PackedForest, feature_cols: Sequence[str], bc=None) -> Column:
    """Column with the raw isolation score s of each row.

    ``bc`` reuses an existing broadcast of ``packed`` (one per model and
    application instead of one per call).
    """
    ship_package(spark)
    bc = bc if bc is not None else spark.sparkContext.broadcast(packed)

    @F.pandas_udf(T.DoubleType())
    def iforest_score(x: pd.DataFrame) -> pd.Series:
        X = x.to_numpy(dtype=np.float64)
        return pd.Series(bc.value.scores(X))

    return iforest_score(F.struct(*[F.col(c) for c in feature_cols]))
