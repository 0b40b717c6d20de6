import hashlib

import numpy as np
import pandas as pd
import pytest
from loglens.operators import forest as iforest


def test_average_path_length():
    c = iforest.average_path_length([0, 1, 2, 3, 256])
    assert c[0] == 0 and c[1] == 0 and c[2] == 1
    assert c[3] == pytest.approx(2 * (np.log(2) + 0.5772156649015329) - 4 / 3)
    assert c[4] == pytest.approx(10.244770920116851, rel=1e-9)


def _keys(spark, n):
    return spark.range(n).withColumnRenamed("id", "row_idx")


def _hash32(text, first=0):
    return int(hashlib.md5(text.encode()).hexdigest()[first:first + 8], 16)


def _brute_samples(keys, n_trees, psi, gate=1 << 32, seed=42):
    """The psi rows of smallest hash of every tree, in plain Python."""
    p = iforest.HASH_PRIME
    pool = [(k, _hash32(f"{seed}:row:{k}") % p) for k in keys if _hash32(f"{seed}:row:{k}", 8) < gate]
    out = set()
    for t in range(n_trees):
        a, b = 1 + _hash32(f"{seed}:a:{t}") % (p - 1), _hash32(f"{seed}:b:{t}") % p
        out |= {(t, k) for _, k in sorted(((a * x + b) % p, k) for k, x in pool)[:psi]}
    return out


@pytest.mark.parametrize("n,psi", [(700, 256), (40, 256), (5000, 16), (3000, 1)])
def test_samples_are_the_smallest_hashes_of_every_tree(spark, n, psi):
    got = iforest.draw_samples(_keys(spark, n), ["row_idx"], n, n_trees=20, max_samples=psi).collect()
    assert len(got) == 20 * min(n, psi)
    assert {(r.tree_id, r.row_idx) for r in got} == _brute_samples(range(n), 20, min(n, psi), iforest.pool_bound(n, 20, min(n, psi)))


def test_a_large_table_draws_from_a_pool(spark, monkeypatch):
    """Beyond the pool's size rows pass a gate first; every tree still gets its psi rows."""
    monkeypatch.setattr(iforest, "POOL_FACTOR", 2)
    n, trees, psi = 20_000, 10, 64
    gate = iforest.pool_bound(n, trees, psi)
    assert gate < 1 << 32 and iforest.rank_bound(n, trees, psi) < iforest.HASH_PRIME
    got = iforest.draw_samples(_keys(spark, n).repartition(5), ["row_idx"], n, trees, psi).collect()
    assert {(r.tree_id, r.row_idx) for r in got} == _brute_samples(range(n), trees, psi, gate)
    assert len(got) == trees * psi


def test_every_row_is_drawn_equally_often(spark):
    n, trees = 500, 300
    got = iforest.draw_samples(_keys(spark, n), ["row_idx"], n, trees, 100).groupBy("row_idx").count().toPandas()
    assert len(got) == n
    # 300 draws of one in five: mean 60, standard deviation 6.9
    assert got["count"].mean() == pytest.approx(60) and got["count"].std() == pytest.approx(6.9, abs=1.2)
    assert got["count"].min() > 25 and got["count"].max() < 95


def test_no_rows_no_samples(spark):
    assert iforest.draw_samples(_keys(spark, 0), ["row_idx"], 0).count() == 0


def _data(spark, n=600, seed=0):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, 3))
    X[:5] += 8.0  # planted outliers
    pdf = pd.DataFrame(X, columns=["a", "b", "c"])
    pdf["row_idx"] = np.arange(n)
    return spark.createDataFrame(pdf), X


def _grow(spark, df, n, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        picked = iforest.draw_samples(df.repartition(partitions), ["row_idx"], n, n_trees=50, max_samples=256)
        return iforest.grow_forest(picked, ["a", "b", "c"], psi=256).toPandas() \
            .sort_values(["tree_id", "node_id"]).reset_index(drop=True)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_forest_invariants_and_determinism(spark):
    df, X = _data(spark)
    n1 = _grow(spark, df, 600, 1)
    for p in (4, 32):
        pd.testing.assert_frame_equal(n1, _grow(spark, df, 600, p))
    roots = n1[n1.node_id == 0]
    assert (roots["size"] == 256).all() and len(roots) == 50
    assert n1["depth"].max() <= 8
    leaves = n1[n1.feature < 0]
    assert (leaves.groupby("tree_id")["size"].sum() == 256).all()
    packed = iforest.PackedForest.from_nodes(n1, 256)
    s = packed.scores(X)
    assert ((s > 0) & (s <= 1)).all()
    assert set(np.argsort(-s)[:5]) == {0, 1, 2, 3, 4}


def test_udf_scores_equal_numpy(spark):
    df, X = _data(spark, 300, seed=1)
    nodes = _grow(spark, df, 300, 4)
    packed = iforest.PackedForest.from_nodes(nodes, 256)
    got = df.select("row_idx", iforest.score_column(spark, packed, ["a", "b", "c"]).alias("s")).toPandas()
    got = got.sort_values("row_idx")["s"].to_numpy()
    assert np.allclose(got, packed.scores(X), rtol=0, atol=1e-15)


def test_hand_made_tree_path_length():
    nodes = pd.DataFrame([
        (0, 0, 0, 0, 0.5, 1, 2, 10), (0, 1, 1, -1, None, -1, -1, 1), (0, 2, 1, -1, None, -1, -1, 9),
    ], columns=["tree_id", "node_id", "depth", "feature", "threshold", "left", "right", "size"])
    packed = iforest.PackedForest.from_nodes(nodes, 10)
    h = packed.path_lengths(np.array([[0.0], [1.0]]))
    assert h[0] == pytest.approx(1.0)
    assert h[1] == pytest.approx(1.0 + iforest.average_path_length([9])[0])


def test_trees_equal_a_plain_recursion(spark):
    """Every node of a few trees, grown again row by row in Python."""
    df, X = _data(spark, 300, seed=2)
    samples = iforest.draw_samples(df, ["row_idx"], 300, n_trees=6, max_samples=64)
    got = {(r.tree_id, r.node_id): r for r in iforest.grow_forest(samples, ["a", "b", "c"], psi=64, seed=42).collect()}
    drawn = {}
    for r in samples.select("tree_id", "row_idx").collect():
        drawn.setdefault(r.tree_id, []).append(r.row_idx)
    want = {}

    def grow(tree, node, rows, depth):
        low, high = X[rows].min(axis=0), X[rows].max(axis=0)
        varying = [i for i in range(3) if high[i] > low[i]]
        if len(rows) <= 1 or depth == iforest.max_depth_for(64) or not varying:
            want[tree, node] = (depth, -1, None, len(rows))
            return
        f = varying[int(_hash32(f"42:feature:{tree}:{node}") / 2**32 * len(varying))]
        cut = low[f] + _hash32(f"42:cut:{tree}:{node}") / 2**32 * (high[f] - low[f])
        want[tree, node] = (depth, f, cut, len(rows))
        for child, part in ((1, [r for r in rows if X[r, f] <= cut]), (2, [r for r in rows if X[r, f] > cut])):
            grow(tree, 2 * node + child, part, depth + 1)

    for tree, rows in drawn.items():
        grow(tree, 0, sorted(rows), 0)
    assert {k: (r.depth, r.feature, r.threshold, r["size"]) for k, r in got.items()} == want
    for r in got.values():
        assert (r.left, r.right) == ((2 * r.node_id + 1, 2 * r.node_id + 2) if r.feature >= 0 else (-1, -1))


def test_equal_rows_make_a_leaf(spark):
    df = spark.createDataFrame([(i, 1.0, 2.0) for i in range(50)], "row_idx bigint, a double, b double")
    nodes = iforest.grow_forest(iforest.draw_samples(df, ["row_idx"], 50, n_trees=3), ["a", "b"], psi=50).collect()
    assert sorted((r.tree_id, r.node_id, r.feature, r["size"]) for r in nodes) == [(t, 0, -1, 50) for t in range(3)]


def test_growing_is_one_stage_without_python(spark):
    df, _ = _data(spark, 100)
    grown = iforest.grow_forest(iforest.draw_samples(df, ["row_idx"], 100, n_trees=3), ["a", "b", "c"], psi=100)
    plan = grown._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2  # the samples' ranks and the trees
    assert "Python" not in plan and "Arrow" not in plan


def test_the_walk_holds_few_rows_at_a_time():
    """Rows are walked in small blocks: the same path lengths as tree by tree, without arrays of rows x trees for the batch."""
    import tracemalloc

    rng = np.random.default_rng(3)
    trees, inner, n = 100, 127, 6000
    node = np.arange(2 * inner + 1)
    pdf = pd.concat([pd.DataFrame({
        "tree_id": t, "node_id": node, "depth": np.log2(node + 1).astype(int), "feature": np.where(node < inner, rng.integers(3, size=len(node)), -1),
        "threshold": np.where(node < inner, rng.normal(size=len(node)), np.nan), "left": np.where(node < inner, 2 * node + 1, -1),
        "right": np.where(node < inner, 2 * node + 2, -1), "size": 2}) for t in range(trees)])
    packed = iforest.PackedForest.from_nodes(pdf, 256)
    X = rng.normal(size=(n, 3))
    X[:3] = np.inf, -np.inf, np.nan
    tracemalloc.start()
    got = packed.path_lengths(X)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < n * trees * 2  # not one small number for each row and tree
    assert packed.path_lengths(X[:0]).shape == (0,)
    for i in [0, 1, 2, 63, 64, n - 1]:
        ends = []
        for at in packed.roots:
            for _ in range(packed.max_depth):
                at = packed.children[at, int(X[i, packed.feature[at]] > packed.threshold[at])]
            ends.append(packed.leaf_value[at])
        assert got[i] == np.mean(ends)
