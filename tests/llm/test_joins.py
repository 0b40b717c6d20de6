import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loglens.llm import cap_join, common, dart_minhash, registry
from loglens.llm.components import components

from .util import awkward, empty, prose


def closure(nodes, links):
    head = {n: n for n in nodes}

    def find(x):
        while head[x] != x:
            head[x] = head[head[x]]
            x = head[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            head[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7)]
    want = closure({x for ab in links for x in ab}, links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {n: c for n, c in want.items() if n in got}
    assert set(want) - set(got) <= {n for n in want if want[n] == n}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("weighted", [False, True])
def test_signature_estimates_similarity(weighted):
    rng = np.random.default_rng(3)
    elements = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    a = rng.random(400) * 4 + 0.1 if weighted else np.ones(400)
    b = a.copy()
    b[:100] = rng.random(100) * 4 if weighted else 0
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    x = dart_minhash.signature(elements[a > 0], a[a > 0], 4000)
    y = dart_minhash.signature(elements[b > 0], b[b > 0], 4000)
    assert abs((x == y).mean() - true) < 0.03


def test_unweighted_is_weight_one():
    elements = np.arange(50, dtype=np.uint64)
    assert (dart_minhash.signature(elements, None, 100) == dart_minhash.signature(elements, np.ones(50), 100)).all()


def near_copies(base, n, edits, seed):
    r = np.random.default_rng(seed)
    words = base.split()
    out = []
    for i in range(n):
        w = list(words)
        for at in r.integers(0, len(w), edits):
            w[at] = f"new{i}w{at}"
        out.append(" ".join(w))
    return out


def brute_groups(rows):
    words = {i: (t or "").encode().split() for i, t in rows}
    ids = [i for i in words if words[i]]
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if dart_minhash.similarity(words[a], words[b]) >= 0.8]
    return closure(list(words), links)


def test_near_groups_equal_brute_force(spark):
    rows, n = [], 0
    for s in range(6):
        base = prose(s, 150 + 40 * s)
        for t in [base, *near_copies(base, 8, 2 + s, s), base, base + " "]:
            rows.append((n, t))
            n += 1
    rows += [(n + i, prose(100 + i, 90)) for i in range(40)] + [(n + 40, "a b"), (n + 41, "a  b"), (n + 42, "a b c"), (n + 43, None)]
    want = brute_groups(rows)
    got = dart_minhash.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), ["doc_id"]).collect()
    assert {r.row.doc_id: r.component for r in got} == want
    assert {r.row.doc_id for r in got if r.kept} == set(want.values())


def test_near_groups_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute_groups([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.group_id, r.kept) for r in registry.op7_dart_minhash(spark, "/root/testdata/sf0.001").collect()}
    assert got == {i: (c, i == c) for i, c in want.items()}
    assert len(set(want.values())) < len(want)


def test_near_groups_awkward_rows(spark):
    docs = awkward(spark)
    rows = dart_minhash.near_groups(docs, docs.columns).collect()
    assert len(rows) == docs.count()
    kept = [r for r in rows if r.kept]
    same = [r for r in rows if r.row.doc_id in (3, 4) or (r.row.doc_id is None and r.row.text)]
    assert len(same) == 4 and {r.component for r in same} == {3} and sum(r.kept for r in same) == 1 and all(r.n_copies == 4 for r in same)
    assert len(kept) == len(rows) - 3
    assert dart_minhash.representatives(docs).columns == docs.columns
    assert dart_minhash.near_groups(empty(spark), ["doc_id"]).count() == 0


VECTORS = "vec_id bigint, embedding array<float>, label int, n_links string"


def brute_vectors(rows):
    good = [(i, np.array(e, np.float64), l) for i, e, l, _ in rows
            if l is not None and e and None not in e and np.isfinite(e).all() and np.any(e)]
    links = [(k, j) for k in range(len(good)) for j in range(k + 1, len(good))
             if good[k][2] == good[j][2] and len(good[k][1]) == len(good[j][1])
             and good[k][1] @ good[j][1] / np.linalg.norm(good[k][1]) / np.linalg.norm(good[j][1]) >= 0.93]
    head = closure(range(len(good)), links)
    n = {k: 0 for k in head}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    least = {}
    for k, h in head.items():
        least[h] = min(least.get(h, good[k][0]), good[k][0])
    out = {i: (0, i, True) for i, *_ in rows}
    for k, h in head.items():
        out[good[k][0]] = (n[k], least[h], good[k][0] == least[h])
    return out


@pytest.mark.parametrize("dimensions", [2, 5, 64])
def test_cap_join_equals_brute_force(spark, dimensions):
    rng = np.random.default_rng(dimensions)
    rows = []
    for c in range(12):
        centre = rng.standard_normal(dimensions)
        for _ in range(25):
            noise = rng.standard_normal(dimensions) * 0.28 * np.linalg.norm(centre) / np.sqrt(dimensions) * rng.random()
            v = (centre + noise).astype(np.float32)
            rows.append((len(rows), v.tolist(), c % 3, None))
    rows += [(len(rows) + k, rows[5 * k][1], rows[5 * k][2], None) for k in range(20)]
    want = brute_vectors(rows)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in cap_join.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()}
    assert sum(x[0] for x in got.values()) >= 0.99 * sum(x[0] for x in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)
    assert np.mean([got[i] == want[i] for i in want]) > 0.95


def test_cap_join_splits_large_caps(spark, monkeypatch):
    rng = np.random.default_rng(9)
    centre = rng.standard_normal(16)
    rows = [(i, (centre + rng.standard_normal(16) * 0.05).astype(np.float32).tolist(), 1, None) for i in range(300)]
    frame = spark.createDataFrame(rows, VECTORS)
    a = cap_join.link_groups(frame, block=512)[2]
    b = cap_join.link_groups(frame, block=32)[2]
    assert a.count() == a.distinct().count() == b.count() == b.distinct().count() == 300 * 299 // 2


def test_cap_join_awkward_rows(spark):
    rows = [(None, None, None, None), (1, None, 1, None), (2, [], 1, None), (3, [0.0, 0.0], 1, None), (4, [1.0, None], 1, None),
            (5, [float("nan"), 1.0], 1, None), (6, [1.0, 2.0], None, None), (7, [1.0, 2.0], 1, None), (8, [2.0, 4.0], 1, "x"),
            (8, [2.0, 4.0], 1, "x"), (None, [1.0, 2.0], 1, None), (9, [1.0, 2.0, 3.0], 1, None), (10, [-0.0, 1.0], 2, None), (11, [0.0, 1.0], 2, None)]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in cap_join.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()), key=str)
    want = [(None, 0, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True),
            (7, 3, 7, True), (8, 3, 7, False), (8, 3, 7, False), (None, 3, 7, False), (9, 0, 9, True), (10, 1, 10, True), (11, 1, 10, False)]
    assert got == sorted(want, key=str)
    assert cap_join.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_cap_join_recall_on_a_hot_table(spark):
    """At least 0.9 of the links of a table with a large group; here nearly all."""
    r = np.random.default_rng(9)
    centres = r.standard_normal((40, 64))
    rows = centres[r.integers(0, 40, 1500)] + 0.28 * r.standard_normal((1500, 64))  # near the limit of 0.93
    rows[:300] = centres[0] + 0.05 * r.standard_normal((300, 64))
    table = spark.createDataFrame([(i, x.tolist(), 1, None) for i, x in enumerate(rows)], VECTORS)
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    want = int(np.triu(unit @ unit.T >= 0.93, 1).sum())
    assert want > 30_000
    assert cap_join.link_groups(table)[2].count() >= 0.999 * want


def shared(x, y, largest):
    a, b = cap_join.list_decode(x, largest), cap_join.list_decode(y, largest)
    return (a[:, :, None] == b[:, None, :]).any(axis=(1, 2)).mean()


@pytest.mark.parametrize("cosine", [0.93, 0.94, 0.95])
def test_cap_join_recall_of_pairs_planted_at_the_limit(cosine):
    """Even vectors, and vectors with 95% of their norm in one half of the coordinates."""
    rng = np.random.default_rng([4, int(cosine * 100)])
    assert shared(*cap_join.pairs_at(cosine, 64, 5000, rng), 13_000) >= 0.998
    halves = [cap_join.pairs_at(cosine, 32, 5000, rng) for _ in range(2)]
    heavy, light = 0.95, np.sqrt(1 - 0.95 ** 2)
    x, y = (np.concatenate([heavy * halves[0][k], light * halves[1][k]], axis=1) for k in (0, 1))
    assert np.allclose((x * y).sum(axis=1), cosine) and shared(x, y, 13_000) >= 0.998


def test_cap_join_links_planted_pairs(spark):
    """One pair at 0.935 for each of 1,500 random vectors of one label, far more than are compared whole."""
    x, y = cap_join.pairs_at(0.935, 64, 1500, np.random.default_rng(5))
    rows = [(i, v.astype(np.float32).tolist(), 1, None) for i, v in enumerate(np.concatenate([x, y]))]
    got = cap_join.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()
    assert sum(r.component_id == r.vec_id % 1500 for r in got) >= 2997


@pytest.mark.parametrize("largest", [1_000, 100_000, 1_000_000, 10_000_000])
def test_cap_join_recall_does_not_depend_on_the_largest_group(largest):
    for dimensions in (32, 64):
        assert shared(*cap_join.pairs_at(0.93, dimensions, 3000, np.random.default_rng(6)), largest) >= 0.997


def test_near_copies_that_are_not_linked_make_few_pairs(spark, monkeypatch):
    """A family around one text, most of whose members are too far from each other: pairs don't grow with its square."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(160):
        words = list(base)
        for at in rng.sample(range(120), rng.choice([0, 1, 2, 6, 7, 8])):
            words[at] = f"e{i}x{at}"
        rows.append((i, " ".join(words)))
    words = {i: t.split() for i, t in rows}
    links = [(a, b) for a in words for b in words if a < b and dart_minhash.similarity(words[a], words[b]) >= 0.8]
    made = {}

    def counted(df, name):
        out = common.cut(df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(dart_minhash, "cut", counted)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    table = dart_minhash.signed(docs, ["doc_id"])
    node = {r.id: r.uid for r in table.collect()}
    alone = spark.createDataFrame([(1, n, n, -1) for n in node.values()], "bucket bigint, node bigint, component bigint, main bigint")
    for weighted in (False, True):
        pairs = {(r.low, r.high) for r in dart_minhash._prefix_pairs(alone, table, 0.8, 5, weighted).collect()}
        assert {tuple(sorted((node[a], node[b]))) for a, b in links} <= pairs
        assert len(pairs) < 2 * len(links)
    monkeypatch.setattr(dart_minhash, "CROWDED", 0)
    got = dart_minhash.near_groups(docs, ["doc_id"]).collect()
    assert {r.row.doc_id: r.component for r in got} == brute_groups(rows)
    assert made["offered-again"] < 500  # 1,985 without the prefix filter
