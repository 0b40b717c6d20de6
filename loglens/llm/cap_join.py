"""Similarity join of vectors by spherical-cap filters.

Filters are random directions of the whole space; a vector falls into the caps of the directions nearest
to it.  The directions form structured product codes: the vector is rotated at random, each half of
its coordinates has its own code vectors, and every pair of them is a direction, so that a vector's nearest
directions are list-decoded from two short sorted lists instead of being compared with every
direction (published by Becker, Ducas, Gama and Laarhoven, 2016).  Several codes with rotations of their
own are used: whether a code brings two vectors together depends on their cosine alone, and the codes miss
independently, so as many are taken as a pair at exactly the wanted cosine needs to share some cap with a
chance of ``RECALL``.  Vectors that share a cap are verified by their cosine in double precision.

Spark collapses equal vectors to classes, joins classes on (label, cap), and splits large caps into
blocks whose pairs are separate tasks' work, so that no task holds a hot cap.  A pair of classes
that share several caps is reported by the least of them alone, so links need no distinct step.

Directions grow more numerous with the largest group, so a cap holds a bounded number of unrelated vectors,
and the number of codes is measured anew for each number of directions (``codes_for``), so recall is the same at
any size.  Groups of at most ``EXACT`` vectors form one cap and are compared whole.

Defined results: vectors that are null, empty or zero, or hold a null or non-finite component, and vectors without a label, have no
links; vectors of different lengths are not compared; equal vectors of a label are linked; a null
id never names a component unless all its ids are null; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import cut, map_arrow
from loglens.llm.components import components

LEAST_COSINE = 0.93
#: Chance that two vectors at exactly the least cosine share a cap; pairs that are nearer have a higher one.
RECALL = 0.999
#: Caps of a code that a vector falls into.
CAPS_PER_CODE = 4
#: Unrelated vectors of the largest group in a cap.
STRANGERS_PER_CAP = 32
#: A group of at most so many vectors is one cap.
EXACT = 512
#: A code that brings together fewer pairs at the least cosine gets fewer directions: in few dimensions a cap
#: that is narrow against the wanted angle holds back more links than strangers.
LEAST_CODE_RECALL = 0.25
#: Pairs on which the recall of a code is measured.
TRIALS = 2000
#: Members of a cap compared by one unit of work.
BLOCK = 512
SEED = 20160106


@lru_cache(maxsize=256)
def code(dimensions: int, size: int, number: int):
    """(rotation, code vectors of the first half, of the second half); too few coordinates to halve have one code."""
    random = np.random.default_rng([SEED, dimensions, size, number])
    q, r = np.linalg.qr(random.standard_normal((dimensions, dimensions)))
    half = dimensions // 2 if dimensions >= 8 else dimensions
    codes = []
    for n, d in ((size, half), (size if half < dimensions else 1, dimensions - half)):
        vectors = random.standard_normal((n, d))
        codes.append(vectors / np.linalg.norm(vectors, axis=1, keepdims=True) if d else vectors)
    return q * np.sign(np.diag(r)), codes[0], codes[1]


def nearest_caps(unit: np.ndarray, size: int, number: int) -> np.ndarray:
    """For each unit vector, the numbers of its nearest directions of one code."""
    rotation, first, second = code(unit.shape[1], size, number)
    unit = unit @ rotation
    half = first.shape[1]
    order, falling = [], []
    for product in (unit[:, :half] @ first.T, unit[:, half:] @ second.T):
        best = np.argpartition(-product, CAPS_PER_CODE - 1, axis=1)[:, :CAPS_PER_CODE] if product.shape[1] > CAPS_PER_CODE else np.tile(
            np.arange(product.shape[1]), (len(product), 1))
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(product, best, axis=1), axis=1, kind="stable"), axis=1)
        order.append(best)
        falling.append(np.take_along_axis(product, best, axis=1))
    # a pair of ranks has (i + 1) * (j + 1) - 1 pairs before it, so those beyond the number of caps cannot be among the nearest
    i, j = np.array([(i, j) for i in range(order[0].shape[1]) for j in range(order[1].shape[1]) if (i + 1) * (j + 1) <= CAPS_PER_CODE]).T
    best = np.argsort(-(falling[0][:, i] + falling[1][:, j]), axis=1, kind="stable")[:, :CAPS_PER_CODE]
    return np.take_along_axis(order[0][:, i].astype(np.int64) * len(second) + order[1][:, j], best, axis=1)


def pairs_at(cosine: float, dimensions: int, n: int, random) -> tuple[np.ndarray, np.ndarray]:
    """Random pairs of unit vectors at a cosine."""
    x, u = random.standard_normal((2, n, dimensions))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u -= (u * x).sum(axis=1, keepdims=True) * x
    return x, cosine * x + math.sqrt(1 - cosine * cosine) * u / np.linalg.norm(u, axis=1, keepdims=True)


@lru_cache(maxsize=256)
def codes_for(dimensions: int, largest: int, least: float = LEAST_COSINE) -> tuple[int, int]:
    """(code vectors of a half, number of codes) for a largest group of so many vectors; (1, 1) is one cap."""
    if dimensions < 2 or largest <= EXACT:
        return 1, 1
    halved = dimensions >= 8
    directions = largest * CAPS_PER_CODE / STRANGERS_PER_CAP
    size = round(math.sqrt(directions)) if halved else min(round(directions), 4096)
    while size > 1:
        random = np.random.default_rng([SEED, dimensions, size])
        found = []
        for number in range(3):
            x, y = (nearest_caps(v, size, number) for v in pairs_at(least, dimensions, TRIALS // 2, random))
            found.append((x[:, :, None] == y[:, None, :]).any(axis=(1, 2)).mean())
        mean = float(np.mean(found))
        recall = mean - 2 * math.sqrt(mean * (1 - mean) / (3 * (TRIALS // 2)))  # at least this, beyond sampling noise
        if recall >= LEAST_CODE_RECALL:
            # two at least, as single misses of a nearly perfect code are too few to be measured
            return size, max(2, math.ceil(math.log(1 - RECALL) / math.log(1 - min(recall, 0.9999))))
        size = int(size / (1.5 if halved else 2))
    return 1, 1


def list_decode(unit: np.ndarray, largest: int, least: float = LEAST_COSINE) -> np.ndarray:
    """For each unit vector, the sorted numbers of its caps in all codes."""
    size, codes = codes_for(unit.shape[1], largest, least)
    caps = [nearest_caps(unit, size, number) + number * size * size for number in range(codes)] if size > 1 else [np.zeros((len(unit), 1), np.int64)]
    return np.sort(np.concatenate(caps, axis=1), axis=1)


def _read_batches(kind: str):
    """Bytes of usable vectors, and a hash of label and vector."""

    def run(batches):
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        for batch in batches:
            key, data = [], []
            for label, value in zip(batch.column("label").to_pylist(), batch.column("embedding")):
                vector = value.values
                ok = label is not None and vector is not None and len(vector) and not vector.null_count
                vector = vector.to_numpy(zero_copy_only=False).astype(kind) if ok else None
                if not ok or not np.isfinite(vector).all() or not vector.any():
                    key.append(None)
                    data.append(None)
                    continue
                data.append((vector + 0).tobytes())  # -0 and 0 are one
                key.append(xxh3_128_digest(label.encode() + b"\0" + data[-1]))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(key, pa.binary()), pa.array(data, pa.binary())],
                                             ["vec_id", "label", "key", "data"])

    return run


def _unit(data: list[bytes], kind: str) -> np.ndarray:
    x = np.stack([np.frombuffer(d, kind) for d in data]).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _decode_batches(kind: str, largest: int, least: float):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data = batch.column("data").to_pylist()
            caps: list = [None] * len(data)
            lengths = np.array([len(d) for d in data])
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                for i in range(0, len(at), 1024):
                    part = at[i:i + 1024]
                    for j, found in zip(part, list_decode(_unit([data[j] for j in part], kind), largest, least)):
                        caps[j] = found
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("label"), batch.column("data"),
                                              pa.array(caps, pa.list_(pa.int64()))], ["node", "label", "data", "caps"])

    return run


def _linked(nodes: list, blocks: list, unit: np.ndarray, caps: list, cap: int, low: int, high: int, least: float):
    """Links of one unit of work that no lesser shared cap reports."""
    cosine = unit @ unit.T
    i, j = np.nonzero(np.triu(cosine >= least, 1))
    if not len(i):
        return []
    if low != high:  # pairs within a block belong to the block's own unit
        side = np.array(blocks)
        across = side[i] != side[j]
        i, j = i[across], j[across]
    if len(i) > 100:
        smaller = [c[c < cap] for c in caps]
        names, at = np.unique(np.concatenate(smaller), return_inverse=True)
        if len(names):
            has = np.zeros((len(nodes), len(names)), np.float32)
            has[np.repeat(np.arange(len(nodes)), [len(c) for c in smaller]), at] = 1
            first = (has @ has.T)[i, j] == 0
            i, j = i[first], j[first]
        return [(nodes[x], nodes[y]) for x, y in zip(i, j)]
    sets: dict = {}
    for x in {*i.tolist(), *j.tolist()}:
        sets[x] = {c for c in caps[x].tolist() if c < cap}
    return [(nodes[x], nodes[y]) for x, y in zip(i.tolist(), j.tolist()) if not sets[x] & sets[y]]


def _verify_batches(kind: str, least: float):
    """Reads units one after the other (rows are sorted by unit); holds one unit."""

    def run(batches):
        import pyarrow as pa

        unit, rows, out = None, [], []

        def links():
            if len(rows) < 2:
                return []
            nodes, blocks, data, caps = zip(*rows)
            return _linked(nodes, blocks, _unit(data, kind), [np.array(c) for c in caps], unit[1], unit[2], unit[3], least)

        def flush():
            a, b = zip(*out)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            columns = batch.to_pydict()
            for key, cap, low, high, node, block, data, caps in zip(*(columns[n] for n in (
                    "key", "cap", "low", "high", "node", "block", "data", "caps"))):
                if (key, cap, low, high) != unit:
                    out += links()
                    unit, rows = (key, cap, low, high), []
                    if len(out) > 50_000:
                        yield flush()
                rows.append((node, block, data, caps))
        out += links()
        if out:
            yield flush()

    return run


def link_groups(vectors: DataFrame, least: float = LEAST_COSINE, block: int = BLOCK):
    """(table of all rows with their class key, classes, links between classes)."""
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"
    element = "float" if kind == "<f4" else "double"
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"),
                          F.col("embedding").cast(f"array<{element}>").alias("embedding"))
    table = cut(map_arrow(rows, _read_batches(kind), "vec_id bigint, label string, key binary, data binary")
                .select(F.monotonically_increasing_id().alias("uid"), "*"), "vectors")
    classes = cut(table.where("key is not null").groupBy("key").agg(
        F.min("uid").alias("node"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least_id"),
        F.first("label").alias("label"), F.first("data").alias("data")), "vector-classes")
    largest = classes.groupBy("label", F.length("data")).count().agg(F.max("count").alias("n")).first().n or 1
    decoded = cut(map_arrow(classes.select("node", "label", "data"), _decode_batches(kind, largest, least),
                            "node bigint, label string, data binary, caps array<bigint>"), "caps")
    entries = decoded.select("node", F.explode("caps").alias("cap"), F.xxhash64("label", F.length("data")).alias("key"))
    shared = entries.groupBy("key", "cap").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn(
        "blocks", F.ceil(F.col("n") / block).cast("int"))
    units = (entries.join(shared, ["key", "cap"])
             .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("key", "cap", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "block"))
    work = units.join(decoded.select("node", "data", "caps"), "node")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    work = work.repartition(parts, "key", "cap", "low", "high").sortWithinPartitions("key", "cap", "low", "high")
    links = cut(map_arrow(work, _verify_batches(kind, least), "a bigint, b bigint"), "vector-links")
    return table, classes, links


def near_vectors(vectors: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    table, classes, links = link_groups(vectors, least)
    both = links.union(links.select("b", "a")).toDF("node", "near")
    sizes = both.join(classes.select(F.col("node").alias("near"), "copies"), "near").groupBy("node").agg(F.sum("copies").alias("others"))
    placed = components(links).withColumnRenamed("node", "member")
    nodes = (classes.join(sizes, "node", "left").join(placed, F.col("node") == F.col("member"), "left")
             .select("key", F.coalesce("component", "node").alias("component"), "least_id",
                     (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")))
    nodes = cut(nodes, "vector-nodes")
    heads = nodes.groupBy("component").agg(F.min("least_id").alias("component_id"))
    known = nodes.join(heads, "component").select("key", "n_links", "component_id")
    out = table.select("vec_id", "key").join(known, "key", "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
                      F.col("vec_id").eqNullSafe(component).alias("kept"))
