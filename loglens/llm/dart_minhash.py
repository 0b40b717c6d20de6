"""Near-duplicate documents by DartMinHash signatures and banded joining.

A document is a weighted set: its shingles of five words (weight 1 each for plain Jaccard, or their
counts for weighted Jaccard).  Instead of hashing every shingle once per coordinate, hashed darts
are thrown at the plane of weight and rank: each unit square of a shingle's region gets a Poisson(1)
number of darts at hashed places, the same in every document.  A dart belongs to a document if
it falls below the shingle's weight; each dart names a coordinate, and the earliest dart (by
rank) of each coordinate is kept.  A document needs about k (ln k + 2) darts for k coordinates
whatever its length; ranks are extended until no coordinate is empty.  Two documents agree in a
coordinate with the probability of their similarity (published by Christiani, 2020).

Spark's part: copies collapse to classes first (map-side minimum).  The classes' bands are grouped, and
each bucket offers pairs of its members with its least member, never all pairs.  Pairs whose
signatures agree enough are compared on their real texts, and settled pairs merge by connected
components, in a fixed few steps: a node's most agreeing pair first, then all its pairs that are still in
different components.  At the end members of one bucket that remain in different components are
compared with each other, so no link is lost to the choice of the bucket's least member.  In a bucket with many of them pairs come from
an exact prefix filter: shingles are ordered from rare to common, and only texts that share one of their first shingles, at
places that leave enough of both texts behind, and whose parity bitmaps differ little enough, can be linked.

Defined results: a document without words (or with a null text) is alone; one of fewer than five
words is one shingle; ties and repeated rows are copies, of which the row with the smallest id stays (null
ids last); null ids are kept in the result; columns of the input that clash with names used here
are safe, as the input row travels in one struct; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglens.llm.common import cut, join_checked, map_arrow, row_with_text, texts
from loglens.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 36
BAND_SIZE = 7
#: Shingles (16 bytes each) that a task remembers while it compares texts.
KNOWN_SHINGLES = 2_000_000
#: Buckets that would offer more pairs between their components go through the prefix filter.
CROWDED = 1_000
#: 64-bit words of a set's parity bitmap.
BITMAP_WORDS = 8
#: So many node numbers (8 bytes each) may be broadcast to pick their texts; beyond, the texts are shuffled once.
BROADCAST_NODES = 1_000_000
#: Signatures are compared with this much slack (five standard deviations of the estimate) before texts are.
SLACK = 5.0

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(18)])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public domain constants of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


def signature(elements: np.ndarray, weights: np.ndarray | None, k: int) -> np.ndarray:
    """k 16-bit prints of the earliest darts; ``elements`` are distinct 64-bit hashes, ``weights`` default to 1."""
    if weights is None:
        seeds, floor, limit = mix(elements + _GOLDEN), None, None
        total = float(len(elements))
    else:
        cells = np.ceil(weights).astype(np.int64)
        floor = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)  # the weight cell of each square
        seeds = np.repeat(mix(elements + _GOLDEN), cells) ^ mix(floor.astype(np.uint64) * _GOLDEN)  # mix(0) is 0
        limit, total = np.repeat(weights, cells), float(weights.sum())
    out = np.zeros(k, np.uint16)
    empty = np.ones(k, bool)
    low, high = 0, max(1, math.ceil(k * (math.log(k) + 2) / total))
    while empty.any():
        for at in range(low, high, max(1, 1_000_000 // len(seeds))):
            ranks = np.arange(at, min(high, at + max(1, 1_000_000 // len(seeds))), dtype=np.uint64)
            square = mix((seeds[:, None] + (ranks[None, :] + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)).ravel())
            count = np.searchsorted(_POISSON, _unit(square), side="right")
            which = np.repeat(np.arange(len(square)), count)
            number = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            dart = mix(square[which] + (number.astype(np.uint64) + np.uint64(1)) * _GOLDEN)
            place = mix(dart ^ np.uint64(0xA0761D6478BD642F))
            if limit is not None:
                inside = floor[which // len(ranks)] + _unit(mix(dart ^ np.uint64(0xE7037ED1A0B428DB))) < limit[which // len(ranks)]
                which, dart, place = which[inside], dart[inside], place[inside]
            rank = ranks[which % len(ranks)] + _unit(place)
            coordinate = ((dart >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(rank)[::-1]
            first = np.full(k, -1)
            first[coordinate[order]] = order  # the earliest dart is written last
            fresh = empty & (first >= 0)
            out[fresh] = (dart[first[fresh]] & np.uint64(0xFFFF)).astype(np.uint16)
            empty &= ~fresh
            if not empty.any():
                break
        low, high = high, 2 * high
    return out


_WORDS: dict[bytes, int] = {}


def shingle_hashes(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """One 64-bit hash per window of ``size`` words, in order (one for all words of a shorter text)."""
    from xxhash import xxh3_64_intdigest

    if len(_WORDS) > 200_000:
        _WORDS.clear()
    numbers = []
    for w in words:
        n = _WORDS.get(w)
        if n is None:
            n = xxh3_64_intdigest(w)
            if len(w) <= 256:
                _WORDS[w] = n
        numbers.append(n)
    x = np.array(numbers, np.uint64)
    n = max(1, len(x) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(size, len(x))):
        out = mix(out * _GOLDEN + x[k:k + n])
    return out


def _sign_batches(k: int, size: int, weighted: bool):
    def run(batches):
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        recent: dict[bytes, bytes] = {}  # copies that follow one another are signed once
        for batch in batches:
            copy, prints = [], []
            for text in texts(batch):
                words = (text.as_py() or "").encode().split()
                if not words:
                    copy.append(None)
                    prints.append(None)
                    continue
                key = xxh3_128_digest(b" ".join(words))
                if key not in recent:
                    if len(recent) > 2000:
                        recent.clear()
                    hashes, counts = np.unique(shingle_hashes(words, size), return_counts=True)
                    recent[key] = signature(hashes, counts.astype(np.float64) if weighted else None, k).tobytes()
                copy.append(key)
                prints.append(recent[key])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(copy, pa.binary()), pa.array(prints, pa.binary())],
                                             [*batch.schema.names, "copy", "prints"])
        _WORDS.clear()  # the worker goes on to other work

    return run


def signed(docs: DataFrame, keep: list[str], k: int = BANDS * BAND_SIZE, size: int = SHINGLE,
           weighted: bool = False) -> DataFrame:
    """A written table: a row number, the kept columns, the text, the copy key and the signature."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), *row_with_text(docs, keep))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", copy binary, prints binary"
    out = map_arrow(rows, _sign_batches(k, size, weighted), schema)
    text = "_text" if "_text" in rows.columns else "row.text"
    table = cut(out.select(F.monotonically_increasing_id().alias("uid"), *out.columns), "signed")
    return table.select("uid", "row", "id", F.col(text).alias("_text"), "copy", "prints")


def similarity(a: list, b: list, size: int = SHINGLE, weighted: bool = False) -> float:
    """Jaccard similarity of the word shingles of two texts given as words."""
    return _overlap(_shingles(a, size), _shingles(b, size), weighted)


def _shingles(words: list, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 64-bit hashes of the distinct shingles, and their counts."""
    return np.unique(shingle_hashes(words, size), return_counts=True)


def _overlap(x: tuple, y: tuple, weighted: bool) -> float:
    """Jaccard similarity of two sorted shingle sets, by their counts if ``weighted``."""
    at = np.minimum(np.searchsorted(y[0], x[0]), len(y[0]) - 1)
    same = y[0][at] == x[0]
    if not weighted:
        both = int(same.sum())
        return both / (len(x[0]) + len(y[0]) - both)
    both = int(np.minimum(x[1][same], y[1][at[same]]).sum())
    return both / (int(x[1].sum()) + int(y[1].sum()) - both)


def _verify_batches(size: int, weighted: bool, least: float):
    def run(batches):
        import pyarrow as pa

        known: dict = {}  # a hub's text comes with many pairs
        held = 0

        def shingles(uid, text):
            nonlocal held
            if uid not in known:
                if held >= KNOWN_SHINGLES:
                    known.clear()
                    held = 0
                known[uid] = _shingles(text.as_py().encode().split(), size)
                held += len(known[uid][0])
            return known[uid]

        for batch in batches:
            ok = [_overlap(shingles(a, x), shingles(b, y), weighted) >= least for a, b, x, y in
                  zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], ["a", "b", "linked"])
        _WORDS.clear()

    return run


def _agree_batches(least: float, band_size: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            share, near = [], []
            for x, y in zip(batch.column(2), batch.column(3)):
                same = np.frombuffer(x.as_py(), np.uint16) == np.frombuffer(y.as_py(), np.uint16)
                share.append(float(same.mean()))
                near.append(share[-1] >= least and bool(same.reshape(-1, band_size).all(1).any()))
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(share, pa.float64())], ["a", "b", "agree"])
            yield out.filter(pa.array(near, pa.bool_()))

    return run


def _pairs_with(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """(a, b, x, y): written pairs with a column of both rows, fetched one after the other."""
    left = pairs.join(table.select(F.col("uid").alias("a"), F.col(column).alias("x")), "a")
    return left.join(table.select(F.col("uid").alias("b"), F.col(column).alias("y")), "b").select("a", "b", "x", "y")


def _texts_of(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """A written table of the texts that pairs name: later steps don't move the others."""
    nodes = cut(pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct(), "near-nodes")
    return cut(_those(table.select("uid", "_text"), nodes), "near-texts")


def _those(table: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows whose ``uid`` is among the written ``nodes``."""
    return table.join(F.broadcast(nodes) if nodes.count() <= BROADCAST_NODES else nodes, "uid", "left_semi")


def _shingle_batches(size: int, weighted: bool):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                hashes, counts = _shingles(text.as_py().encode().split(), size)
                if weighted:  # the n-th copy of a shingle is an element of its own
                    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                    hashes = mix(np.repeat(hashes, counts) ^ mix(nth.astype(np.uint64) * _GOLDEN))
                for at in range(0, len(hashes), 100_000):
                    some = hashes[at:at + 100_000].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), node, np.int64)), pa.array(some)], ["node", "shingle"])
        _WORDS.clear()

    return run


def _prefix_pairs(crowded: DataFrame, table: DataFrame, least: float, size: int, weighted: bool) -> DataFrame:
    """(low, high): every pair of nodes of different components that can reach ``least``.

    The overlap of two sets of m and n elements at similarity t is at least t max(m, n) and t (m + n) / (1 + t).  So the first
    element they share, in one order for all sets, lies among the first m - t m + 1 and n - t n + 1 ones, and as many elements
    as the overlap needs follow it in both.  The order is from rare to common, as what many sets share tells little.
    A bit of a parity bitmap turns over with every element that falls on it, so two bitmaps differ in at most as many bits
    as the sets differ in elements, which are (m + n) (1 - t) / (1 + t) at most.
    """
    nodes = cut(crowded.groupBy("node").agg(F.first("component").alias("component"), F.max(F.col("component") != F.col("main")).alias("outer")),
                "crowded")
    texts = _those(table.select("uid", "_text"), nodes.select(F.col("node").alias("uid")))
    shingles = cut(map_arrow(texts, _shingle_batches(size, weighted), "node bigint, shingle bigint"), "shingles")
    common = shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("common"))
    own = Window.partitionBy("node")
    placed = (shingles.join(common, "shingle")
              .select("node", "shingle", (F.row_number().over(own.orderBy("common", "shingle")) - 1).alias("at"), F.count(F.lit(1)).over(own).alias("n"))
              .where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * least - 1e-6)))
    word, bit = F.pmod(F.shiftright("shingle", 6), F.lit(BITMAP_WORDS)), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("shingle").bitwiseAND(63).cast("int"))
    words = [f"w{k}" for k in range(BITMAP_WORDS)]
    bitmaps = shingles.groupBy("node").agg(*[F.bit_xor(F.when(word == k, bit).otherwise(0)).alias(w) for k, w in enumerate(words)])
    placed = cut(placed.join(nodes.join(bitmaps, "node"), "node"), "prefixes")
    x = placed.where("outer").select("shingle", F.col("node").alias("a"), F.col("component").alias("ca"), F.col("at").alias("i"), F.col("n").alias("m"),
                                     *[F.col(w).alias(f"x{w}") for w in words])
    y = placed.select("shingle", F.col("node").alias("b"), F.col("component").alias("cb"), F.col("at").alias("j"), "n", F.col("outer").alias("both"), *words)
    enough = F.least(F.col("m") - F.col("i"), F.col("n") - F.col("j")) >= (F.col("m") + F.col("n")) * (least / (1 + least)) - 1e-6
    differing = sum(F.bit_count(F.col(w).bitwiseXOR(F.col(f"x{w}"))) for w in words)
    enough &= differing <= (F.col("m") + F.col("n")) * ((1 - least) / (1 + least)) + 1e-6
    pairs = x.join(y, "shingle").where((F.col("ca") != F.col("cb")) & (~F.col("both") | (F.col("a") < F.col("b"))) & enough)
    return pairs.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct()


def near_groups(docs: DataFrame, keep: list[str], least: float = SIMILARITY, bands: int = BANDS,
                band_size: int = BAND_SIZE, size: int = SHINGLE, weighted: bool = False) -> DataFrame:
    """``row``, ``uid``, ``n_copies`` (rows with the same words), ``component`` (id of the row that stays) and ``kept``."""
    k = bands * band_size
    table = signed(docs, keep, k, size, weighted)
    first = F.struct(F.col("id").isNull().alias("none"), "id", "uid")
    classes = cut(table.where("copy is not null").groupBy("copy").agg(
        F.min(first).alias("first"), F.count(F.lit(1)).alias("n_copies")).select(
        "copy", "n_copies", "first", F.col("first.uid").alias("node")), "copies")
    nodes = table.select(F.col("uid").alias("node"), "prints").join(classes.select("node"), "node", "left_semi")

    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(
        i, F.substring(F.col("prints"), i * (2 * band_size) + 1, F.lit(2 * band_size)))))
    rows = nodes.select("node", band.alias("bucket"))
    hubs = rows.groupBy("bucket").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = cut(rows.join(hubs.select("bucket", "hub"), "bucket"), "buckets")

    slack = SLACK * math.sqrt(least * (1 - least) / k)
    verify = _verify_batches(size, weighted, least)

    def agreeing(pairs, name):
        return cut(map_arrow(_pairs_with(pairs, table, "prints"), _agree_batches(least - slack, band_size),
                             "a bigint, b bigint, agree double"), name)

    offered = cut(members.where("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "offered")
    found = _settle(agreeing(offered, "agreeing"), table, None, verify)

    # buckets whose members are still in different components: members outside a bucket's main component meet
    # those of the other components, once; members of one component never meet
    placed = members.select("bucket", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    main = (placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket")
            .agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("parts"),
                 ((F.sum("n") - F.max("n")) * F.sum("n") > CROWDED).alias("crowded")).where("parts > 1"))
    placed = cut(placed.join(main.select("bucket", "main", "crowded"), "bucket"), "unsettled")
    few = placed.where("not crowded")
    x = few.where("component != main").select("bucket", F.col("node").alias("a"), F.col("component").alias("ca"))
    y = few.select("bucket", F.col("node").alias("b"), F.col("component").alias("cb"), "main")
    pairs = x.join(y, "bucket").where("ca != cb and (cb = main or a < b)").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
    crowded = placed.where("crowded")
    if not crowded.isEmpty():
        pairs = pairs.union(_prefix_pairs(crowded, table, least, size, weighted))
    # the same pair in several buckets, or offered before
    pairs = cut(pairs.distinct().join(offered.toDF("low", "high"), ["low", "high"], "left_anti").toDF("a", "b"), "offered-again")
    found = _settle(agreeing(pairs, "agreeing-again"), table, found, verify)
    return _placed(table, classes, found)


#: A node's pairs are compared in so many steps, by rank of their agreement; all that is left comes in the last.
STEPS = (1, 16, 256, None)


def _settle(near: DataFrame, table: DataFrame, found: DataFrame | None, verify) -> DataFrame:
    """Components (node, component) after pairs are compared on their texts: each node's best agreeing pairs first, as
    a pair within a component needs no comparison; every other pair is compared."""
    rank = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("agree"), "a"))
    near = cut(near.withColumn("rank", rank), "ranked")
    if found is None:
        found = cut(near.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0), "components")
    most = near.agg(F.max("rank").alias("most")).first().most or 0
    texts = _texts_of(near, table) if most else None
    low = 0
    for high in STEPS:
        if low >= most:
            break
        pairs = near.where(F.col("rank") > low)
        pairs = pairs if high is None else pairs.where(F.col("rank") <= high)
        pairs = (pairs.join(found.toDF("a", "ca"), "a", "left").join(found.toDF("b", "cb"), "b", "left")
                 .where("coalesce(ca, a) != coalesce(cb, b)").select("a", "b"))
        pairs = cut(pairs, "compared")
        passed = cut(map_arrow(_pairs_with(pairs, texts, "_text"), verify, "a bigint, b bigint, linked boolean")
                     .where("linked").select("a", "b"), "links-found")
        if not passed.isEmpty():
            found = cut(components(found.toDF("a", "b").union(passed)), "components")
        low = high
    return found


def _placed(table: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """Every row with its component's first row."""
    nodes = classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = nodes.groupBy("component").agg(F.min("first").alias("head"))
    # copies and links are few against documents; what is neither needs no entry
    moved = (nodes.join(heads, "component").where("n_copies > 1 or head.uid != node")
             .select("copy", "n_copies", F.col("head.uid").alias("head_uid"), F.col("head.id").alias("head_id")))
    joined = join_checked(table.select("uid", "row", "id", "copy"), moved, ["copy"], "left", "groups")
    return joined.select("uid", "row", F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
                         F.when(F.col("head_uid").isNull(), F.col("id")).otherwise(F.col("head_id")).alias("component"),
                         (F.coalesce("head_uid", "uid") == F.col("uid")).alias("kept"))


def representatives(docs: DataFrame) -> DataFrame:
    """The documents that stay, with the input's columns."""
    return near_groups(docs, docs.columns).where("kept").select("row.*")
