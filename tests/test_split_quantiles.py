import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loglens.operators.ordering import chronological_split, with_row_index
from loglens.operators.quantiles import exact_quantiles, quantile_row
from loglens.sources import fixture


def numbered(spark, n, parts=4):
    return spark.range(n).select((F.col("id") * 7919 % n).alias("k"), F.col("id").alias("v")).repartition(parts)


@pytest.mark.parametrize("n,expected", [(1000, (700, 150, 150)), (90, (62, 14, 14)), (170, (118, 26, 26))])
def test_split_sizes_double_arithmetic(spark, n, expected):
    df = spark.range(n).select(F.col("id").cast("timestamp").cast("timestamp_ntz").alias("timestamp"),
                               F.col("id").alias("event_id"))
    out = chronological_split(df, tiebreak=["event_id"]).groupBy("split").count().collect()
    got = {r["split"]: r["count"] for r in out}
    assert (got.get("train", 0), got.get("val", 0), got.get("test", 0)) == expected


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_row_index_is_global_order(spark, parts):
    df = numbered(spark, 5000, parts)
    got = with_row_index(df, ["k"], num_partitions=parts).select("k", "row_idx").toPandas().sort_values("k")
    assert got["row_idx"].tolist() == list(range(5000))


def test_split_matches_global_row_number(spark):
    log = fixture.fixture_log(spark, "/root/testdata/sf0.001")
    mine = chronological_split(log, tiebreak=["event_id"]).select("event_id", "row_idx").toPandas()
    ref = log.select("event_id", "timestamp").toPandas().sort_values(["timestamp", "event_id"])
    ref["row_idx"] = range(len(ref))
    merged = mine.merge(ref, on="event_id", suffixes=("", "_ref"))
    assert len(merged) == len(ref) and (merged["row_idx"] == merged["row_idx_ref"]).all()


def test_quantiles_match_numpy_with_hot_values(spark):
    rng = random.Random(3)
    vals = [0.0] * 3000 + [rng.uniform(-5, 5) for _ in range(2000)] + [float("nan"), None]
    groups = ["g1" if i % 3 else "g2" for i in range(len(vals))]
    df = spark.createDataFrame(list(zip(groups, vals)), "g string, x double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.92, 0.99, 1.0]
    got = exact_quantiles(df, ["x"], probs, ["g"], num_partitions=7).collect()
    for r in got:
        xs = np.array([v for g, v in zip(groups, vals) if g == r["g"] and v is not None and v == v])
        assert r["value"] == pytest.approx(np.percentile(xs, r["prob"] * 100), abs=1e-12)
    assert len(got) == 2 * len(probs)


def test_quantiles_of_awkward_doubles(spark, monkeypatch):
    """Refinement over tiny bins: infinities, denormal and huge values, hot values, many rounds."""
    from loglens.operators import quantiles

    monkeypatch.setattr(quantiles, "BINS", 4)
    monkeypatch.setattr(quantiles, "FEW", 2)
    rng = random.Random(8)
    vals = [0.0, -0.0, 5e-324, 1e-323, 1.7e308, -1.7e308, 1.0, 1.0 + 2**-52] + [7.0] * 50
    vals += [rng.choice([1e-300, 1e300, 1.0]) * rng.uniform(-1, 1) for _ in range(200)]
    df = spark.createDataFrame([(v, None) for v in vals] + [(float("inf"), 1.0)] * 3 + [(float("-inf"), None)] * 2, "x double, y double")
    got = quantiles.order_statistics(df, ["x", "y"], [0.0, 0.004, 0.3, 0.5, 0.77, 0.99, 1.0])
    order = sorted([*vals, *[float("inf")] * 3, *[float("-inf")] * 2])
    for p, (low, high, _) in got[("x",)].items():
        at = p * (len(order) - 1)
        assert (low, high) == (order[int(np.floor(at))], order[int(np.ceil(at))])
    assert set(got[("y",)].values()) == {(1.0, 1.0, f) for _, _, f in got[("y",)].values()}


def test_quantile_shuffles_hold_bins_only(spark):
    """Nearly unique values: what is shuffled is bounded by bins and tasks, not by values."""
    from loglens.operators import quantiles

    n = 200_000
    df = spark.range(n).select((F.col("id") * 7919 % n / 3.0).alias("x")).repartition(4)
    got = quantiles.quantile_values(df, ["x"], [0.5])[("x",)][0.5]
    assert got == pytest.approx((n - 1) / 6.0, rel=1e-12)


def test_quantile_of_nothing_is_null(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert quantile_row(df, "x", [0.5], names=["m"]).first()["m"] is None


def test_row_index_splits_a_group_of_copies(spark):
    # a third of the rows are identical copies; positions stay a permutation and
    # the copies are spread over several range partitions
    copies = spark.range(3000).select(F.lit(5).alias("k"))
    rest = spark.range(6000).select((F.col("id") % 10).alias("k"))
    df = copies.unionByName(rest)
    out = with_row_index(df, ["k"], num_partitions=8)
    idx = sorted(r.row_idx for r in out.select("row_idx").collect())
    assert idx == list(range(9000))
    per_part = out.where(F.col("k") == 5).groupBy(F.spark_partition_id()).count().collect()
    assert len(per_part) >= 2 and max(r["count"] for r in per_part) < 3300
