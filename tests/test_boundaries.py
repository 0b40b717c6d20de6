"""Splits by boundary keys against a plain sort."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loglens.operators import boundaries
from loglens.operators.boundaries import boundary_split, key_at

SCHEMA = "uid int, timestamp timestamp_ntz, name string, n bigint"
T0 = dt.datetime(2024, 1, 1)


def brute(rows, keys):
    """uid -> split by position in the sorted list (nulls first)."""
    order = sorted(rows, key=lambda r: [(r[k] is not None, r[k]) if r[k] is not None else (False,) for k in keys])
    n = len(order)
    ends = int(n * 0.70), int(n * (0.70 + 0.15))
    return {r[0]: "train" if i < ends[0] else "val" if i < ends[1] else "test" for i, r in enumerate(order)}


def labels(df, tiebreak):
    return {r.uid: r.split for r in boundary_split(df, tiebreak=tiebreak).select("uid", "split").collect()}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 90, 170, 333])
def test_split_equals_a_sort(spark, n):
    r = random.Random(n)
    rows = [(i, T0 + dt.timedelta(microseconds=r.randrange(10**12)), "x", i) for i in range(n)]
    assert labels(spark.createDataFrame(rows, SCHEMA).repartition(3), ["n"]) == brute(rows, [1, 3])


@pytest.mark.parametrize("tiebreak,keys", [(["n"], [1, 3]), (["name", "n"], [1, 2, 3])])
def test_ties_and_nulls(spark, tiebreak, keys):
    """A third of all rows at one time, null tie-breaks, text that must be ordered."""
    r = random.Random(1)
    ids = list(range(400))
    r.shuffle(ids)
    rows = [(i, T0 if r.random() < 0.4 else T0 + dt.timedelta(hours=r.randrange(-30, 30)), r.choice(["a", "b", "ü", "", None]), i if i else None)
            for i in ids]
    assert labels(spark.createDataFrame(rows, SCHEMA).repartition(4), tiebreak) == brute(rows, keys)


def test_copies_are_split_at_the_exact_rank(spark):
    """All rows equal: no key tells them apart, the counts must still be right."""
    df = spark.range(1000).select(F.lit(1).alias("uid"), F.lit(T0).cast("timestamp_ntz").alias("timestamp"), F.lit("a").alias("name"))
    got = {r.split: r["count"] for r in boundary_split(df, tiebreak=["name"]).groupBy("split").count().collect()}
    assert got == {"train": 700, "val": 150, "test": 150}


def test_empty(spark):
    assert boundary_split(spark.createDataFrame([], SCHEMA), tiebreak=["n"]).count() == 0


def test_refinement_goes_on_inside_a_bin(spark, monkeypatch):
    monkeypatch.setattr(boundaries, "BINS", 3)
    values = [-2**63, -5, -5, 0, 1, 1, 1, 7, 2**40, 2**63 - 1]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 2, "v bigint")
    for rank, want in enumerate([None, None, *values]):
        assert key_at(df, ["v"], rank)[0] == want
    text = spark.createDataFrame([(c,) for c in "hello world again"], "c string")
    for rank, want in enumerate(sorted("hello world again")):
        assert key_at(text, ["c"], rank)[0] == want


def test_wide_rows_are_not_shuffled(spark):
    rows = [(i, T0 + dt.timedelta(seconds=i), "x", i) for i in range(50)]
    plan = boundary_split(spark.createDataFrame(rows, SCHEMA), tiebreak=["n"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "InMemory" not in plan
