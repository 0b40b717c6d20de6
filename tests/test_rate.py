import datetime as dt
import random

from pyspark.sql import functions as F

from loglens.operators import rate
from loglens.operators.rate import request_rate

SCHEMA = "id long, client_ip string, timestamp timestamp_ntz"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def t(h, m, s, us=0):
    return dt.datetime(2026, 1, 5, h, m, s, us)


def rates(df, **kw):
    return {r.id: r.request_rate for r in request_rate(df, **kw).collect()}


def test_documented_example(spark):
    df = frame(spark, [(1, "A", t(10, 0, 0)), (2, "A", t(10, 0, 10)), (3, "A", t(10, 0, 50)), (4, "A", t(10, 1, 20))])
    for method in ("bucketed", "window", "dense", "auto"):
        assert rates(df, method=method) == {1: 1.0, 2: 2.0, 3: 3.0, 4: 2.0}


def test_ties_exact_gap_and_nulls(spark):
    df = frame(spark, [(1, "A", t(10, 0, 0)), (2, "A", t(10, 0, 0)), (3, "A", t(10, 1, 0)),
                       (4, "A", None), (5, "A", None), (6, None, t(10, 0, 0))])
    for method in ("bucketed", "window", "dense", "auto"):
        assert rates(df, method=method) == {1: 2.0, 2: 2.0, 3: 3.0, 4: 0.0, 5: 0.0, 6: 0.0}


def test_bucket_boundaries_and_bursts_match_brute_force(spark):
    rng = random.Random(7)
    rows, i = [], 0
    base = dt.datetime(2026, 1, 5)
    for ip in ["hot"] * 3 + ["a", "b", "c"]:
        for _ in range(400):
            # bursts of near-identical times plus spread; some exactly on bucket edges
            sec = rng.choice([rng.uniform(0, 7200), 240 * rng.randint(0, 30), 600 + rng.uniform(0, 2)])
            rows.append((i, ip, base + dt.timedelta(seconds=round(sec, 3))))
            i += 1
    df = frame(spark, rows)
    by_ip = {}
    for rid, ip, ts in rows:
        by_ip.setdefault(ip, []).append(ts)
    expect = {rid: float(sum(1 for u in by_ip[ip] if ts - dt.timedelta(seconds=60) <= u <= ts))
              for rid, ip, ts in rows}
    assert rates(df, method="bucketed") == expect
    assert rates(df, method="bucketed", bucket_seconds=60) == expect
    assert rates(df, method="window") == expect
    assert rates(df, method="dense") == expect


def test_crowded_clients_take_the_dense_plan(spark, monkeypatch):
    """Clients with a crowded bucket are rated by ranges, the others by buckets; both in one result."""
    rng = random.Random(3)
    base = dt.datetime(2026, 1, 5)
    rows = [(i, rng.choice(["hot", "hot", "hot", "a", "b", None]), base + dt.timedelta(microseconds=rng.randrange(90 * 10**6)))
            for i in range(900)] + [(900, "a", None), (901, "hot", None)]
    df = frame(spark, rows).repartition(3)
    monkeypatch.setattr(rate, "CROWDED", 200)
    plain = rates(df, method="bucketed")
    assert rates(df, method="auto") == plain == rates(df, method="dense")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    monkeypatch.setattr(rate, "PIECE_BITS", 4)
    try:  # one client's minute lies in several ranges, each in several pieces
        keys = rate.key_table(df.where("client_ip = 'hot'"))
        assert {(r.client_ip, r.timestamp): r.request_rate for r in rate.rate_table(keys, method="dense").collect()} == \
            {(r.client_ip, r.timestamp): r.request_rate for r in rate.rate_table(keys, method="window").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    split = df.withColumn("part", F.col("id") % 2)
    assert rates(split, method="dense", partition_cols=["part"]) == rates(split, method="bucketed", partition_cols=["part"])


def test_partition_columns_keep_frames_apart(spark):
    df = spark.createDataFrame([(1, "A", t(10, 0, 0), "train"), (2, "A", t(10, 0, 5), "val")],
                               SCHEMA + ", split string")
    out = {r.id: r.request_rate for r in request_rate(df, partition_cols=["split"]).collect()}
    assert out == {1: 1.0, 2: 1.0}
    assert {r.id: r.request_rate for r in request_rate(df).collect()} == {1: 1.0, 2: 2.0}


def test_keeps_all_columns(spark):
    df = frame(spark, [(1, "A", t(10, 0, 0))]).withColumn("extra", F.lit("x"))
    assert request_rate(df).columns == ["id", "client_ip", "timestamp", "extra", "request_rate"]


def test_daylight_saving_zone_does_not_matter(spark):
    # 2026-03-08 02:00-03:00 does not exist in New York; wall-clock arithmetic must still hold
    rows = [(1, "A", dt.datetime(2026, 3, 8, 1, 59, 30)), (2, "A", dt.datetime(2026, 3, 8, 2, 0, 20)),
            (3, "A", dt.datetime(2026, 3, 8, 3, 0, 10)), (4, "A", dt.datetime(2026, 11, 1, 1, 30, 0)),
            (5, "A", dt.datetime(2026, 11, 1, 1, 30, 50))]
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        for method in ("bucketed", "window", "dense", "auto"):
            assert rates(frame(spark, rows), method=method) == {1: 1.0, 2: 2.0, 3: 1.0, 4: 1.0, 5: 2.0}
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
