import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from loglens.operators.ordering import chronological_split
from loglens.plans.feature_builder import FeatureBuilder, feature_matrix
from loglens.schema import FEATURE_COLUMNS
from loglens.sources import fixture

SCHEMA = ("event_id long, timestamp timestamp_ntz, client_ip string, endpoint_uri string, http_method string, "
          "response_time_ms double, status_code int, bytes_sent long")


def log(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def row(i, ip="ip1", ep="/a", method="GET", lat=100.0, status=200, nbytes=0, minute=0):
    return (i, dt.datetime(2026, 1, 5, 7, minute, i % 60), ip, ep, method, lat, status, nbytes)


def test_log1p_goldens(spark):
    df = log(spark, [row(i, lat=v) for i, v in enumerate([0.0, 100.0, 1000.0, 10000.0])])
    feats = FeatureBuilder().fit_transform(df).orderBy("event_id").collect()
    assert [round(r.response_time_log1p, 3) for r in feats] == [0.0, 4.615, 6.909, 9.210]


def test_endpoint_share_and_ip_error_rate(spark):
    rows = [row(i, ep="/hot" if i < 70 else "/cold") for i in range(700)]
    rows += [row(1000 + i, ip="ip9", status=500 if i < 3 else 200) for i in range(10)]
    fb = FeatureBuilder().fit(log(spark, rows))
    ef = {r.endpoint_uri: r.endpoint_freq for r in fb.endpoint_freq.collect()}
    assert ef["/hot"] == pytest.approx(70 / 710)
    ips = {r.client_ip: r.ip_error_rate for r in fb.ip_stats.collect()}
    assert ips["ip9"] == pytest.approx(0.3)


def test_unseen_fallbacks(spark):
    train = log(spark, [row(i, lat=float(10 * (i + 1))) for i in range(5)])
    fb = FeatureBuilder().fit(train)
    new = log(spark, [row(99, ip="new-ip", ep="/new", method="TRACE")])
    r = fb.transform(new).first()
    assert (r.endpoint_freq, r.ip_error_rate, r.ip_avg_latency, r.method_code) == (0.0, 0.0, 30.0, -1.0)


def test_infinite_latency_takes_batch_median(spark):
    rows = [row(i, lat=v) for i, v in enumerate([math.e - 1, math.e ** 2 - 1, math.e ** 3 - 1, float("inf")])]
    r = {x.event_id: x.response_time_log1p for x in FeatureBuilder().fit_transform(log(spark, rows)).collect()}
    assert r[3] == pytest.approx(2.0)


def test_shape_order_and_no_nulls(spark):
    raw = fixture.fixture_raw(spark, "/root/testdata/sf0.001")
    from loglens.operators.cleaning import clean_logs

    split = chronological_split(clean_logs(raw), tiebreak=["event_id"])
    fb = FeatureBuilder().fit(split.where(F.col("split") == "train"))
    X = feature_matrix(fb.transform(split, partition_cols=["split"]))
    assert X.columns == FEATURE_COLUMNS
    assert X.count() == split.count()
    assert X.where(" OR ".join(f"{c} IS NULL" for c in FEATURE_COLUMNS)).count() == 0
    assert all(t == "double" for _, t in X.dtypes)


def test_transform_requires_fit(spark):
    with pytest.raises(RuntimeError):
        FeatureBuilder().transform(log(spark, [row(1)]))


def test_time_features(spark):
    # Monday 2026-01-05 06:00 -> hour angle pi/2, weekday 0
    df = log(spark, [(1, dt.datetime(2026, 1, 5, 6, 0, 30), "ip", "/a", "GET", 1.0, 200, 1)])
    r = FeatureBuilder().fit_transform(df).first()
    assert r.hour_sin == pytest.approx(1.0) and r.hour_cos == pytest.approx(0.0, abs=1e-12)
    assert r.dow_sin == pytest.approx(0.0) and r.dow_cos == pytest.approx(1.0)
