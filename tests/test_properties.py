"""Property tests: distributed operators against brute force on random inputs."""

import datetime as dt

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loglens.operators.quantiles import quantile_values
from loglens.operators.rate import request_rate
from loglens.operators.threshold import best_threshold, threshold_sweep
from tests.test_threshold import f1_at

BASE = dt.datetime(2026, 1, 5)
SETTINGS = settings(max_examples=12, deadline=None, derandomize=True)

events = st.lists(st.tuples(st.sampled_from(["a", "b", "hot"]), st.integers(0, 900)), min_size=1, max_size=120)


@SETTINGS
@given(events, st.sampled_from([1, 7, 60]), st.sampled_from([None, 1, 2, 5]))
def test_rate_matches_brute_force(spark, rows, window, bucket_factor):
    data = [(i, ip, BASE + dt.timedelta(seconds=s)) for i, (ip, s) in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, client_ip string, timestamp timestamp_ntz")
    bucket = None if bucket_factor is None else bucket_factor * window
    got = {r.id: r.request_rate for r in request_rate(df, window, bucket_seconds=bucket).collect()}
    expect = {i: float(sum(1 for _, ip2, t2 in data if ip2 == ip and t - dt.timedelta(seconds=window) <= t2 <= t))
              for i, ip, t in data}
    assert got == expect


@SETTINGS
@given(st.lists(st.one_of(st.integers(-5, 5).map(float), st.floats(-1e3, 1e3)), min_size=1, max_size=200),
       st.lists(st.floats(0, 1), min_size=1, max_size=4), st.integers(1, 9))
def test_quantiles_match_numpy(spark, values, probs, parts):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = quantile_values(df, ["x"], probs, num_partitions=parts)[("x",)]
    for p in probs:
        assert got[p] == np.percentile(np.array(values), p * 100) or \
            abs(got[p] - np.percentile(np.array(values), p * 100)) <= 1e-9 * max(1.0, abs(got[p]))


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 50).map(lambda x: x / 50), st.integers(0, 1)), min_size=1, max_size=150))
def test_threshold_is_the_best_step(spark, rows):
    scores, labels = [float(s) for s, _ in rows], [y for _, y in rows]
    df = spark.createDataFrame(list(zip(scores, labels)), "anomaly_score double, is_anomaly int")
    sweep = threshold_sweep(df).collect()
    best = max(f1_at(scores, labels, r.threshold) for r in sweep)
    r = best_threshold(threshold_sweep(df)).first()
    assert abs(r.f1 - best) <= 1e-12 and abs(f1_at(scores, labels, r.threshold) - best) <= 1e-12
    assert all(f1_at(scores, labels, x.threshold) < best for x in sweep if x.threshold < r.threshold)
