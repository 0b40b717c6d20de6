"""Registered queries: a Spark callable and (where expressible) DuckDB SQL.

Every query reads the driver's tables (``events`` through the log views), so
its work grows with the data.  Doubles are rounded to 6 digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.operators import cleaning, rate
from loglens.plans import oracle_sql as O
from loglens.sources import fixture

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c):
    return F.round(c, 6)


def r9(c):
    """For means of float sums: absorbs summation-order noise without 6-digit ties."""
    return F.round(c, 9)


# ---- cleaning --------------------------------------------------------------

def _clean(spark, sf):
    return cleaning.clean_logs(fixture.fixture_raw(spark, sf))


@register("log_view", fixture.with_log_sql("SELECT * FROM log"))
def q_log_view(spark, sf):
    return fixture.fixture_log(spark, sf)


@register("raw_view", fixture.with_log_sql("SELECT * FROM raw", raw=True))
def q_raw_view(spark, sf):
    return fixture.fixture_raw(spark, sf)


_CLEAN_SQL = fixture.with_log_sql(
    "", raw=True, extra_ctes=f"parsed AS ({O.PARSED_RAW}),\nclean AS ({O.CLEAN_FROM_PARSED})")


def clean_sql(body: str) -> str:
    return _CLEAN_SQL + body


@register("clean_logs", clean_sql("SELECT * FROM clean"))
def q_clean_logs(spark, sf):
    return _clean(spark, sf)


@register("drop_invalid", clean_sql(
    "SELECT event_id FROM parsed WHERE \"timestamp\" IS NULL OR response_time_ms IS NULL "
    "OR status_code IS NULL OR bytes_sent IS NULL"))
def q_drop_invalid(spark, sf):
    raw = cleaning.alias_columns(fixture.fixture_raw(spark, sf))
    parsed = raw.withColumns(cleaning.parsed_columns(raw))
    cond = (F.col("timestamp").isNull() | F.col("response_time_ms").isNull()
            | F.col("status_code").isNull() | F.col("bytes_sent").isNull())
    return parsed.where(cond).select("event_id")


@register("valid_status", clean_sql(
    "SELECT CAST(status_code AS INTEGER) AS status_code, count(*) AS n FROM clean GROUP BY 1"))
def q_valid_status(spark, sf):
    return _clean(spark, sf).groupBy("status_code").agg(F.count(F.lit(1)).alias("n"))


@register("quality_metrics", clean_sql(
    f"SELECT count(*) AS total_rows, CAST(count_if({O.VALID}) AS BIGINT) AS valid_rows, "
    f"CAST(count_if(NOT ({O.VALID})) AS BIGINT) AS dropped_rows, "
    f"count(DISTINCT CASE WHEN {O.VALID} THEN client_ip END) AS distinct_ips FROM parsed"))
def q_quality_metrics(spark, sf):
    return cleaning.quality_counts(fixture.fixture_raw(spark, sf))


@register("alias_columns", fixture.with_log_sql(
    "SELECT event_id, response_time AS response_time_ms FROM raw", raw=True))
def q_alias_columns(spark, sf):
    return cleaning.alias_columns(fixture.fixture_raw(spark, sf)).select("event_id", "response_time_ms")


# ---- request rate ------------------------------------------------------------

def _rate_sql(seconds: int) -> str:
    return fixture.with_log_sql(
        "SELECT event_id, client_ip, \"timestamp\", CAST(count(*) OVER (PARTITION BY client_ip "
        f"ORDER BY \"timestamp\" RANGE BETWEEN INTERVAL {seconds} SECONDS PRECEDING AND CURRENT ROW) "
        "AS DOUBLE) AS request_rate FROM log")


@register("request_rate_60s", _rate_sql(60))
def q_rate_60(spark, sf):
    log = fixture.fixture_log(spark, sf).select("event_id", "client_ip", "timestamp")
    return rate.request_rate(log, 60)


@register("request_rate_1h", _rate_sql(3600))
def q_rate_1h(spark, sf):
    log = fixture.fixture_log(spark, sf).select("event_id", "client_ip", "timestamp")
    return rate.request_rate(log, 3600)


@register("request_rate_dense", _rate_sql(3600))
def q_rate_dense(spark, sf):
    """The rate by running counts over time ranges, for traffic that no bucket holds."""
    log = fixture.fixture_log(spark, sf).select("event_id", "client_ip", "timestamp")
    return rate.request_rate(log, 3600, method="dense")


# ---- ordering and split --------------------------------------------------------

from loglens.operators import ordering  # noqa: E402
from loglens.operators.boundaries import boundary_split  # noqa: E402

SPLIT_CTES = """,
numbered AS (SELECT *, row_number() OVER (ORDER BY "timestamp", event_id) - 1 AS row_idx,
                    count(*) OVER () AS n_rows FROM clean),
split AS (SELECT * EXCLUDE (n_rows),
   CASE WHEN row_idx < CAST(floor(n_rows * 0.7::DOUBLE) AS BIGINT) THEN 'train'
        WHEN row_idx < CAST(floor(n_rows * (0.7::DOUBLE + 0.15::DOUBLE)) AS BIGINT) THEN 'val'
        ELSE 'test' END AS split FROM numbered)
"""


def split_sql(body: str) -> str:
    return _CLEAN_SQL + SPLIT_CTES + body


def _split(spark, sf):
    return boundary_split(_clean(spark, sf), tiebreak=["event_id"])


@register("order_by_time", clean_sql(
    "SELECT event_id, \"timestamp\", row_number() OVER (ORDER BY \"timestamp\", event_id) - 1 AS row_idx FROM clean"))
def q_order_by_time(spark, sf):
    return ordering.with_row_index(_clean(spark, sf), ["timestamp", "event_id"]).select("event_id", "timestamp", "row_idx")


@register("chronological_split", split_sql("SELECT event_id, row_idx, split FROM split"))
def q_chronological_split(spark, sf):
    return ordering.chronological_split(_clean(spark, sf), tiebreak=["event_id"]).select("event_id", "row_idx", "split")


@register("split_by_boundary", split_sql("SELECT event_id, split FROM split"))
def q_split_by_boundary(spark, sf):
    return _split(spark, sf).select("event_id", "split")


@register("split_counts", split_sql("SELECT split, count(*) AS n FROM split GROUP BY split"))
def q_split_counts(spark, sf):
    return _split(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


# ---- fitted statistics, lookups and features -------------------------------------

from loglens.functions import features as fx  # noqa: E402
from loglens.operators import stats  # noqa: E402
from loglens.plans.feature_builder import FeatureBuilder, feature_matrix  # noqa: E402
from loglens.schema import FEATURE_COLUMNS  # noqa: E402

FIT_CTES = SPLIT_CTES + """,
train AS (SELECT * FROM split WHERE split = 'train'),
ef AS (SELECT endpoint_uri, count(*) / (SELECT count(endpoint_uri) FROM train) AS endpoint_freq
       FROM train WHERE endpoint_uri IS NOT NULL GROUP BY endpoint_uri),
ips AS (SELECT client_ip, avg(coalesce(CAST(status_code >= 400 AS INTEGER), 0)) AS ip_error_rate,
               avg(response_time_ms) AS ip_avg_latency FROM train WHERE client_ip IS NOT NULL GROUP BY client_ip),
gm AS (SELECT quantile_cont(response_time_ms, 0.5) AS global_median_latency FROM train)
"""

_RAW_FEATURES = """
SELECT s.event_id, s.split,
 ln(1 + greatest(response_time_ms, 0.0)) AS response_time_log1p,
 CAST(floor(status_code / 100) AS DOUBLE) AS status_class,
 coalesce(CAST(status_code >= 500 AS DOUBLE), 0.0) AS is_5xx,
 coalesce(CAST(status_code >= 400 AND status_code < 500 AS DOUBLE), 0.0) AS is_4xx,
 CAST(count(*) OVER (PARTITION BY s.split, s.client_ip ORDER BY s."timestamp"
      RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS DOUBLE) AS request_rate,
 sin(2 * pi() * (hour(s."timestamp") + minute(s."timestamp") / 60.0) / 24.0) AS hour_sin,
 cos(2 * pi() * (hour(s."timestamp") + minute(s."timestamp") / 60.0) / 24.0) AS hour_cos,
 sin(2 * pi() * (isodow(s."timestamp") - 1) / 7.0) AS dow_sin,
 cos(2 * pi() * (isodow(s."timestamp") - 1) / 7.0) AS dow_cos,
 coalesce(ef.endpoint_freq, 0.0) AS endpoint_freq,
 CAST(CASE http_method WHEN 'GET' THEN 0 WHEN 'POST' THEN 1 WHEN 'PUT' THEN 2 WHEN 'DELETE' THEN 3
      WHEN 'PATCH' THEN 4 WHEN 'HEAD' THEN 5 WHEN 'OPTIONS' THEN 6 ELSE -1 END AS DOUBLE) AS method_code,
 ln(1 + greatest(CAST(bytes_sent AS DOUBLE), 0.0)) AS bytes_sent_log1p,
 coalesce(ips.ip_error_rate, 0.0) AS ip_error_rate,
 coalesce(ips.ip_avg_latency, gm.global_median_latency) AS ip_avg_latency
FROM split s LEFT JOIN ef ON s.endpoint_uri = ef.endpoint_uri LEFT JOIN ips ON s.client_ip = ips.client_ip
CROSS JOIN gm
"""

_DIGITS = {c: (9 if c == "ip_avg_latency" else 6) for c in FEATURE_COLUMNS}
_IMPUTED = ",\n".join(
    f" round(coalesce(CASE WHEN isinf({c}) THEN NULL ELSE {c} END, "
    f"quantile_cont(CASE WHEN isinf({c}) THEN NULL ELSE {c} END, 0.5) OVER (PARTITION BY split)), {_DIGITS[c]}) AS {c}"
    for c in FEATURE_COLUMNS)

FEATURE_CTES = FIT_CTES + f""",
rawf AS ({_RAW_FEATURES}),
feats AS (SELECT event_id, split,
{_IMPUTED}
FROM rawf)
"""


def features_sql(body: str) -> str:
    return _CLEAN_SQL + FEATURE_CTES + body


def _fitted(spark, sf):
    # the cleaned rows are read several times: parsed once, written as a Parquet table
    split = boundary_split(materialize(_clean(spark, sf), name="clean"), tiebreak=["event_id"])
    fb = FeatureBuilder().fit(split.where(F.col("split") == "train"))
    return split, fb


def _features(spark, sf):
    split, fb = _fitted(spark, sf)
    return fb.transform(split, partition_cols=["split"], stage=lambda d: materialize(d, partition_by="split", name="features"))


@register("fit_endpoint_freq", features_sql("SELECT endpoint_uri, round(endpoint_freq, 6) AS endpoint_freq FROM ef"))
def q_fit_endpoint_freq(spark, sf):
    _, fb = _fitted(spark, sf)
    return fb.endpoint_freq.select("endpoint_uri", r6(F.col("endpoint_freq")).alias("endpoint_freq"))


@register("fit_ip_stats", features_sql(
    "SELECT client_ip, round(ip_error_rate, 6) AS ip_error_rate, round(ip_avg_latency, 9) AS ip_avg_latency FROM ips"))
def q_fit_ip_stats(spark, sf):
    _, fb = _fitted(spark, sf)
    return fb.ip_stats.select("client_ip", r6(F.col("ip_error_rate")).alias("ip_error_rate"),
                              r9(F.col("ip_avg_latency")).alias("ip_avg_latency"))


@register("fit_median", features_sql("SELECT round(global_median_latency, 6) AS global_median_latency FROM gm"))
def q_fit_median(spark, sf):
    _, fb = _fitted(spark, sf)
    return fb.median.select(r6(F.col("global_median_latency")).alias("global_median_latency"))


@register("endpoint_freq_lookup", features_sql(
    "SELECT s.event_id, s.split, round(coalesce(ef.endpoint_freq, 0.0), 6) AS endpoint_freq "
    "FROM split s LEFT JOIN ef ON s.endpoint_uri = ef.endpoint_uri"))
def q_endpoint_freq_lookup(spark, sf):
    split, fb = _fitted(spark, sf)
    out = stats.lookup_endpoint_freq(split, fb.endpoint_freq)
    return out.select("event_id", "split", r6(F.col("endpoint_freq")).alias("endpoint_freq"))


@register("ip_stats_lookup", features_sql(
    "SELECT s.event_id, s.split, round(coalesce(ips.ip_error_rate, 0.0), 6) AS ip_error_rate, "
    "round(coalesce(ips.ip_avg_latency, gm.global_median_latency), 9) AS ip_avg_latency "
    "FROM split s LEFT JOIN ips ON s.client_ip = ips.client_ip CROSS JOIN gm"))
def q_ip_stats_lookup(spark, sf):
    split, fb = _fitted(spark, sf)
    out = stats.lookup_ip_stats(split, fb.ip_stats, fb.median)
    return out.select("event_id", "split", r6(F.col("ip_error_rate")).alias("ip_error_rate"),
                      r9(F.col("ip_avg_latency")).alias("ip_avg_latency"))


@register("unseen_keys", features_sql(
    "SELECT DISTINCT 'endpoint' AS kind, s.endpoint_uri AS \"key\" FROM split s "
    "WHERE NOT EXISTS (SELECT 1 FROM ef WHERE ef.endpoint_uri = s.endpoint_uri) "
    "UNION ALL SELECT DISTINCT 'client_ip' AS kind, s.client_ip AS \"key\" FROM split s "
    "WHERE NOT EXISTS (SELECT 1 FROM ips WHERE ips.client_ip = s.client_ip)"))
def q_unseen_keys(spark, sf):
    split, fb = _fitted(spark, sf)
    return stats.unseen_keys(split, fb.endpoint_freq, fb.ip_stats)


@register("method_code", clean_sql(
    "SELECT http_method, CAST(CASE http_method WHEN 'GET' THEN 0 WHEN 'POST' THEN 1 WHEN 'PUT' THEN 2 "
    "WHEN 'DELETE' THEN 3 WHEN 'PATCH' THEN 4 WHEN 'HEAD' THEN 5 WHEN 'OPTIONS' THEN 6 ELSE -1 END AS DOUBLE) "
    "AS method_code, count(*) AS n FROM clean GROUP BY http_method"))
def q_method_code(spark, sf):
    return (_clean(spark, sf).groupBy("http_method").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("method_code", fx.method_code("http_method")))


@register("feat_logs", clean_sql(
    "SELECT event_id, round(ln(1 + greatest(response_time_ms, 0.0)), 6) AS response_time_log1p, "
    "round(ln(1 + greatest(CAST(bytes_sent AS DOUBLE), 0.0)), 6) AS bytes_sent_log1p FROM clean"))
def q_feat_logs(spark, sf):
    return _clean(spark, sf).select(
        "event_id", r6(fx.log1p_clipped("response_time_ms")).alias("response_time_log1p"),
        r6(fx.log1p_clipped("bytes_sent")).alias("bytes_sent_log1p"))


@register("feat_status", clean_sql(
    "SELECT event_id, CAST(floor(status_code / 100) AS DOUBLE) AS status_class, "
    "coalesce(CAST(status_code >= 500 AS DOUBLE), 0.0) AS is_5xx, "
    "coalesce(CAST(status_code >= 400 AND status_code < 500 AS DOUBLE), 0.0) AS is_4xx FROM clean"))
def q_feat_status(spark, sf):
    return _clean(spark, sf).select("event_id", fx.status_class("status_code").alias("status_class"),
                                    fx.is_5xx("status_code").alias("is_5xx"), fx.is_4xx("status_code").alias("is_4xx"))


@register("feat_time_cycle", clean_sql(
    "SELECT event_id, round(sin(2 * pi() * (hour(\"timestamp\") + minute(\"timestamp\") / 60.0) / 24.0), 6) AS hour_sin, "
    "round(cos(2 * pi() * (hour(\"timestamp\") + minute(\"timestamp\") / 60.0) / 24.0), 6) AS hour_cos, "
    "round(sin(2 * pi() * (isodow(\"timestamp\") - 1) / 7.0), 6) AS dow_sin, "
    "round(cos(2 * pi() * (isodow(\"timestamp\") - 1) / 7.0), 6) AS dow_cos FROM clean"))
def q_feat_time_cycle(spark, sf):
    cyc = fx.time_cycle("timestamp")
    return _clean(spark, sf).select("event_id", *[r6(cyc[c]).alias(c) for c in ("hour_sin", "hour_cos",
                                                                                  "dow_sin", "dow_cos")])


@register("feature_matrix", features_sql("SELECT * FROM feats"))
def q_feature_matrix(spark, sf):
    feats = feature_matrix(_features(spark, sf), keep=["event_id", "split"])
    return feats.select("event_id", "split", *[F.round(F.col(c), _DIGITS[c]).alias(c) for c in FEATURE_COLUMNS])


@register("impute_median", features_sql(
    "SELECT split, " + ", ".join(
        f"round(quantile_cont(CASE WHEN isinf({c}) THEN NULL ELSE {c} END, 0.5), {_DIGITS[c]}) AS med_{c}" for c in FEATURE_COLUMNS) +
    " FROM rawf GROUP BY split"))
def q_impute_median(spark, sf):
    from loglens.operators.quantiles import medians_wide

    split, fb = _fitted(spark, sf)
    raw = fb.raw_features(split, partition_cols=["split"])
    med = medians_wide(raw, FEATURE_COLUMNS, ["split"], prefix="med_")
    return med.select("split", *[F.round(F.col("med_" + c), _DIGITS[c]).alias("med_" + c) for c in FEATURE_COLUMNS])


# ---- threshold sweep and evaluation on a surrogate score --------------------------
# The forest cannot be re-run inside DuckDB, so these queries score rows with
# round(ln(1 + latency), 6); the operators under test are the same ones the
# pipeline applies to forest scores.

from loglens.operators import threshold as th  # noqa: E402

SURROGATE_CTES = """,
scored AS (SELECT event_id, split, is_anomaly, round(ln(1 + response_time_ms), 6) AS anomaly_score FROM split),
""" + (SWEEP_CTES := """val AS (SELECT * FROM scored WHERE split = 'val'),
b0 AS (SELECT quantile_cont(anomaly_score, 0.01) AS lo, quantile_cont(anomaly_score, 0.99) AS hi0 FROM val),
b AS (SELECT lo, CASE WHEN lo >= hi0 THEN lo + 1e-6 ELSE hi0 END AS hi FROM b0),
th AS (SELECT i AS step, CASE WHEN i = 199 THEN hi ELSE CAST(i AS DOUBLE) * ((hi - lo) / 199.0) + lo END AS threshold
       FROM b, range(200) t(i) WHERE lo IS NOT NULL),
cm AS (SELECT step, threshold,
        CAST(count_if(anomaly_score >= threshold AND is_anomaly = 1) AS BIGINT) AS tp,
        CAST(count_if(anomaly_score >= threshold AND is_anomaly = 0) AS BIGINT) AS fp,
        CAST(count_if(anomaly_score < threshold AND is_anomaly = 1) AS BIGINT) AS fn,
        CAST(count_if(anomaly_score < threshold AND is_anomaly = 0) AS BIGINT) AS tn
       FROM th CROSS JOIN val GROUP BY step, threshold),
sweep AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision,
        CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall,
        CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1 FROM cm),
best AS (SELECT threshold, f1 FROM sweep ORDER BY f1 DESC, step LIMIT 1),
test_flagged AS (SELECT s.event_id, s.is_anomaly, s.anomaly_score,
        CAST(s.anomaly_score >= best.threshold AS INTEGER) AS is_anomaly_pred,
        s.anomaly_score >= best.threshold AS predicted_anomaly FROM scored s CROSS JOIN best WHERE s.split = 'test'),
conf AS (SELECT CAST(count_if(is_anomaly = 1 AND is_anomaly_pred = 1) AS BIGINT) AS tp, CAST(count_if(is_anomaly <> 1 AND is_anomaly_pred <> 1) AS BIGINT) AS tn,
        CAST(count_if(is_anomaly <> 1 AND is_anomaly_pred = 1) AS BIGINT) AS fp, CAST(count_if(is_anomaly = 1 AND is_anomaly_pred <> 1) AS BIGINT) AS fn
        FROM test_flagged)
""")


def surrogate_sql(body: str) -> str:
    return _CLEAN_SQL + SPLIT_CTES + SURROGATE_CTES + body


def _surrogate_scored(spark, sf):
    return _split(spark, sf).withColumn("anomaly_score", r6(F.log1p(F.col("response_time_ms"))))


def _sweep(spark, sf):
    scored = _surrogate_scored(spark, sf)
    return scored, th.threshold_sweep(scored.where(F.col("split") == "val"))


def _test_flagged(spark, sf):
    scored, sweep = _sweep(spark, sf)
    best = th.best_threshold(sweep).select(F.col("threshold").alias("_best"))
    test = scored.where(F.col("split") == "test").crossJoin(F.broadcast(best))
    return th.flag_scores(test, F.col("_best"))


@register("score_bounds", surrogate_sql("SELECT round(lo, 6) AS lo, round(hi, 6) AS hi FROM b"))
def q_score_bounds(spark, sf):
    scored = _surrogate_scored(spark, sf).where(F.col("split") == "val")
    return th.score_bounds(scored).select(r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"))


@register("threshold_sweep", surrogate_sql(
    "SELECT step, round(threshold, 6) AS threshold, tp, fp, fn, tn, round(precision, 6) AS precision, "
    "round(recall, 6) AS recall, round(f1, 6) AS f1 FROM sweep"))
def q_threshold_sweep(spark, sf):
    _, sweep = _sweep(spark, sf)
    return sweep.select("step", r6(F.col("threshold")).alias("threshold"), "tp", "fp", "fn", "tn",
                        *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


@register("best_threshold", surrogate_sql("SELECT round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM best"))
def q_best_threshold(spark, sf):
    _, sweep = _sweep(spark, sf)
    return th.best_threshold(sweep).select(r6(F.col("threshold")).alias("threshold"), r6(F.col("f1")).alias("f1"))


@register("flag_scores", surrogate_sql(
    "SELECT event_id, anomaly_score, is_anomaly_pred, predicted_anomaly FROM test_flagged"))
def q_flag_scores(spark, sf):
    return _test_flagged(spark, sf).select("event_id", "anomaly_score", "is_anomaly_pred", "predicted_anomaly")


@register("confusion_matrix", surrogate_sql("SELECT tp, tn, fp, fn FROM conf"))
def q_confusion_matrix(spark, sf):
    return th.confusion_matrix(_test_flagged(spark, sf))


@register("eval_metrics", surrogate_sql(
    "SELECT tp + tn + fp + fn AS test_size, "
    "round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END, 6) AS precision, "
    "round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END, 6) AS recall, "
    "round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1, "
    "round(CASE WHEN tp + tn + fp + fn = 0 THEN 0.0 ELSE (tp + tn) / (tp + tn + fp + fn) END, 6) AS accuracy, "
    "round(CASE WHEN fp + tn = 0 THEN 0.0 ELSE fp / (fp + tn) END, 6) AS false_positive_rate, "
    "tp, tn, fp, fn FROM conf"))
def q_eval_metrics(spark, sf):
    m = th.eval_metrics(th.confusion_matrix(_test_flagged(spark, sf)))
    return m.select("test_size", *[r6(F.col(c)).alias(c) for c in
                                   ("precision", "recall", "f1", "accuracy", "false_positive_rate")],
                    "tp", "tn", "fp", "fn")


@register("decision_offset", surrogate_sql(
    "SELECT round(quantile_cont(anomaly_score, 0.92), 6) AS score_offset FROM scored WHERE split = 'train'"))
def q_decision_offset(spark, sf):
    from loglens.operators.quantiles import quantile_row

    train = _surrogate_scored(spark, sf).where(F.col("split") == "train")
    return quantile_row(train, "anomaly_score", [0.92], names=["score_offset"]).select(
        r6(F.col("score_offset")).alias("score_offset"))


# ---- sources and sinks ---------------------------------------------------------------

import uuid  # noqa: E402

from loglens.session import checkpoint_dir, materialize  # noqa: E402
from loglens.sources import logfiles  # noqa: E402


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location."""
    return f"{checkpoint_dir(spark).rstrip('/')}/loglens-scratch/{uuid.uuid4().hex}/{name}"


@register("scan_logs_csv", clean_sql("SELECT * FROM clean"))
def q_scan_logs_csv(spark, sf):
    path = logfiles.write_csv(fixture.fixture_raw(spark, sf), scratch_path(spark, "raw_logs.csv"))
    return logfiles.load_logs(spark, path).withColumn("event_id", F.col("event_id").cast("long"))


@register("csv_round_trip", fixture.with_log_sql(
    "SELECT event_id, \"timestamp\", client_ip, endpoint_uri, http_method, response_time_ms, status_code, "
    "bytes_sent, is_anomaly, anomaly_type FROM log"))
def q_csv_round_trip(spark, sf):
    path = logfiles.write_csv(fixture.fixture_log(spark, sf), scratch_path(spark, "logs.csv"))
    back = logfiles.load_logs(spark, path, require_labels=True)
    return back.withColumn("event_id", F.col("event_id").cast("long"))


@register("literal_log_row", clean_sql(
    "SELECT * FROM clean UNION ALL SELECT -1 AS event_id, TIMESTAMP '2024-01-15 07:00:00' AS \"timestamp\", "
    "'10.0.0.1' AS client_ip, '/api/v1/transfer/0' AS endpoint_uri, 'GET' AS http_method, "
    "100.0 AS response_time_ms, 200 AS status_code, CAST(1000 AS BIGINT) AS bytes_sent, 0 AS is_anomaly, "
    "'normal' AS anomaly_type"))
def q_literal_log_row(spark, sf):
    one = logfiles.single_record(spark, timestamp="2024-01-15T07:00:00", client_ip="10.0.0.1",
                                 endpoint_uri="/api/v1/transfer/0", http_method="GET",
                                 response_time_ms=100.0, status_code=200, bytes_sent=1000)
    one = one.withColumn("event_id", F.lit("-1"))
    batch = fixture.fixture_raw(spark, sf).withColumnRenamed("response_time", "response_time_ms") \
                   .withColumn("event_id", F.col("event_id").cast("string"))
    out = cleaning.clean_logs(batch.unionByName(one))
    return out.withColumn("event_id", F.col("event_id").cast("long"))


# ---- result views over predictions (surrogate score, val-tuned threshold) -------------

from loglens.operators import reports  # noqa: E402
from loglens.sources import history  # noqa: E402

PRED_CTES = SURROGATE_CTES + """,
preds AS (SELECT sp.*, round(ln(1 + sp.response_time_ms), 6) AS anomaly_score,
        CAST(round(ln(1 + sp.response_time_ms), 6) >= best.threshold AS INTEGER) AS is_anomaly_pred,
        round(ln(1 + sp.response_time_ms), 6) >= best.threshold AS predicted_anomaly
        FROM split sp CROSS JOIN best)
"""


def preds_sql(body: str) -> str:
    return _CLEAN_SQL + SPLIT_CTES + PRED_CTES + body


def _preds(spark, sf):
    scored, sweep = _sweep(spark, sf)
    best = th.best_threshold(sweep).select(F.col("threshold").alias("_best"))
    return th.flag_scores(scored.crossJoin(F.broadcast(best)), F.col("_best")).drop("_best")


_DISPLAY_SQL = ", ".join([
    "\"timestamp\" AS \"Requested at\"", "client_ip AS \"Client\"", "endpoint_uri AS \"Path\"", "http_method AS \"Verb\"",
    "response_time_ms AS \"Took (ms)\"", "status_code AS \"Status\"", "bytes_sent AS \"Size (bytes)\"",
    "anomaly_score AS \"Score\"",
    "CASE is_anomaly_pred WHEN 0 THEN 'no' WHEN 1 THEN 'yes' END AS \"Flagged\""])


@register("display_projection", preds_sql(f"SELECT {_DISPLAY_SQL} FROM preds"))
def q_display_projection(spark, sf):
    return reports.display_projection(_preds(spark, sf))


@register("filter_anomalous", preds_sql("SELECT event_id, anomaly_score FROM preds WHERE is_anomaly_pred = 1"))
def q_filter_anomalous(spark, sf):
    return reports.filter_predictions(_preds(spark, sf), "anomalous").select("event_id", "anomaly_score")


@register("filter_normal", preds_sql("SELECT event_id, anomaly_score FROM preds WHERE is_anomaly_pred = 0"))
def q_filter_normal(spark, sf):
    return reports.filter_predictions(_preds(spark, sf), "normal").select("event_id", "anomaly_score")


@register("preview_20", clean_sql(
    "SELECT event_id, \"timestamp\", client_ip, endpoint_uri, http_method, response_time_ms, status_code, "
    "bytes_sent FROM clean ORDER BY \"timestamp\", event_id LIMIT 20"))
def q_preview_20(spark, sf):
    return reports.preview(_clean(spark, sf), 20, order=("timestamp", "event_id")).select(
        "event_id", "timestamp", "client_ip", "endpoint_uri", "http_method", "response_time_ms",
        "status_code", "bytes_sent")


@register("result_summary", preds_sql(
    "SELECT count(*) AS total, CAST(coalesce(sum(is_anomaly_pred), 0) AS BIGINT) AS anomalies, "
    "round(100.0 * sum(is_anomaly_pred) / count(*), 6) AS anomaly_pct FROM preds"))
def q_result_summary(spark, sf):
    return reports.result_summary(_preds(spark, sf)).withColumn("anomaly_pct", r6(F.col("anomaly_pct")))


@register("status_counts", preds_sql(
    "SELECT CAST(status_code AS VARCHAR) AS status, count(*) AS n FROM preds GROUP BY 1"))
def q_status_counts(spark, sf):
    return reports.status_counts(_preds(spark, sf))


@register("label_counts", preds_sql(
    "SELECT CASE is_anomaly_pred WHEN 0 THEN 'Normal' WHEN 1 THEN 'Anomalous' END AS label, count(*) AS n "
    "FROM preds GROUP BY 1"))
def q_label_counts(spark, sf):
    return reports.label_counts(_preds(spark, sf))


@register("anomaly_share", clean_sql(
    "SELECT round(avg(CAST(is_anomaly AS DOUBLE)) * 100.0, 6) AS anomaly_pct, count(*) AS n FROM clean"))
def q_anomaly_share(spark, sf):
    return reports.anomaly_share(_clean(spark, sf)).withColumn("anomaly_pct", r6(F.col("anomaly_pct")))


@register("score_series", preds_sql("SELECT event_id, \"timestamp\", anomaly_score, row_number() OVER (ORDER BY \"timestamp\", event_id) - 1 AS position FROM preds"))
def q_score_series(spark, sf):
    return reports.score_series(_preds(spark, sf), order=("timestamp", "event_id"))


@register("latency_series", preds_sql("SELECT event_id, \"timestamp\", response_time_ms, row_number() OVER (ORDER BY \"timestamp\", event_id) - 1 AS position FROM preds"))
def q_latency_series(spark, sf):
    return reports.latency_series(_preds(spark, sf), order=("timestamp", "event_id"))


_HISTORY_SQL = """,
hist AS (SELECT row_number() OVER (ORDER BY "timestamp", client_ip, endpoint_uri, response_time_ms, status_code,
                anomaly_score, is_anomaly_pred = 1) AS id,
         "timestamp", client_ip, endpoint_uri, response_time_ms, status_code, anomaly_score,
         is_anomaly_pred = 1 AS is_anomaly FROM preds)
"""


def _saved_history(spark, sf):
    path = scratch_path(spark, "history")
    history.append_results(_preds(spark, sf), path)
    return history.read_history(spark, path)


@register("save_results_rows", preds_sql(_HISTORY_SQL + "SELECT * FROM hist"))
def q_save_results_rows(spark, sf):
    return _saved_history(spark, sf).drop("predicted_at")


@register("history_top_n", preds_sql(_HISTORY_SQL + "SELECT * FROM hist ORDER BY id DESC LIMIT 20"))
def q_history_top_n(spark, sf):
    path = scratch_path(spark, "history")
    history.append_results(_preds(spark, sf), path)
    return history.recent_results(spark, path, 20).drop("predicted_at")


@register("history_summary", preds_sql(
    _HISTORY_SQL + "SELECT count(*) AS \"rows\", CAST(count_if(is_anomaly) AS BIGINT) AS anomalies FROM "
    "(SELECT * FROM hist ORDER BY id DESC LIMIT 100)"))
def q_history_summary(spark, sf):
    path = scratch_path(spark, "history")
    history.append_results(_preds(spark, sf), path)
    return history.history_summary(history.recent_results(spark, path, 100))


@register("results_contract", preds_sql(
    "SELECT " + ", ".join(f"CAST(count_if({c} IS NULL) AS BIGINT) AS null_{c}" for c in
                          ["\"timestamp\"", "client_ip", "endpoint_uri", "response_time_ms", "status_code",
                           "anomaly_score"]).replace("null_\"timestamp\"", "null_timestamp") +
    ", CAST(count_if(is_anomaly_pred IS NULL) AS BIGINT) AS null_is_anomaly, CAST(count_if(length(client_ip) > 45) AS BIGINT) AS long_client_ip, "
    "CAST(count_if(length(endpoint_uri) > 512) AS BIGINT) AS long_endpoint_uri FROM (SELECT * REPLACE ("
    "CASE WHEN event_id % 50 = 0 THEN endpoint_uri || repeat('x', 600) ELSE endpoint_uri END AS endpoint_uri, "
    "CASE WHEN event_id % 70 = 0 THEN NULL WHEN event_id % 90 = 0 THEN repeat('1', 46) ELSE client_ip END AS client_ip, "
    "CASE WHEN event_id % 110 = 0 THEN NULL ELSE anomaly_score END AS anomaly_score) FROM preds)"))
def q_results_contract(spark, sf):
    """Violations of the table's contract; the rows that break it are planted."""
    key, none = F.col("event_id"), F.lit(None)
    broken = _preds(spark, sf).withColumns({
        "endpoint_uri": F.when(key % 50 == 0, F.concat("endpoint_uri", F.repeat(F.lit("x"), 600))).otherwise(F.col("endpoint_uri")),
        "client_ip": F.when(key % 70 == 0, none).when(key % 90 == 0, F.repeat(F.lit("1"), 46)).otherwise(F.col("client_ip")),
        "anomaly_score": F.when(key % 110 == 0, none).otherwise(F.col("anomaly_score")),
    })
    return history.contract_violations(history.history_rows(broken))


@register("csv_export", preds_sql(
    "SELECT event_id, \"timestamp\", client_ip, anomaly_score, is_anomaly_pred, predicted_anomaly FROM preds"))
def q_csv_export(spark, sf):
    cols = ["event_id", "timestamp", "client_ip", "anomaly_score", "is_anomaly_pred", "predicted_anomaly"]
    path = logfiles.write_csv(_preds(spark, sf).select(*cols), scratch_path(spark, "predictions.csv"))
    back = logfiles.read_raw_csv(spark, path)
    return back.select(F.col("event_id").cast("long"), F.col("timestamp").try_cast("timestamp_ntz"),
                       "client_ip", F.col("anomaly_score").cast("double"),
                       F.col("is_anomaly_pred").cast("int"), F.col("predicted_anomaly").cast("boolean"))


# ---- isolation forest, bundle and jobs -------------------------------------------------

from loglens.operators import forest as iforest  # noqa: E402
from loglens.plans import pipeline  # noqa: E402
from loglens.sources.bundle import load_bundle, save_bundle  # noqa: E402

_TRAINED: dict = {}


def trained(spark, sf):
    """Train once per session and data folder (the jobs below reuse the model)."""
    key = (id(spark), spark.sparkContext.applicationId, sf)
    if key not in _TRAINED:
        _TRAINED[key] = pipeline.train(spark, fixture.fixture_raw(spark, sf), tiebreak=["event_id"])
    return _TRAINED[key]


_C_SQL = ("CASE WHEN {n} <= 1 THEN 0.0 WHEN {n} = 2 THEN 1.0 ELSE "
          "2.0 * (ln({n} - 1.0) + 0.5772156649015329) - 2.0 * ({n} - 1.0) / {n} END")


@register("c_normaliser", clean_sql(
    "SELECT client_ip, count(*) AS n, round(" + _C_SQL.format(n="CAST(count(*) AS DOUBLE)") +
    ", 6) AS c_n FROM clean GROUP BY client_ip"))
def q_c_normaliser(spark, sf):
    g = _clean(spark, sf).groupBy("client_ip").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("c_n", r6(fx.average_path_length("n")))


# two hand-made trees over the real feature matrix; leaf value = depth + c(size)
FIXED_TREES = [
    # tree_id, node_id, depth, feature, threshold, left, right, size
    (0, 0, 0, 0, 3.0, 1, 2, 256), (0, 1, 1, 4, 1.5, 3, 4, 250), (0, 2, 1, -1, None, -1, -1, 6),
    (0, 3, 2, -1, None, -1, -1, 200), (0, 4, 2, -1, None, -1, -1, 50),
    (1, 0, 0, 9, 0.03, 1, 2, 256), (1, 1, 1, -1, None, -1, -1, 4), (1, 2, 1, 3, 0.5, 3, 4, 252),
    (1, 3, 2, -1, None, -1, -1, 150), (1, 4, 2, -1, None, -1, -1, 102),
]


def _leaf(depth, size):
    return f"({depth} + {_C_SQL.format(n=f'{float(size)}')})"


_FIXED_SCORE_SQL = (
    "power(2.0, -((CASE WHEN response_time_log1p <= 3.0 THEN (CASE WHEN request_rate <= 1.5 THEN "
    f"{_leaf(2, 200)} ELSE {_leaf(2, 50)} END) ELSE {_leaf(1, 6)} END) + "
    f"(CASE WHEN endpoint_freq <= 0.03 THEN {_leaf(1, 4)} ELSE (CASE WHEN is_4xx <= 0.5 THEN {_leaf(2, 150)} "
    f"ELSE {_leaf(2, 102)} END) END)) / 2.0 / ({_C_SQL.format(n='256.0')}))")


@register("fixed_forest_score", features_sql(
    f"SELECT event_id, split, round({_FIXED_SCORE_SQL}, 6) AS score FROM feats"))
def q_fixed_forest_score(spark, sf):
    import pandas as pd

    nodes = pd.DataFrame(FIXED_TREES, columns=["tree_id", "node_id", "depth", "feature", "threshold",
                                               "left", "right", "size"])
    packed = iforest.PackedForest.from_nodes(nodes, 256)
    feats = _features(spark, sf)
    # the oracle sees features rounded to 6 digits; score on the same values
    feats = feats.select("event_id", "split", *[r6(F.col(c)).alias(c) for c in FEATURE_COLUMNS])
    s = iforest.score_column(spark, packed, FEATURE_COLUMNS)
    return feats.select("event_id", "split", r6(s).alias("score"))


# The model in DuckDB: the same keyed hashes draw the same rows and make the same cuts, so samples, trees, scores and
# everything after them are compared, not only their shapes.

_SEED, _TREES, _PSI = 42, 300, 256
_FS = ", ".join(FEATURE_COLUMNS)


def _hex32(text: str, first: int = 1) -> str:
    return f"CAST('0x' || substr(md5({text}), {first}, 8) AS BIGINT)"


def _unrounded(raw: str, group: str = "") -> str:
    over = f"OVER ({group})"
    return ",\n".join(f" coalesce(CASE WHEN isinf({c}) THEN NULL ELSE {c} END, "
                      f"quantile_cont(CASE WHEN isinf({c}) THEN NULL ELSE {c} END, 0.5) {over}) AS {c}" for c in FEATURE_COLUMNS)


def _tree_ctes() -> str:
    """Unrounded features and the rows that every tree draws."""
    return f"""
featx AS MATERIALIZED (SELECT event_id, split, is_anomaly, {_unrounded("rawf", "PARTITION BY split")} FROM (SELECT r.*, s.is_anomaly FROM rawf r JOIN split s ON s.event_id = r.event_id)),
n_train AS (SELECT count(*) AS n, least({_PSI}, count(*)) AS psi FROM featx WHERE split = 'train'),
coef AS (SELECT CAST(i AS INTEGER) AS tree_id, 1 + {_hex32(f"'{_SEED}:a:' || i")} % {iforest.HASH_PRIME - 1} AS a,
         {_hex32(f"'{_SEED}:b:' || i")} % {iforest.HASH_PRIME} AS b FROM range({_TREES}) t(i)),
keyed AS (SELECT event_id, {_hex32(f"'{_SEED}:row:' || event_id")} % {iforest.HASH_PRIME} AS x FROM featx, n_train WHERE split = 'train'
          AND (n <= {iforest.POOL_FACTOR * _TREES} * psi OR {_hex32(f"'{_SEED}:row:' || event_id", 9)} <
               greatest(1, 4294967296 * {iforest.POOL_FACTOR * _TREES} * psi // n))),
sample AS MATERIALIZED (SELECT tree_id, event_id FROM (SELECT tree_id, event_id, row_number() OVER (PARTITION BY tree_id
          ORDER BY (a * x + b) % {iforest.HASH_PRIME}, event_id) AS place FROM keyed, coef), n_train WHERE place <= psi)"""


def _grow_ctes() -> str:
    """The levels of all trees, a few common table expressions each."""
    depth_limit = iforest.max_depth_for(_PSI)

    def uniform(salt: str) -> str:
        return f"({_hex32(f"'{_SEED}:{salt}:' || tree_id || ':' || node_id")} / 4294967296.0::DOUBLE)"

    fields = FEATURE_COLUMNS
    lists = ", ".join(f"[{', '.join(f'{how}(f[{i + 1}]) OVER w' for i in range(len(fields)))}] AS {name}" for how, name in (("min", "low"), ("max", "high")))
    parts = [f"tree_rows0 AS MATERIALIZED (SELECT s.tree_id, 0 AS node_id, false AS done, [{_FS}] AS f FROM sample s JOIN featx x ON x.event_id = s.event_id)"]
    for level in range(depth_limit + 1):
        varying = f"list_filter(range({len(fields)}), lambda i: high[i + 1] > low[i + 1])" if level < depth_limit else "[]::BIGINT[]"
        parts.append(f"""
tree_sizes{level} AS (SELECT *, {varying} AS varying FROM (SELECT *, count(*) OVER w AS size, {lists} FROM tree_rows{level} WINDOW w AS (PARTITION BY tree_id, node_id))),
tree_picks{level} AS (SELECT *, CASE WHEN size > 1 AND len(varying) > 0 THEN varying[CAST(floor({uniform("feature")} * len(varying)) AS BIGINT) + 1] END AS feature FROM tree_sizes{level}),
tree_cuts{level} AS MATERIALIZED (SELECT *, low[feature + 1] + {uniform("cut")} * (high[feature + 1] - low[feature + 1]) AS cut0 FROM tree_picks{level}),
tree_splits{level} AS MATERIALIZED (SELECT tree_id, node_id, done, f, size, feature, CASE WHEN cut0 >= high[feature + 1] THEN low[feature + 1] ELSE cut0 END AS cut FROM tree_cuts{level}),
tree_rows{level + 1} AS MATERIALIZED (SELECT tree_id, CASE WHEN done OR feature IS NULL THEN node_id ELSE 2 * node_id + CASE WHEN f[feature + 1] <= cut THEN 1 ELSE 2 END END AS node_id,
   done OR feature IS NULL AS done, f FROM tree_splits{level})""")
    union = " UNION ALL ".join(f"SELECT DISTINCT tree_id, node_id, {level} AS depth, coalesce(feature, -1) AS feature, cut AS threshold, size FROM tree_splits{level} WHERE NOT done"
                               for level in range(depth_limit + 1))
    parts.append(f"nodes AS MATERIALIZED ({union})")
    return ",\n".join(parts)


def _walk_ctes(name: str, source: str) -> str:
    """``name``: event_id and raw score of every row of ``source``."""
    c_size, c_psi = _C_SQL.format(n="CAST(n.size AS DOUBLE)"), _C_SQL.format(n="CAST(p.psi AS DOUBLE)")
    return f"""
{name}_f AS MATERIALIZED (SELECT event_id, [{_FS}] AS f FROM {source}),
{name}_w AS (SELECT event_id, CAST(i AS INTEGER) AS tree_id, 0 AS node_id FROM {source}, range({_TREES}) t(i)
  UNION ALL SELECT w.event_id, w.tree_id, 2 * w.node_id + CASE WHEN x.f[n.feature + 1] <= n.threshold THEN 1 ELSE 2 END
  FROM {name}_w w JOIN nodes n ON n.tree_id = w.tree_id AND n.node_id = w.node_id JOIN {name}_f x ON x.event_id = w.event_id WHERE n.feature >= 0),
{name} AS MATERIALIZED (SELECT w.event_id, power(2.0, -avg(n.depth + {c_size}) / max({c_psi})) AS s FROM {name}_w w
  JOIN nodes n ON n.tree_id = w.tree_id AND n.node_id = w.node_id AND n.feature < 0 CROSS JOIN n_train p GROUP BY w.event_id)"""


_MODEL_CTES = """,
scored AS MATERIALIZED (SELECT x.event_id, x.split, x.is_anomaly, r.s - (SELECT quantile_cont(r2.s, 1.0::DOUBLE - 0.08::DOUBLE) FROM raw_scores r2
  JOIN featx y ON y.event_id = r2.event_id WHERE y.split = 'train') AS anomaly_score FROM featx x JOIN raw_scores r ON r.event_id = x.event_id),
""" + SWEEP_CTES

# one batch of all logs, as the predict job sees them: rates and medians over the whole batch
_BATCH_CTES = (",\nrawp AS (" + _RAW_FEATURES.replace("PARTITION BY s.split, s.client_ip", "PARTITION BY s.client_ip")
               + f"),\nfeatp AS MATERIALIZED (SELECT event_id, {_unrounded('rawp')} FROM rawp)")


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def sample_sql(body: str) -> str:
    return features_sql("," + _tree_ctes() + body)


def forest_sql(body: str) -> str:
    return features_sql("," + _tree_ctes() + ",\n" + _grow_ctes() + body)


def model_sql(body: str) -> str:
    return _recursive(features_sql("," + _tree_ctes() + ",\n" + _grow_ctes() + ",\n" + _walk_ctes("raw_scores", "featx") + _MODEL_CTES + body))


def predict_sql(body: str) -> str:
    return model_sql(_BATCH_CTES + ",\n" + _walk_ctes("batch_scores", "featp") + """,
predicted AS (SELECT p.event_id, p.s - o.score_offset AS anomaly_score, p.s - o.score_offset >= best.threshold AS flag FROM batch_scores p
  CROSS JOIN best CROSS JOIN (SELECT quantile_cont(r.s, 1.0::DOUBLE - 0.08::DOUBLE) AS score_offset FROM raw_scores r JOIN featx y ON y.event_id = r.event_id
  WHERE y.split = 'train') o)
""" + body)


@register("iforest_sample", sample_sql("SELECT tree_id, event_id FROM sample"))
def q_iforest_sample(spark, sf):
    """The rows that every tree draws."""
    train = _split(spark, sf).where(F.col("split") == "train").select("event_id")
    return iforest.draw_samples(train, ["event_id"], train.count()).select("tree_id", "event_id")


@register("iforest_train", forest_sql(
    "SELECT tree_id, CAST(node_id AS INTEGER) AS node_id, CAST(depth AS INTEGER) AS depth, CAST(feature AS INTEGER) AS feature, "
    "round(threshold, 6) AS threshold, CAST(CASE WHEN feature < 0 THEN -1 ELSE 2 * node_id + 1 END AS INTEGER) AS \"left\", "
    "CAST(CASE WHEN feature < 0 THEN -1 ELSE 2 * node_id + 2 END AS INTEGER) AS \"right\", CAST(size AS BIGINT) AS size FROM nodes"))
def q_iforest_train(spark, sf):
    nodes = spark.createDataFrame(trained(spark, sf).bundle.nodes, iforest.NODE_SCHEMA)
    return nodes.withColumn("threshold", r6(F.col("threshold")))


@register("iforest_score", model_sql("SELECT event_id, split, round(anomaly_score, 6) AS anomaly_score FROM scored"))
def q_iforest_score(spark, sf):
    return trained(spark, sf).scored.select("event_id", "split", r6(F.col("anomaly_score")).alias("anomaly_score"))


_F1_SQL = "round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6)"
_SIZE_SQL = "(SELECT count(*) FROM split WHERE split = '{0}')"


@register("train_report", model_sql(
    f"SELECT round(best.threshold, 6) AS threshold, round(best.f1, 6) AS val_f1, {_F1_SQL} AS test_f1_preview, "
    f"{_SIZE_SQL.format('train')} AS train_size, {_SIZE_SQL.format('val')} AS val_size, {_SIZE_SQL.format('test')} AS test_size FROM best, conf"))
def q_train_report(spark, sf):
    rep = trained(spark, sf).report
    out = spark.createDataFrame([{k: v for k, v in rep.items() if k not in ("best_params", "output_path")}])
    return out.withColumns({c: r6(F.col(c)) for c in ("threshold", "val_f1", "test_f1_preview")})


@register("model_info", model_sql(
    "SELECT round(best.threshold, 6) AS threshold, (SELECT round(quantile_cont(r.s, 0.92::DOUBLE), 6) FROM raw_scores r JOIN featx y "
    "ON y.event_id = r.event_id WHERE y.split = 'train') AS score_offset, n_train.psi AS psi, CAST(300 AS BIGINT) AS n_estimators, 0.08::DOUBLE AS contamination, "
    "1.0::DOUBLE AS max_features, CAST(42 AS BIGINT) AS random_state, CAST(60 AS BIGINT) AS rate_window_seconds, round(best.f1, 6) AS val_f1, "
    f"{_F1_SQL} AS test_f1, '{','.join(FEATURE_COLUMNS)}' AS feature_columns FROM best, conf, n_train"))
def q_model_info(spark, sf):
    meta = trained(spark, sf).bundle.meta
    keys = ["threshold", "score_offset", "psi", "n_estimators", "contamination", "max_features",
            "random_state", "rate_window_seconds", "val_f1", "test_f1", "feature_columns"]
    out = spark.createDataFrame([{k: meta[k] for k in keys}])
    return out.withColumns({**{c: r6(F.col(c)) for c in ("threshold", "score_offset", "val_f1", "test_f1")},
                            "feature_columns": F.array_join("feature_columns", ",")})


@register("predict_logs", predict_sql(
    "SELECT c.*, round(p.anomaly_score, 6) AS anomaly_score, CAST(p.flag AS INTEGER) AS is_anomaly_pred, p.flag AS predicted_anomaly "
    "FROM clean c JOIN predicted p ON p.event_id = c.event_id"))
def q_predict_logs(spark, sf):
    res = trained(spark, sf)
    out = pipeline.predict(spark, fixture.fixture_raw(spark, sf), res.bundle)
    return out.withColumn("anomaly_score", r6(F.col("anomaly_score")))


@register("evaluate_pipeline", model_sql(
    "SELECT tp + tn + fp + fn AS test_size, round(best.threshold, 6) AS threshold, "
    "round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END, 6) AS precision, "
    "round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END, 6) AS recall, " + _F1_SQL + " AS f1, "
    "round(CASE WHEN tp + tn + fp + fn = 0 THEN 0.0 ELSE (tp + tn) / (tp + tn + fp + fn) END, 6) AS accuracy, "
    "round(CASE WHEN fp + tn = 0 THEN 0.0 ELSE fp / (fp + tn) END, 6) AS false_positive_rate, tp, tn, fp, fn, "
    "'metrics on the labelled test period only' AS note FROM conf, best"))
def q_evaluate_pipeline(spark, sf):
    res = trained(spark, sf)
    out = pipeline.evaluate(spark, fixture.fixture_raw(spark, sf), res.bundle, tiebreak=["event_id"])
    return out.withColumns({c: r6(F.col(c)) for c in ("threshold", "precision", "recall", "f1", "accuracy", "false_positive_rate")})


@register("bundle_round_trip", predict_sql(
    "SELECT event_id, round(anomaly_score, 6) AS anomaly_score, CAST(flag AS INTEGER) AS is_anomaly_pred FROM predicted"))
def q_bundle_round_trip(spark, sf):
    """Predictions of the saved and restored model."""
    path = scratch_path(spark, "bundle")
    save_bundle(spark, trained(spark, sf).bundle, path)
    out = pipeline.predict(spark, fixture.fixture_raw(spark, sf), load_bundle(spark, path))
    return out.select("event_id", r6(F.col("anomaly_score")).alias("anomaly_score"), "is_anomaly_pred")


# ---- streaming: files arriving in a folder, scored batch by batch ---------------

from loglens.streaming.micro_batch import start_scoring  # noqa: E402

_STREAM_COLS = ["timestamp", "client_ip", "endpoint_uri", "response_time_ms", "status_code"]


@register("stream_history", clean_sql(
    "SELECT \"timestamp\", client_ip, endpoint_uri, response_time_ms, status_code FROM clean"))
def q_stream_history(spark, sf):
    """Two CSV drops scored as two micro-batches; the history must hold every clean row."""
    bundle = trained(spark, sf).bundle
    raw = fixture.fixture_raw(spark, sf).withColumnRenamed("response_time", "response_time_ms")
    cols = ["timestamp", "client_ip", "endpoint_uri", "http_method", "response_time_ms", "status_code",
            "bytes_sent", "is_anomaly", "anomaly_type"]
    src = scratch_path(spark, "incoming.csv")
    half = F.col("event_id") % 2 == 0
    logfiles.write_csv(raw.where(half).select(*cols), src, mode="append")
    logfiles.write_csv(raw.where(~half).select(*cols), src, mode="append")
    hist_path = scratch_path(spark, "stream_history")
    q = start_scoring(spark, src, bundle, scratch_path(spark, "stream_ckpt"), history_path=hist_path,
                      available_now=True)
    try:
        q.awaitTermination()  # availableNow ends by itself, after any number of rows
    finally:
        if q.isActive:
            q.stop()
    return history.read_history(spark, hist_path).select(*_STREAM_COLS)
