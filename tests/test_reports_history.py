import datetime as dt

import pytest
from pyspark.sql import functions as F

from loglens.operators import reports
from loglens.plans.feature_builder import impute_with_medians
from loglens.sources import history

PRED_SCHEMA = ("timestamp timestamp_ntz, client_ip string, endpoint_uri string, http_method string, "
               "response_time_ms double, status_code int, bytes_sent long, anomaly_score double, "
               "is_anomaly_pred int")


def preds(spark):
    t = dt.datetime(2026, 1, 5, 7)
    rows = [(t + dt.timedelta(seconds=i), f"10.0.0.{i % 3}", "/a", "GET", 10.0 * i, s, 100, 0.1 * i, p)
            for i, (s, p) in enumerate([(200, 0), (404, 1), (503, 1), (200, 0), (99, 0)])]
    return spark.createDataFrame(rows, PRED_SCHEMA)


def test_all_null_column_stays_null_and_groups_use_own_median(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("a", None, None), ("a", None, 3.0), ("b", None, None),
                                ("b", None, 10.0)], "g string, x double, y double")
    out = {(r.g, r.y) for r in impute_with_medians(df, ["x", "y"], ["g"]).collect()}
    assert out == {("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 10.0)}
    assert impute_with_medians(df, ["x"]).where(F.col("x").isNotNull()).count() == 0


def test_display_projection_and_filters(spark):
    p = preds(spark)
    shown = reports.display_projection(p.drop("bytes_sent"))
    assert shown.columns == ["Requested at", "Client", "Path", "Verb", "Took (ms)", "Status",
                             "Score", "Flagged"]
    assert sorted(r["Flagged"] for r in shown.collect()) == ["no", "no", "no", "yes", "yes"]
    assert reports.filter_predictions(p, "anomalous").count() == 2
    assert reports.filter_predictions(p, "normal").count() == 3
    with pytest.raises(ValueError):
        reports.filter_predictions(p, "odd")


def test_summaries(spark):
    p = preds(spark)
    r = reports.result_summary(p).first()
    assert (r.total, r.anomalies, r.anomaly_pct) == (5, 2, 40.0)
    assert reports.result_summary(p.limit(0)).first().anomaly_pct is None
    assert [tuple(x) for x in reports.status_counts(p).collect()] == [("200", 2), ("404", 1), ("503", 1), ("99", 1)]
    assert [tuple(x) for x in reports.label_counts(p).collect()] == [("Normal", 3), ("Anomalous", 2)]
    assert [r.status_code for r in reports.preview(p, 2).collect()] == [200, 404]


def test_contract_rejects_bad_rows(spark, scratch):
    p = preds(spark).withColumn("client_ip", F.when(F.col("status_code") == 99, F.lit("x" * 46))
                                .otherwise(F.col("client_ip")))
    v = history.contract_violations(history.history_rows(p)).first()
    assert v.long_client_ip == 1 and v.null_timestamp == 0
    with pytest.raises(Exception, match="contract"):
        history.append_results(p, f"{scratch}/h")


def test_recent_results_reaches_into_older_partitions(spark, scratch):
    path = f"{scratch}/hist"
    old = (history.history_rows(preds(spark)).limit(4)
           .withColumn("id", F.monotonically_increasing_id() + 1)
           .withColumn("predicted_at", F.lit("2020-01-01 00:00:00").cast("timestamp"))
           .withColumn("predicted_date", F.lit("2020-01-01").cast("date")))
    old.select(*history.HISTORY_COLUMNS, "predicted_date").write.partitionBy("predicted_date").parquet(path)
    assert history.append_results(preds(spark).limit(2), path) == 2
    top = history.recent_results(spark, path, 3).collect()
    assert len(top) == 3
    assert top[0].predicted_at > top[2].predicted_at  # two new rows, then the newest old one
    assert [r.id for r in top][:2] == sorted([r.id for r in top][:2], reverse=True)
    assert min(r.id for r in top[:2]) > max(r.id for r in old.collect())


def test_history_under_changing_zones(spark, scratch):
    path, before = f"{scratch}/zones", spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ["Pacific/Kiritimati", "Pacific/Pago_Pago", "Pacific/Pago_Pago"]:
            spark.conf.set("spark.sql.session.timeZone", zone)
            history.append_results(preds(spark).limit(3), path)
        ids = [r.id for r in history.read_history(spark, path).collect()]
        assert sorted(ids) == list(range(1, 10))
        assert [r.id for r in history.recent_results(spark, path, 2).collect()] == [9, 8]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_empty_append(spark, scratch):
    path = f"{scratch}/none"
    assert history.append_results(preds(spark).limit(0), path) == 0
    assert history.recent_results(spark, path).count() == 0
    assert history.append_results(preds(spark).limit(1), path) == 1
    assert [r.id for r in history.recent_results(spark, path).collect()] == [1]
