import pytest
from pyspark.sql import functions as F

from loglens.plans import pipeline
from loglens.sources import fixture, history
from loglens.sources.bundle import load_bundle, save_bundle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def trained(spark):
    return pipeline.train(spark, fixture.fixture_raw(spark, SF), tiebreak=["event_id"], n_estimators=60)


def test_train_report(trained):
    rep = trained.report
    assert rep["train_size"] + rep["val_size"] + rep["test_size"] > 0
    assert rep["train_size"] == int((rep["train_size"] + rep["val_size"] + rep["test_size"]) * 0.7)
    assert 0.0 <= rep["val_f1"] <= 1.0 and 0.0 <= rep["test_f1_preview"] <= 1.0
    assert len(trained.bundle.nodes.tree_id.unique()) == 60


def test_predict_fifty_rows(spark, trained):
    batch = fixture.fixture_log(spark, SF).orderBy("event_id").limit(50)
    out = pipeline.predict(spark, batch, trained.bundle)
    assert out.count() == 50
    assert {"anomaly_score", "is_anomaly_pred", "predicted_anomaly"} <= set(out.columns)
    assert out.where(F.col("anomaly_score").isNull()).count() == 0
    flipped = pipeline.predict(spark, batch, trained.bundle, threshold=-10.0)
    assert flipped.where(F.col("is_anomaly_pred") == 1).count() == 50


def test_bundle_round_trip_and_evaluate(spark, trained, scratch):
    path = save_bundle(spark, trained.bundle, f"{scratch}/bundle")
    loaded = load_bundle(spark, path)
    assert loaded.threshold == trained.bundle.threshold and loaded.feature_columns == trained.bundle.feature_columns
    raw = fixture.fixture_raw(spark, SF)
    a = pipeline.predict(spark, raw, trained.bundle).select("event_id", F.col("anomaly_score").alias("a"))
    b = pipeline.predict(spark, raw, loaded).select("event_id", F.col("anomaly_score").alias("b"))
    assert a.join(b, "event_id").where(F.abs(F.col("a") - F.col("b")) > 1e-12).count() == 0
    m = pipeline.evaluate(spark, raw, loaded, tiebreak=["event_id"]).first()
    assert m.test_size == trained.report["test_size"]
    with pytest.raises(FileNotFoundError):
        load_bundle(spark, f"{scratch}/nowhere")


def test_history_append_and_newest_first(spark, trained, scratch):
    path = f"{scratch}/history"
    preds = pipeline.predict(spark, fixture.fixture_raw(spark, SF), trained.bundle)
    n1 = history.append_results(preds.limit(30), path)
    n2 = history.append_results(preds.limit(20), path)
    table = history.read_history(spark, path)
    ids = sorted(r.id for r in table.select("id").collect())
    assert (n1, n2) == (30, 20) and ids == list(range(1, 51))
    top = history.recent_results(spark, path, 5).collect()
    assert [r.id for r in top] == [50, 49, 48, 47, 46]
    assert history.contract_violations(history.history_rows(preds)).first().asDict() == \
        {k: 0 for k in history.contract_violations(history.history_rows(preds)).columns}


def test_entry_contract(spark):
    import __spark_entry__ as E

    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 50
    df = E.entry(spark)
    assert {"anomaly_score", "is_anomaly_pred"} <= set(df.columns) and df.count() > 0


def test_single_hand_entered_record(spark, trained):
    from loglens.sources.logfiles import single_record

    one = single_record(spark, timestamp="2024-01-15T07:00:00", client_ip="10.0.0.1",
                        endpoint_uri="/api/v1/transfer/0", http_method="GET", response_time_ms=100.0,
                        status_code=200, bytes_sent=1000)
    r = pipeline.predict(spark, one, trained.bundle).collect()
    assert len(r) == 1 and r[0].anomaly_score is not None and r[0].is_anomaly_pred in (0, 1)


def test_tiny_training_set(spark):
    raw = fixture.fixture_raw(spark, SF).orderBy("event_id").limit(12)
    res = pipeline.train(spark, raw, tiebreak=["event_id"], n_estimators=5)
    rep = res.report
    n = rep["train_size"] + rep["val_size"] + rep["test_size"]
    assert rep["train_size"] == int(n * 0.7) and res.bundle.meta["psi"] == rep["train_size"]
    assert pipeline.predict(spark, raw, res.bundle).count() == n


def _counted(spark, monkeypatch):
    """The raw log of the registered queries, and a counter of the rows that are read from it."""
    seen = spark.sparkContext.accumulator(0)
    whole = fixture.fixture_raw

    def look(value):
        seen.add(1)
        return value

    monkeypatch.setattr(fixture, "fixture_raw", lambda spark, sf: whole(spark, sf).withColumn(
        "response_time", F.udf(look, "string")("response_time")))
    return seen, whole(spark, SF).count()


@pytest.mark.parametrize("name", ["iforest_train", "predict_logs", "bundle_round_trip", "evaluate_pipeline", "feature_matrix"])
def test_raw_logs_are_parsed_once(spark, monkeypatch, name):
    from loglens.plans import catalog

    if name == "iforest_train":
        monkeypatch.setattr(catalog, "_TRAINED", {})
    else:
        catalog.trained(spark, SF)
    seen, n = _counted(spark, monkeypatch)
    assert catalog.QUERIES[name](spark, SF).count() > 0
    assert seen.value == n
