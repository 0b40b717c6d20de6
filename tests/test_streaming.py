from pyspark.sql import functions as F

from loglens.operators.cleaning import clean_logs
from loglens.plans import pipeline
from loglens.sources import fixture, history, logfiles
from loglens.streaming.micro_batch import start_scoring

SF = "/root/testdata/sf0.001"


def test_stream_scores_each_file_and_appends_history(spark, scratch):
    res = pipeline.train(spark, fixture.fixture_raw(spark, SF), tiebreak=["event_id"], n_estimators=20)
    raw = fixture.fixture_raw(spark, SF).withColumnRenamed("response_time", "response_time_ms")
    cols = ["timestamp", "client_ip", "endpoint_uri", "http_method", "response_time_ms", "status_code",
            "bytes_sent", "is_anomaly", "anomaly_type"]
    src = f"{scratch}/incoming"
    logfiles.write_csv(raw.where(F.col("event_id") < 500).select(*cols).coalesce(1), f"{src}/a.csv", mode="append")
    logfiles.write_csv(raw.where(F.col("event_id") >= 500).select(*cols).coalesce(1), f"{src}/a.csv", mode="append")
    q = start_scoring(spark, f"{src}/a.csv", res.bundle, f"{scratch}/ckpt", predictions_dir=f"{scratch}/preds",
                      history_path=f"{scratch}/history", available_now=True, max_files_per_trigger=1)
    q.awaitTermination(300)
    expected = clean_logs(raw).count()
    hist = history.read_history(spark, f"{scratch}/history")
    assert hist.count() == expected
    assert sorted(r.id for r in hist.select("id").collect()) == list(range(1, expected + 1))
    assert spark.read.parquet(f"{scratch}/preds").select("batch_id").distinct().count() == 2


def test_registered_stream_has_no_clock(spark, monkeypatch):
    """A stream slower than any limit: a wait with a limit comes back unfinished."""
    from loglens.plans import catalog

    start = catalog.start_scoring

    class Slow:
        def __init__(self, query):
            self.query = query

        def awaitTermination(self, timeout=None):
            return self.query.awaitTermination() if timeout is None else False

        def __getattr__(self, name):
            return getattr(self.query, name)

    monkeypatch.setattr(catalog, "start_scoring", lambda *a, **k: Slow(start(*a, **k)))
    assert catalog.q_stream_history(spark, SF).count() > 0
