"""Score log files as they arrive (Structured Streaming, ``foreachBatch``).

Each micro-batch is treated exactly like one uploaded batch: it is cleaned,
featurised with the bundle's statistics (the request rate only sees rows of
the same batch, as for an upload), scored, flagged, and appended to the
detection history.  Predictions are written before the history append, so a
failing history store never loses results.

Re-runs of a batch after a failure are skipped with a marker written once the
batch's history append has committed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from loglens.plans import pipeline
from loglens.schema import RAW_LOG_SCHEMA
from loglens.session import path_exists, persist_for_reuse, release_persisted
from loglens.sources import history
from loglens.sources.bundle import Bundle
from loglens.sources.logfiles import CSV_DIALECT, blank_tokens


def _touch(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True).close()


def read_log_stream(spark: SparkSession, source_dir: str, schema: T.StructType = RAW_LOG_SCHEMA,
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """CSV files (with header) arriving in ``source_dir``; all columns text, in the dialect and with the
    missing-value tokens of the batch reader."""
    reader = spark.readStream.schema(schema).options(**CSV_DIALECT, multiLine=True, enforceSchema=False)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return blank_tokens(reader.csv(source_dir))


def score_batch(batch: DataFrame, batch_id: int, bundle: Bundle, predictions_dir: str | None,
                history_path: str | None, marker_dir: str, threshold: float | None = None) -> None:
    spark = batch.sparkSession
    marker = f"{marker_dir.rstrip('/')}/{batch_id}"
    if path_exists(spark, marker):
        return
    preds = pipeline.predict(spark, batch, bundle, threshold, stage=persist_for_reuse)
    if predictions_dir:
        preds.write.mode("overwrite").parquet(f"{predictions_dir.rstrip('/')}/batch_id={batch_id}")
        preds = spark.read.parquet(f"{predictions_dir.rstrip('/')}/batch_id={batch_id}")
    if history_path:
        history.append_results(preds, history_path)
    _touch(spark, marker)
    release_persisted()  # frames cached for this batch only


def start_scoring(spark: SparkSession, source_dir: str, bundle: Bundle, checkpoint_location: str,
                  predictions_dir: str | None = None, history_path: str | None = None,
                  threshold: float | None = None, available_now: bool = False,
                  processing_time: str | None = None, max_files_per_trigger: int | None = None):
    """Start the stream; returns the StreamingQuery."""
    stream = read_log_stream(spark, source_dir, max_files_per_trigger=max_files_per_trigger)
    marker_dir = f"{checkpoint_location.rstrip('/')}/_scored_batches"
    writer = (stream.writeStream
                    .option("checkpointLocation", checkpoint_location)
                    .foreachBatch(lambda df, bid: score_batch(df, bid, bundle, predictions_dir, history_path,
                                                              marker_dir, threshold)))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
