"""Detection history: append scored logs, read the newest rows back.

Default store is a Parquet table (one folder; each append is one atomic job
commit).  Ids are assigned by the store: ``max(id) + 1 + position`` where the
position is the distributed row index of the batch in time order.  All rows
of one append share one ``predicted_at`` (a single ``current_timestamp()``).
The table is partitioned by the UTC date of ``predicted_at``, so reads with a date
filter prune old partitions.

A JDBC variant writes the batch to a staging table first and moves it into
the target with one ``INSERT ... SELECT`` so a failed job leaves the target
untouched (Spark's JDBC writer commits per partition).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loglens.operators.ordering import with_row_index
from loglens.session import materialize, path_exists
from loglens.schema import HISTORY_COLUMNS, HISTORY_DEFAULT_LIMIT, HISTORY_ENDPOINT_MAX_LEN, HISTORY_IP_MAX_LEN, HISTORY_SCHEMA

_FIELDS = ["timestamp", "client_ip", "endpoint_uri", "response_time_ms", "status_code", "anomaly_score"]


def history_rows(results: DataFrame) -> DataFrame:
    """Prediction rows in the history layout (without id)."""
    return results.select(
        F.col("timestamp").cast("timestamp_ntz").alias("timestamp"),
        F.col("client_ip").cast("string").alias("client_ip"),
        F.col("endpoint_uri").cast("string").alias("endpoint_uri"),
        F.col("response_time_ms").cast("double").alias("response_time_ms"),
        F.col("status_code").cast("int").alias("status_code"),
        F.col("anomaly_score").cast("double").alias("anomaly_score"),
        (F.col("is_anomaly_pred") == 1).alias("is_anomaly"),
    )


def contract_violations(rows: DataFrame) -> DataFrame:
    """One row of counts: nulls per NOT NULL column and over-long text."""
    cols = _FIELDS + ["is_anomaly"]
    return rows.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in cols],
        F.count_if(F.length("client_ip") > HISTORY_IP_MAX_LEN).alias("long_client_ip"),
        F.count_if(F.length("endpoint_uri") > HISTORY_ENDPOINT_MAX_LEN).alias("long_endpoint_uri"),
    )


def _enforce_contract(rows: DataFrame) -> DataFrame:
    ok = F.lit(True)
    for c in _FIELDS + ["is_anomaly"]:
        ok = ok & F.col(c).isNotNull()
    ok = ok & (F.length("client_ip") <= HISTORY_IP_MAX_LEN) & (F.length("endpoint_uri") <= HISTORY_ENDPOINT_MAX_LEN)
    # a filter (not a dropped column) so the optimizer cannot prune the check away
    return rows.where(F.assert_true(ok, "history row violates the table contract").isNull())


def _existing_max_id(spark: SparkSession, path: str) -> int:
    """Largest id so far, from the ids themselves (a scan of that one column)."""
    if not path_exists(spark, path):
        return 0
    return int(read_history(spark, path).agg(F.max("id").alias("m")).first()["m"] or 0)


def append_results(results: DataFrame, path: str, order: Sequence[str] | None = None) -> int:
    """Append prediction rows to the Parquet history at ``path``; returns the row count.

    Appends are expected to be serialised by the caller (one writer at a time),
    as ids continue from the current maximum.
    """
    spark = results.sparkSession
    rows = _enforce_contract(history_rows(results))
    order = list(order or ["timestamp", "client_ip", "endpoint_uri", "response_time_ms",
                           "status_code", "anomaly_score", "is_anomaly"])
    start = _existing_max_id(spark, path) + 1
    # predictions come out of shuffles: the tagged rows are written, so offsets and rows agree after a lost block
    numbered = with_row_index(rows, order, "_pos", stage=materialize)
    out = (numbered.withColumn("id", F.col("_pos") + F.lit(start))
                   .withColumn("predicted_at", F.current_timestamp())
                   .withColumn("predicted_date", F.expr("date_from_unix_date(CAST(floor(unix_seconds(predicted_at) / 86400) AS INT))"))
                   .select(*HISTORY_COLUMNS, "predicted_date"))
    # the row count is observed while the rows are written (no second pass)
    seen = Observation("history_append")
    out.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("append") \
       .partitionBy("predicted_date").parquet(path)
    return int(seen.get["rows"])


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY_SCHEMA).parquet(path).select(*HISTORY_COLUMNS)


def recent_results(spark: SparkSession, path: str, limit: int = HISTORY_DEFAULT_LIMIT) -> DataFrame:
    """Newest first (predicted_at, then id), at most ``limit`` rows.

    The time of the ``limit``-th newest row comes from the ``predicted_at`` column alone (one value per append, so it
    is stored as runs); the rows are then read from that time on, which row-group statistics prune, and a top-n
    orders them.  No folder name is trusted, so the result holds under any session zone or clock.
    """
    table = read_history(spark, path)
    oldest = (table.select("predicted_at").orderBy(F.desc("predicted_at")).limit(limit)
              .agg(F.min("predicted_at").alias("t")))
    # the instant travels as a number of microseconds: a Python datetime would depend on the driver's zone
    since = oldest.select(F.unix_micros("t").alias("t")).first()["t"]
    if since is None:
        return table.limit(0)
    newest = table.where(F.col("predicted_at") >= F.timestamp_micros(F.lit(since)))
    return newest.orderBy(F.desc("predicted_at"), F.desc("id")).limit(limit)


def history_summary(history: DataFrame) -> DataFrame:
    return history.agg(F.count(F.lit(1)).alias("rows"),
                       F.count_if(F.col("is_anomaly")).alias("anomalies"))


# ---- JDBC store --------------------------------------------------------------

def append_results_jdbc(results: DataFrame, url: str, table: str = "detection_results",
                        properties: dict[str, str] | None = None) -> int:
    """All-or-nothing append through a staging table and one INSERT ... SELECT.

    The target table owns id assignment and the default ``predicted_at``.
    """
    spark = results.sparkSession
    props = dict(properties or {})
    rows = _enforce_contract(history_rows(results)).withColumn("predicted_at", F.current_timestamp())
    staging = f"{table}_staging_{spark.sparkContext.applicationId.replace('-', '_')}"
    rows.write.mode("overwrite").jdbc(url, staging, properties=props)
    cols = ", ".join(_FIELDS + ["is_anomaly", "predicted_at"])
    jvm = spark.sparkContext._jvm
    conn = jvm.java.sql.DriverManager.getConnection(url, props.get("user"), props.get("password"))
    try:
        conn.setAutoCommit(False)
        stmt = conn.createStatement()
        n = stmt.executeUpdate(f"INSERT INTO {table} ({cols}) SELECT {cols} FROM {staging}")
        stmt.executeUpdate(f"DROP TABLE {staging}")
        conn.commit()
    except Exception:
        conn.rollback()
        raise
    finally:
        conn.close()
    return int(n)


def recent_results_jdbc(spark: SparkSession, url: str, limit: int = HISTORY_DEFAULT_LIMIT,
                        table: str = "detection_results", properties: dict[str, str] | None = None) -> DataFrame:
    """Newest-first read with the top-n done by the database (``query`` option)."""
    query = (f"SELECT {', '.join(HISTORY_COLUMNS)} FROM {table} "
             f"ORDER BY predicted_at DESC, id DESC FETCH FIRST {int(limit)} ROWS ONLY")
    reader = spark.read.format("jdbc").option("url", url).option("query", query)
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    return reader.load()
