"""Log views over the driver's ``events`` table.

``events`` (event_id, ts, user_id, event_type, value, props) is turned into an
HTTP access log with labels, and into a "dirty" all-text variant that exercises
every cleaning rule.  Each view exists twice: as a DataFrame built with Spark
column expressions, and as SQL text that DuckDB runs for the oracle check.
Both forms must stay row-for-row identical.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.session import spread


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def log_view(events: DataFrame) -> DataFrame:
    """Typed, labelled access log (already clean) over ``events``."""
    return (events.withColumn("k", F.expr("CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"))
                  .selectExpr(
        "event_id",
        "ts AS timestamp",
        "concat('10.0.', CAST(CAST(floor(user_id / 256) AS INT) AS STRING), '.', "
        "CAST(user_id % 256 AS STRING)) AS client_ip",
        "concat('/api/v1/', event_type, '/', CAST(k % 5 AS STRING)) AS endpoint_uri",
        "CASE WHEN k % 17 = 0 THEN 'TRACE' WHEN event_type = 'signup' THEN 'PUT' "
        "WHEN event_type IN ('purchase', 'error') THEN 'POST' ELSE 'GET' END AS http_method",
        "CASE WHEN event_type = 'error' AND k % 4 = 0 THEN value * 40 ELSE value END AS response_time_ms",
        "CAST(CASE WHEN event_type = 'error' AND k % 4 = 0 THEN 503 WHEN event_type = 'error' AND k % 4 = 1 "
        "THEN 429 WHEN k % 10 = 0 THEN 404 ELSE 200 END AS INT) AS status_code",
        "CAST(120 + k * 37 AS BIGINT) AS bytes_sent",
        "CAST(CASE WHEN event_type = 'error' AND k % 4 <= 1 THEN 1 ELSE 0 END AS INT) AS is_anomaly",
        "CASE WHEN event_type = 'error' AND k % 4 = 0 THEN 'high_latency' "
        "WHEN event_type = 'error' AND k % 4 = 1 THEN 'spam' ELSE 'normal' END AS anomaly_type",
    ))


def raw_view(log: DataFrame) -> DataFrame:
    """All-text log with invalid values planted by ``event_id`` residues."""
    return log.selectExpr(
        "event_id",
        "CASE WHEN event_id % 101 = 0 THEN 'not-a-time' WHEN event_id % 103 = 0 THEN CAST(NULL AS STRING) "
        "WHEN event_id % 163 = 0 THEN replace(substr(CAST(timestamp AS STRING), 1, 10), '-', '') "
        "WHEN event_id % 167 = 0 THEN replace(replace(replace(substr(CAST(timestamp AS STRING), 1, 16), '-', ''), ':', ''), ' ', 'T') "
        "WHEN event_id % 173 = 0 THEN replace(replace(replace(CAST(timestamp AS STRING), '-', ''), ':', ''), ' ', 'T') "
        "ELSE replace(CAST(timestamp AS STRING), ' ', 'T') END AS timestamp",
        "CASE WHEN event_id % 7 = 0 THEN concat('  ', client_ip, ' ') ELSE client_ip END AS client_ip",
        "CASE WHEN event_id % 179 = 0 THEN concat(endpoint_uri, '?q=\"x\",y') "
        "WHEN event_id % 181 = 0 THEN concat(endpoint_uri, chr(10), 'z') "
        "WHEN event_id % 191 = 0 THEN concat(endpoint_uri, chr(92), '\"') ELSE endpoint_uri END AS endpoint_uri",
        "CASE WHEN event_id % 3 = 0 THEN concat(' ', lower(http_method)) ELSE http_method END AS http_method",
        "CASE WHEN event_id % 107 = 0 THEN 'abc' WHEN event_id % 109 = 0 THEN '12d' "
        "WHEN event_id % 113 = 0 THEN 'NaN' WHEN event_id % 211 = 0 THEN 'inf' WHEN event_id % 11 = 0 THEN '-5' "
        "ELSE CAST(response_time_ms AS STRING) END AS response_time",
        "CASE WHEN event_id % 127 = 0 THEN '600' WHEN event_id % 131 = 0 THEN '99' "
        "WHEN event_id % 137 = 0 THEN '' WHEN event_id % 139 = 0 THEN '200.7' "
        "ELSE CAST(status_code AS STRING) END AS status_code",
        "CASE WHEN event_id % 149 = 0 THEN CAST(NULL AS STRING) WHEN event_id % 193 = 0 THEN '9223372036854775807' "
        "WHEN event_id % 197 = 0 THEN '9007199254740993' WHEN event_id % 199 = 0 THEN '9223372036854775808' "
        "ELSE CAST(bytes_sent AS STRING) END AS bytes_sent",
        "CASE WHEN event_id % 151 = 0 THEN CAST(NULL AS STRING) WHEN event_id % 5 = 1 AND is_anomaly = 1 THEN 'True' "
        "WHEN event_id % 5 = 1 THEN 'FALSE' ELSE CAST(is_anomaly AS STRING) END AS is_anomaly",
        "CASE WHEN event_id % 157 = 0 THEN CAST(NULL AS STRING) ELSE anomaly_type END AS anomaly_type",
    )


def fixture_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_view(read_table(spark, sf_dir, "events"))


def fixture_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_view(fixture_log(spark, sf_dir))


# ---- the same views as DuckDB SQL (used inside oracle queries) -------------

LOG_SQL = """
SELECT event_id, ts AS "timestamp",
 concat('10.0.', CAST(CAST(floor(user_id/256) AS INT) AS VARCHAR), '.', CAST(user_id % 256 AS VARCHAR)) AS client_ip,
 concat('/api/v1/', event_type, '/', CAST(k % 5 AS VARCHAR)) AS endpoint_uri,
 CASE WHEN k % 17 = 0 THEN 'TRACE' WHEN event_type='signup' THEN 'PUT'
      WHEN event_type IN ('purchase','error') THEN 'POST' ELSE 'GET' END AS http_method,
 CASE WHEN event_type='error' AND k % 4 = 0 THEN value*40 ELSE value END AS response_time_ms,
 CAST(CASE WHEN event_type='error' AND k % 4 = 0 THEN 503 WHEN event_type='error' AND k % 4 = 1 THEN 429
      WHEN k % 10 = 0 THEN 404 ELSE 200 END AS INTEGER) AS status_code,
 CAST(120 + k*37 AS BIGINT) AS bytes_sent,
 CAST(CASE WHEN event_type='error' AND k % 4 <= 1 THEN 1 ELSE 0 END AS INTEGER) AS is_anomaly,
 CASE WHEN event_type='error' AND k % 4 = 0 THEN 'high_latency'
      WHEN event_type='error' AND k % 4 = 1 THEN 'spam' ELSE 'normal' END AS anomaly_type
FROM (SELECT *, CAST(regexp_extract(props,'([0-9]+)',1) AS INTEGER) AS k FROM events)
"""

RAW_SQL = """
SELECT event_id,
 CASE WHEN event_id % 101 = 0 THEN 'not-a-time' WHEN event_id % 103 = 0 THEN NULL
      WHEN event_id % 163 = 0 THEN replace(substr(CAST("timestamp" AS VARCHAR),1,10),'-','')
      WHEN event_id % 167 = 0 THEN replace(replace(replace(substr(CAST("timestamp" AS VARCHAR),1,16),'-',''),':',''),' ','T')
      WHEN event_id % 173 = 0 THEN replace(replace(replace(CAST("timestamp" AS VARCHAR),'-',''),':',''),' ','T')
      ELSE replace(CAST("timestamp" AS VARCHAR),' ','T') END AS "timestamp",
 CASE WHEN event_id % 7 = 0 THEN concat('  ', client_ip, ' ') ELSE client_ip END AS client_ip,
 CASE WHEN event_id % 179 = 0 THEN concat(endpoint_uri, '?q="x",y') WHEN event_id % 181 = 0 THEN concat(endpoint_uri, chr(10), 'z')
      WHEN event_id % 191 = 0 THEN concat(endpoint_uri, chr(92), '"') ELSE endpoint_uri END AS endpoint_uri,
 CASE WHEN event_id % 3 = 0 THEN concat(' ', lower(http_method)) ELSE http_method END AS http_method,
 CASE WHEN event_id % 107 = 0 THEN 'abc' WHEN event_id % 109 = 0 THEN '12d' WHEN event_id % 113 = 0 THEN 'NaN'
      WHEN event_id % 211 = 0 THEN 'inf' WHEN event_id % 11 = 0 THEN '-5' ELSE CAST(response_time_ms AS VARCHAR) END AS response_time,
 CASE WHEN event_id % 127 = 0 THEN '600' WHEN event_id % 131 = 0 THEN '99' WHEN event_id % 137 = 0 THEN ''
      WHEN event_id % 139 = 0 THEN '200.7' ELSE CAST(status_code AS VARCHAR) END AS status_code,
 CASE WHEN event_id % 149 = 0 THEN NULL WHEN event_id % 193 = 0 THEN '9223372036854775807'
      WHEN event_id % 197 = 0 THEN '9007199254740993' WHEN event_id % 199 = 0 THEN '9223372036854775808'
      ELSE CAST(bytes_sent AS VARCHAR) END AS bytes_sent,
 CASE WHEN event_id % 151 = 0 THEN NULL WHEN event_id % 5 = 1 AND is_anomaly = 1 THEN 'True'
      WHEN event_id % 5 = 1 THEN 'FALSE' ELSE CAST(is_anomaly AS VARCHAR) END AS is_anomaly,
 CASE WHEN event_id % 157 = 0 THEN NULL ELSE anomaly_type END AS anomaly_type
FROM log
"""


def with_log_sql(body: str, raw: bool = False, extra_ctes: str = "") -> str:
    """Prefix an oracle query with the log (optionally raw, and more) CTEs.

    ``extra_ctes`` is appended to the WITH list as is (``name AS (...), ...``).
    """
    ctes = [f"log AS ({LOG_SQL})"]
    if raw:
        ctes.append(f"raw AS ({RAW_SQL})")
    if extra_ctes:
        ctes.append(extra_ctes)
    return "WITH " + ",\n".join(ctes) + "\n" + body
