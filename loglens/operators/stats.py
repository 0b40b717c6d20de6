"""Statistics learned from the training period and the lookups that use them.

All statistics stay DataFrames: the endpoint and client tables grow with the
data (client IPs are unbounded), so they are joined, never collected into a
driver dict.  Joins are left equi-joins; adaptive execution broadcasts a side
only after measuring it at run time and otherwise keeps a shuffle join (with
skew splitting for a hot client).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.operators.quantiles import quantile_row


def fit_endpoint_freq(train: DataFrame, endpoint_col: str = "endpoint_uri") -> DataFrame:
    """endpoint -> share of non-null endpoint values (normalised value counts)."""
    counts = train.where(F.col(endpoint_col).isNotNull()).groupBy(endpoint_col).agg(F.count(F.lit(1)).alias("_n"))
    total = train.agg(F.count(endpoint_col).alias("_total"))
    return (counts.crossJoin(F.broadcast(total))
                  .select(endpoint_col, (F.col("_n") / F.col("_total")).alias("endpoint_freq")))


def fit_ip_stats(train: DataFrame, ip_col: str = "client_ip") -> DataFrame:
    """client -> share of 4xx/5xx responses, mean latency (null latency skipped)."""
    is_error = F.coalesce((F.col("status_code") >= 400).cast("int"), F.lit(0))
    return (train.where(F.col(ip_col).isNotNull())
                 .groupBy(ip_col)
                 .agg(F.avg(is_error).alias("ip_error_rate"),
                      F.avg("response_time_ms").alias("ip_avg_latency")))


def fit_median_latency(train: DataFrame) -> DataFrame:
    """One row: exact median of latency (linear interpolation)."""
    return quantile_row(train, "response_time_ms", [0.5], names=["global_median_latency"])


def lookup_endpoint_freq(df: DataFrame, endpoint_freq: DataFrame, endpoint_col: str = "endpoint_uri") -> DataFrame:
    """Unseen endpoints get 0.0."""
    return (df.join(endpoint_freq.withColumnRenamed("endpoint_freq", "_ef"), endpoint_col, "left")
              .withColumn("endpoint_freq", F.coalesce(F.col("_ef"), F.lit(0.0))).drop("_ef"))


def lookup_ip_stats(df: DataFrame, ip_stats: DataFrame, median: DataFrame, ip_col: str = "client_ip") -> DataFrame:
    """Unseen clients: error rate 0.0, mean latency = training median."""
    stats = ip_stats.select(ip_col, F.col("ip_error_rate").alias("_er"), F.col("ip_avg_latency").alias("_al"))
    med = median.select(F.col("global_median_latency").alias("_gm"))
    return (df.join(stats, ip_col, "left")
              .crossJoin(F.broadcast(med))
              .withColumn("ip_error_rate", F.coalesce(F.col("_er"), F.lit(0.0)))
              .withColumn("ip_avg_latency", F.coalesce(F.col("_al"), F.col("_gm")))
              .drop("_er", "_al", "_gm"))


def unseen_keys(df: DataFrame, endpoint_freq: DataFrame, ip_stats: DataFrame) -> DataFrame:
    """Rows whose endpoint or client is missing from the learned tables."""
    ep = df.select("endpoint_uri").distinct().join(endpoint_freq, "endpoint_uri", "left_anti") \
           .select(F.lit("endpoint").alias("kind"), F.col("endpoint_uri").alias("key"))
    ip = df.select("client_ip").distinct().join(ip_stats, "client_ip", "left_anti") \
           .select(F.lit("client_ip").alias("kind"), F.col("client_ip").alias("key"))
    return ep.unionByName(ip)
