"""Model bundle: a directory of Parquet tables (no pickled objects).

    <dir>/endpoint_freq/   endpoint_uri, endpoint_freq
    <dir>/ip_stats/        client_ip, ip_error_rate, ip_avg_latency
    <dir>/nodes/           tree_id, node_id, depth, feature, threshold, left, right, size
    <dir>/meta/            one row: threshold, score_offset, parameters, metrics, ...
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.operators.forest import NODE_SCHEMA, PackedForest
from loglens.plans.feature_builder import FeatureBuilder
from loglens.session import path_exists

TABLES = ("endpoint_freq", "ip_stats", "nodes", "meta")


@dataclass
class Bundle:
    features: FeatureBuilder
    nodes: pd.DataFrame            # bounded: n_trees x (2 psi - 1) rows
    meta: dict[str, Any] = field(default_factory=dict)
    _cache: dict = field(default_factory=dict, repr=False, compare=False)

    @property
    def threshold(self) -> float:
        return float(self.meta["threshold"])

    @property
    def score_offset(self) -> float:
        return float(self.meta["score_offset"])

    @property
    def feature_columns(self) -> list[str]:
        return list(self.meta["feature_columns"])

    def packed(self) -> PackedForest:
        return PackedForest.from_nodes(self.nodes, int(self.meta["psi"]))

    def broadcast_forest(self, spark: SparkSession):
        """(packed forest, its broadcast), created once per application."""
        app = spark.sparkContext.applicationId
        cached = self._cache.get(app)
        if cached is None:
            packed = self.packed()
            cached = (packed, spark.sparkContext.broadcast(packed))
            self._cache[app] = cached
        return cached


def _meta_frame(spark: SparkSession, meta: dict[str, Any]) -> DataFrame:
    row = {k: (json.dumps(v) if isinstance(v, dict) else v) for k, v in meta.items()}
    return spark.createDataFrame([row])


def save_bundle(spark: SparkSession, bundle: Bundle, path: str) -> str:
    """Write all tables; each write is one atomic Spark job commit."""
    fb = bundle.features
    fb.endpoint_freq.write.mode("overwrite").parquet(os.path.join(path, "endpoint_freq"))
    fb.ip_stats.write.mode("overwrite").parquet(os.path.join(path, "ip_stats"))
    spark.createDataFrame(bundle.nodes, NODE_SCHEMA).coalesce(1).write.mode("overwrite") \
         .parquet(os.path.join(path, "nodes"))
    _meta_frame(spark, bundle.meta).coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "meta"))
    return path


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    if not path:
        raise FileNotFoundError("no model bundle path given; train one first")
    if not all(path_exists(spark, os.path.join(path, t)) for t in TABLES):
        raise FileNotFoundError(f"no model bundle at {path!r}; train one first")
    meta_row = spark.read.parquet(os.path.join(path, "meta")).first().asDict(recursive=True)
    meta = {k: (json.loads(v) if k == "best_params" and isinstance(v, str) else v) for k, v in meta_row.items()}
    fb = FeatureBuilder(rate_window_seconds=int(meta["rate_window_seconds"]))
    fb.endpoint_freq = spark.read.parquet(os.path.join(path, "endpoint_freq"))
    fb.ip_stats = spark.read.parquet(os.path.join(path, "ip_stats"))
    fb.median = spark.range(1).select(F.lit(meta["global_median_latency"]).cast("double")
                                      .alias("global_median_latency"))
    nodes = spark.read.parquet(os.path.join(path, "nodes")).toPandas()
    return Bundle(features=fb, nodes=nodes, meta=meta)
