"""Train, predict and evaluate jobs.

train:    clean -> split (selected boundary keys) -> fit stats on train ->
          features per split (rates and medians never cross splits) ->
          sample by keyed hash -> grow all trees level by level -> score all splits ->
          offset from train scores -> F1 sweep on val -> test F1 -> bundle
predict:  clean -> restored stats -> features -> score -> flag
evaluate: clean -> split -> test part -> features -> score -> flag -> metrics
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

import pyspark
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.operators import forest as iforest
from loglens.operators import threshold as th
from loglens.operators.cleaning import alias_columns, clean_logs, validate_log_schema
from loglens.operators.boundaries import boundary_split
from loglens.operators.quantiles import lerp, order_statistics
from loglens.plans.feature_builder import FeatureBuilder
from loglens.schema import (
    CONTAMINATION,
    FEATURE_COLUMNS,
    MAX_SAMPLES,
    N_ESTIMATORS,
    RANDOM_STATE,
    RATE_WINDOW_SECONDS,
    THRESHOLD_STEPS,
    TRAIN_RATIO,
    VAL_RATIO,
)
from loglens.session import materialize, release_persisted, spread
from loglens.sources.bundle import Bundle, save_bundle


@dataclass
class TrainResult:
    bundle: Bundle
    report: dict[str, Any]
    scored: DataFrame  # every row of the split table with features and anomaly_score


def score_features(spark: SparkSession, features: DataFrame, bundle: Bundle) -> DataFrame:
    packed, bc = bundle.broadcast_forest(spark)
    s = iforest.score_column(spark, packed, bundle.feature_columns, bc)
    # scoring is CPU-bound Python: make sure every task slot takes part
    return spread(features).withColumn("anomaly_score", s - F.lit(bundle.score_offset))


def _stage_clean(df: DataFrame) -> DataFrame:
    """Cleaned logs are read several times: the text is parsed once and written as a Parquet table."""
    return materialize(df, name="clean")


def _stage_features(df: DataFrame) -> DataFrame:
    return materialize(df, name="features")


def train(spark: SparkSession, logs: DataFrame, out_dir: str | None = None,
          tiebreak: Sequence[str] | None = None, n_estimators: int = N_ESTIMATORS,
          contamination: float = CONTAMINATION, max_samples: int = MAX_SAMPLES,
          seed: int = RANDOM_STATE, rate_window_seconds: int = RATE_WINDOW_SECONDS,
          train_ratio: float = TRAIN_RATIO, val_ratio: float = VAL_RATIO,
          n_steps: int = THRESHOLD_STEPS) -> TrainResult:
    logs = alias_columns(logs)
    validate_log_schema(logs, require_labels=True)
    clean = _stage_clean(clean_logs(logs))
    order = list(tiebreak) if tiebreak is not None else [c for c in clean.columns if c != "timestamp"]
    split = boundary_split(clean, tiebreak=order, train_ratio=train_ratio, val_ratio=val_ratio)
    sizes = {r["split"]: r["n"] for r in split.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_train = int(sizes.get("train", 0))
    if n_train == 0:
        raise ValueError("no training rows after cleaning")

    is_train = F.col("split") == "train"
    fb = FeatureBuilder(rate_window_seconds=rate_window_seconds).fit(split.where(is_train))
    fb.endpoint_freq = fb.endpoint_freq.persist(StorageLevel.MEMORY_AND_DISK)
    fb.ip_stats = fb.ip_stats.persist(StorageLevel.MEMORY_AND_DISK)
    median = fb.median.first()["global_median_latency"]
    fb.median = spark.range(1).select(F.lit(median).cast("double").alias("global_median_latency"))
    feats = fb.transform(split, partition_cols=["split"],
                         stage=lambda d: materialize(d, partition_by="split", name="features"))

    psi = min(max_samples, n_train)
    # what tells rows apart: the tie-break names them, or else their place in the written features
    trained_on = feats.where(is_train)
    keys = ["timestamp", *order]
    if tiebreak is None:
        trained_on, keys = trained_on.withColumn("_place", F.monotonically_increasing_id()), ["_place"]
    samples = iforest.draw_samples(trained_on.select(*dict.fromkeys(keys), *FEATURE_COLUMNS), order if tiebreak is not None else keys,
                                   n_train, n_estimators, max_samples, seed)
    nodes = iforest.grow_forest(samples, FEATURE_COLUMNS, psi, seed).toPandas()

    meta: dict[str, Any] = {
        "threshold": 0.0, "score_offset": 0.0, "psi": psi, "n_estimators": n_estimators,
        "contamination": float(contamination), "max_features": 1.0, "random_state": seed,
        "rate_window_seconds": rate_window_seconds, "global_median_latency": median,
        "feature_columns": list(FEATURE_COLUMNS), "fitted": True,
    }
    bundle = Bundle(features=fb, nodes=nodes, meta=meta)
    packed, bc = bundle.broadcast_forest(spark)
    raw = iforest.score_column(spark, packed, FEATURE_COLUMNS, bc)
    # scoring is CPU-bound Python: make sure every task slot takes part; what the sweep needs is written once, narrow
    rated = spread(feats).withColumn("_s", raw)
    scores = materialize(rated.select("split", "is_anomaly", "_s"), name="scores")
    # one exact-quantile pass: the contamination cut on train, the sweep bounds on val
    q_off = 1.0 - contamination
    qs = order_statistics(scores.where(F.col("split").isin("train", "val")), ["_s"], [0.01, q_off, 0.99], ["split"])
    offset = float(lerp(*qs[("train", "_s")][q_off]))
    meta["score_offset"] = offset
    scored, scores = (df.withColumn("anomaly_score", F.col("_s") - F.lit(offset)).drop("_s") for df in (rated, scores))
    val_q = qs.get(("val", "_s"))
    # p1/p99 of the anomaly scores: order statistics of s shifted, then interpolated
    val_bounds = None
    if val_q:
        val_bounds = tuple(lerp(lo - offset, hi - offset, frac) for lo, hi, frac in (val_q[0.01], val_q[0.99]))

    sweep = th.threshold_sweep(scores.where(F.col("split") == "val"), n_steps=n_steps, bounds_=val_bounds)
    best = th.best_threshold(sweep).first()
    threshold, val_f1 = float(best["threshold"]), float(best["f1"])
    test = th.flag_scores(scores.where(F.col("split") == "test"), threshold)
    test_m = th.eval_metrics(th.confusion_matrix(test)).first()
    meta.update({
        "threshold": threshold, "val_f1": val_f1, "test_f1": float(test_m["f1"]),
        "best_params": {"n_estimators": n_estimators, "contamination": float(contamination), "max_features": 1.0},
        "trained_at": dt.datetime.now(dt.timezone.utc).isoformat(), "engine_version": pyspark.__version__,
        "default_n_estimators": N_ESTIMATORS, "default_contamination": CONTAMINATION,
    })
    if out_dir:
        save_bundle(spark, bundle, out_dir)
    # intermediate frames are no longer needed: clean rows and features are checkpointed
    # (scores are one vectorised UDF over the checkpointed features)
    release_persisted()
    report = {
        "output_path": out_dir, "best_params": meta["best_params"], "threshold": threshold,
        "val_f1": val_f1, "test_f1_preview": float(test_m["f1"]),
        "train_size": n_train, "val_size": int(sizes.get("val", 0)), "test_size": int(sizes.get("test", 0)),
    }
    return TrainResult(bundle=bundle, report=report, scored=scored)


def predict(spark: SparkSession, logs: DataFrame, bundle: Bundle, threshold: float | None = None, stage=None) -> DataFrame:
    """Cleaned log + anomaly_score, is_anomaly_pred (0/1), predicted_anomaly (bool).

    ``stage`` turns the cleaned rows and the raw features into frames that can be read more than once (default:
    Parquet tables; a stream of small batches passes ``persist_for_reuse``).
    """
    clean = (stage or _stage_clean)(clean_logs(logs))
    feats = bundle.features.transform(clean, stage=stage or _stage_features)
    scored = score_features(spark, feats, bundle)
    thr = bundle.threshold if threshold is None else float(threshold)
    out = th.flag_scores(scored, thr)
    return out.select(*clean.columns, "anomaly_score", "is_anomaly_pred", "predicted_anomaly")


def evaluate(spark: SparkSession, logs: DataFrame, bundle: Bundle, tiebreak: Sequence[str] | None = None,
             train_ratio: float = TRAIN_RATIO, val_ratio: float = VAL_RATIO) -> DataFrame:
    """One row: test_size, threshold, precision, recall, f1, accuracy, false_positive_rate, tp, tn, fp, fn."""
    logs = alias_columns(logs)
    validate_log_schema(logs, require_labels=True)
    clean = _stage_clean(clean_logs(logs))
    order = list(tiebreak) if tiebreak is not None else [c for c in clean.columns if c != "timestamp"]
    test = boundary_split(clean, tiebreak=order, train_ratio=train_ratio, val_ratio=val_ratio) \
        .where(F.col("split") == "test")
    feats = bundle.features.transform(test, stage=_stage_features)
    flagged = th.flag_scores(score_features(spark, feats, bundle), bundle.threshold)
    m = th.eval_metrics(th.confusion_matrix(flagged))
    return m.select("test_size", F.lit(bundle.threshold).alias("threshold"), "precision", "recall", "f1",
                    "accuracy", "false_positive_rate", "tp", "tn", "fp", "fn",
                    F.lit("metrics on the labelled test period only").alias("note"))
