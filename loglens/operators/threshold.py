"""F1-optimal threshold search, flagging and evaluation metrics.

The sweep is one pass over the scored rows: the candidate thresholds are
``linspace(p1, p99, n)`` (exact distributed quantiles); each row is bucketed
by how many thresholds lie at or below its score (arithmetic guess, then one
exact comparison each way against the literal threshold array), the rows
collapse to at most ``n + 1`` bucket counts, and the confusion counts at
threshold ``i`` are suffix sums over those buckets.  No per-threshold jobs
and no ``n x rows`` cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T

from loglens.operators.quantiles import quantile_values
from loglens.schema import THRESHOLD_STEPS


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


SWEEP_SCHEMA = T.StructType([
    T.StructField("step", T.LongType()), T.StructField("threshold", T.DoubleType()),
    T.StructField("tp", T.LongType()), T.StructField("fp", T.LongType()),
    T.StructField("fn", T.LongType()), T.StructField("tn", T.LongType()),
    T.StructField("precision", T.DoubleType()), T.StructField("recall", T.DoubleType()),
    T.StructField("f1", T.DoubleType()),
])


def bounds(scored: DataFrame, score_col: str = "anomaly_score") -> tuple[float, float] | None:
    """(p1, p99) of the scores, hi = lo + 1e-6 when lo >= hi; None without scores."""
    vals = quantile_values(scored, [score_col], [0.01, 0.99]).get((score_col,))
    if not vals:
        return None
    lo, hi = vals[0.01], vals[0.99]
    return (lo, lo + 1e-6) if lo >= hi else (lo, hi)


def score_bounds(scored: DataFrame, score_col: str = "anomaly_score") -> DataFrame:
    """One row: ``lo`` = p1, ``hi`` = p99 (nulls without scores)."""
    b = bounds(scored, score_col)
    schema = T.StructType([T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())])
    return scored.sparkSession.createDataFrame([b or (None, None)], schema)


def candidate_thresholds(lo: float, hi: float, n_steps: int = THRESHOLD_STEPS) -> list[float]:
    """``linspace(lo, hi, n)``: ``i * step + lo``, the last one exactly ``hi``."""
    step = (hi - lo) / (n_steps - 1)
    return [i * step + lo for i in range(n_steps - 1)] + [hi]


def _ratio_py(num: int, den: int) -> float:
    return 0.0 if den == 0 else num / den


def threshold_sweep(scored: DataFrame, score_col: str = "anomaly_score", label_col: str = "is_anomaly",
                    n_steps: int = THRESHOLD_STEPS, bounds_: tuple[float, float] | None = None) -> DataFrame:
    """``n_steps`` rows: step, threshold, tp, fp, fn, tn, precision, recall, f1.

    Predicted positive means ``score >= threshold``.  No rows -> empty table.
    ``bounds_`` passes (p1, p99) already computed by the caller.
    """
    spark = scored.sparkSession
    b = bounds(scored, score_col) if bounds_ is None else bounds_
    if b is None:
        return spark.createDataFrame([], SWEEP_SCHEMA)
    lo, hi = b
    if lo >= hi:
        hi = lo + 1e-6
    ths = candidate_thresholds(lo, hi, n_steps)
    step = (hi - lo) / (n_steps - 1)
    arr = F.array(*[F.lit(t) for t in ths])
    s = F.col(score_col)
    # held inside the steps before it becomes a whole number: scores may be infinite
    place = F.least(F.greatest((s - F.lit(lo)) / F.lit(step), F.lit(-1.0)), F.lit(float(n_steps)))
    guess = F.least(F.floor(place).cast("int") + 1, F.lit(n_steps))
    k0 = F.col("_k0")
    # exact correction: k = number of thresholds <= s
    down = F.when((k0 > 0) & (F.element_at(arr, F.greatest(k0, F.lit(1))) > s), k0 - 1).otherwise(k0)
    up = F.when((k0 < n_steps) & (F.element_at(arr, F.least(k0 + 1, F.lit(n_steps))) <= s), k0 + 1).otherwise(k0)
    hist = (scored.select(s.alias("_s"), (F.col(label_col) == 1).cast("int").alias("_y"))
                  .where(F.col("_s").isNotNull() & ~F.isnan("_s"))
                  .withColumnRenamed("_s", score_col)
                  .withColumn("_k0", guess).withColumn("_k0", down).withColumn("_k0", up)
                  .groupBy("_k0").agg(F.sum("_y").alias("pos"), F.count(F.lit(1)).alias("cnt"))
                  .collect())
    pos = [0] * (n_steps + 1)
    neg = [0] * (n_steps + 1)
    for r in hist:  # at most n_steps + 1 buckets
        pos[r["_k0"]] += int(r["pos"] or 0)
        neg[r["_k0"]] += int(r["cnt"]) - int(r["pos"] or 0)
    P, N = sum(pos), sum(neg)
    rows, tp, fp = [], 0, 0
    above = []
    for i in range(n_steps, 0, -1):  # tp(i) = positives in buckets > i
        tp += pos[i]
        fp += neg[i]
        above.append((tp, fp))
    above.reverse()  # above[i] = counts in buckets i+1 .. n_steps
    for i, t in enumerate(ths):
        tp_i, fp_i = above[i]
        fn_i, tn_i = P - tp_i, N - fp_i
        rows.append((i, t, tp_i, fp_i, fn_i, tn_i, _ratio_py(tp_i, tp_i + fp_i), _ratio_py(tp_i, tp_i + fn_i),
                     _ratio_py(2 * tp_i, 2 * tp_i + fp_i + fn_i)))
    return spark.createDataFrame(rows, SWEEP_SCHEMA)


def best_threshold(sweep: DataFrame) -> DataFrame:
    """One row (threshold, f1): highest F1, lowest threshold among ties; (0, 0) if empty."""
    spark = sweep.sparkSession
    top = sweep.orderBy(F.desc("f1"), F.asc("step")).limit(1).select("threshold", "f1")
    return (spark.range(1).join(top, how="left")
                 .select(F.coalesce(F.col("threshold"), F.lit(0.0)).alias("threshold"),
                         F.coalesce(F.col("f1"), F.lit(0.0)).alias("f1")))


def flag_scores(scored: DataFrame, threshold: float | Column, score_col: str = "anomaly_score") -> DataFrame:
    """Add ``is_anomaly_pred`` (0/1) and ``predicted_anomaly`` (bool): score >= threshold."""
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    flag = F.col(score_col) >= thr
    return scored.withColumns({"is_anomaly_pred": flag.cast("int"), "predicted_anomaly": flag})


def confusion_matrix(df: DataFrame, label_col: str = "is_anomaly", pred_col: str = "is_anomaly_pred") -> DataFrame:
    y, p = F.col(label_col) == 1, F.col(pred_col) == 1
    return df.agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & ~p).alias("tn"),
        F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"))


def eval_metrics(confusion: DataFrame) -> DataFrame:
    """Precision, recall, F1, accuracy, false-positive rate; 0 on a zero denominator."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return confusion.select(
        (tp + tn + fp + fn).alias("test_size"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        _ratio(fp, fp + tn).alias("false_positive_rate"),
        "tp", "tn", "fp", "fn")
