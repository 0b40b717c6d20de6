"""Exact quantiles (linear interpolation) computed as a distributed job.

Spark's exact ``percentile`` merges every distinct value into one buffer in a
single task; that does not survive billions of distinct values, and sorting them
moves all of them.  Here ranks are selected by refinement:

1. the wanted columns are written once as a narrow table;
2. one aggregate gives count and range per (group, column), and so the ranks that are wanted;
3. each round counts the values inside the wanted intervals by ``BINS`` equal bins (map-side partial counts, so
   the shuffle holds at most one row per task, interval and bin) and keeps the bin that holds the rank, with its own
   least and greatest value, until bins are one value or hold at most ``FEW`` rows together;
4. the distinct values of such bins are counted and picked.

The number of groups and columns bounds what the driver sees, never the number of values.  Hot values are
one bin entry.  Infinite values lie before and after all others; NaN and null values are ignored; a key with no
values yields null.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglens.session import materialize

#: Bins of a round, and the rows of all wanted bins that are few enough to count their values one by one.
BINS = 512
FEW = 100_000


def lerp(lo: float, hi: float, frac: float) -> float:
    """numpy's ``linear`` interpolation between two order statistics."""
    return _lerp(lo, hi, frac)


def _lerp(lo: float, hi: float, frac: float) -> float:
    if frac >= 0.5:
        return hi - (hi - lo) * (1.0 - frac)
    return lo + (hi - lo) * frac


def quantile_values(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                    group_cols: Sequence[str] = (), num_partitions: int | None = None) -> dict:
    """``{(group values..., column): {prob: value}}`` for every group with values."""
    stats = order_statistics(df, columns, probs, group_cols, num_partitions)
    return {key: {p: _lerp(*t) for p, t in d.items()} for key, d in stats.items()}


def order_statistics(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                     group_cols: Sequence[str] = (), num_partitions: int | None = None) -> dict:
    """``{key: {prob: (value at floor rank, value at ceil rank, fraction)}}``.

    ``num_partitions`` is no longer used: nothing is dealt by ranges.

    A monotone map of the column (e.g. subtracting a constant) maps these
    order statistics one to one, so callers can interpolate on mapped values.
    """
    spark = df.sparkSession
    g = list(group_cols)
    keys = g + ["column"]
    narrow = materialize(df.select(*g, *[F.col(c).cast("double").alias(f"_q{i}") for i, c in enumerate(columns)]), name="quantile-columns")
    names = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_q{i}").alias("v")) for i, c in enumerate(columns)])
    rows = (narrow.select(*g, F.explode(names).alias("_q")).select(*g, "_q.column", F.col("_q.v").alias("v"))
            .where(F.col("v").isNotNull() & ~F.isnan("v")))
    finite = F.when(F.abs("v") < float("inf"), F.col("v"))
    seen = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(finite).alias("low"), F.max(finite).alias("high"), F.count(finite).alias("inside"),
                                   F.count_if(F.col("v") == float("-inf")).alias("least")).collect()

    plan = {}  # key -> [(prob, position, rank below, rank above)]
    open_: dict = {}  # (key, rank) -> (low, high, rows below, rows inside)
    value_at: dict = {}
    for r in seen:
        key = tuple(r[k] for k in keys)
        plan[key] = []
        for p in probs:
            pos = float(p) * float(r["n"] - 1)
            ranks = int(math.floor(pos)), int(math.ceil(pos))
            plan[key].append((float(p), pos, *ranks))
            for rank in ranks:
                if rank < r["least"]:
                    value_at[key, rank] = float("-inf")
                elif rank >= r["least"] + r["inside"]:
                    value_at[key, rank] = float("inf")
                else:
                    open_[key, rank] = (r["low"], r["high"], r["least"], r["inside"])

    kinds = [narrow.schema[c].dataType for c in g]
    while open_:
        for target, (low, high, _, _) in list(open_.items()):
            if low == high:
                value_at[target] = low
                del open_[target]
        if not open_:
            break
        few = sum(n for *_, n in open_.values()) <= FEW
        ids = list(open_)
        fields = [T.StructField(f"_k{i}", kind) for i, kind in enumerate(kinds)] + [
            T.StructField("_kc", T.StringType()), T.StructField("t", T.IntegerType()), T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]
        wanted = spark.createDataFrame([(*key, i, *open_[key, rank][:2]) for i, (key, rank) in enumerate(ids)], T.StructType(fields))
        match = F.col("_kc") == F.col("column")
        for i, c in enumerate(g):
            match = match & F.col(c).eqNullSafe(F.col(f"_k{i}"))
        # two rows per group, column and probability at most
        met = rows.join(F.broadcast(wanted), match & F.col("v").between(F.col("low"), F.col("high")))
        if few:
            bin_ = F.col("v")
        else:  # halves keep the span of two doubles from overflowing
            share = F.try_divide(F.col("v") / 2 - F.col("low") / 2, F.col("high") / 2 - F.col("low") / 2)
            bin_ = F.coalesce(F.floor(share * BINS).cast("double"), F.col("v"))  # a span too small to halve holds few values
        counts = met.groupBy("t", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        by_target = defaultdict(list)
        for r in counts:
            by_target[r["t"]].append(r)
        for i, target in enumerate(ids):
            below = open_[target][2]
            for r in sorted(by_target[i], key=lambda r: r["low"]):
                if target[1] < below + r["n"]:
                    open_[target] = (r["low"], r["high"], below, r["n"])
                    break
                below += r["n"]
    out = {}
    for key, items in plan.items():
        out[key] = {p: (value_at[(key, lo)], value_at[(key, hi)], pos - lo) for p, pos, lo, hi in items}
    return out


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                    group_cols: Sequence[str] = (), num_partitions: int | None = None) -> DataFrame:
    """Long result: ``group_cols..., column, prob, value`` (computed now, tiny)."""
    vals = quantile_values(df, columns, probs, group_cols, num_partitions)
    fields = [T.StructField(g, df.schema[g].dataType) for g in group_cols] + [
        T.StructField("column", T.StringType()), T.StructField("prob", T.DoubleType()),
        T.StructField("value", T.DoubleType())]
    rows = [(*key, float(p), v) for key, d in vals.items() for p, v in d.items()]
    return df.sparkSession.createDataFrame(rows, T.StructType(fields))


def quantile_row(df: DataFrame, column: str, probs: Sequence[float], group_cols: Sequence[str] = (),
                 names: Sequence[str] | None = None) -> DataFrame:
    """Wide form for one column: ``group_cols..., <name per prob>`` (one row if ungrouped)."""
    names = list(names or [f"q{p}" for p in probs])
    vals = quantile_values(df, [column], probs, group_cols)
    fields = [T.StructField(g, df.schema[g].dataType) for g in group_cols] + [
        T.StructField(n, T.DoubleType()) for n in names]
    if group_cols:
        rows = [(*key[:-1], *[d[float(p)] for p in probs]) for key, d in vals.items()]
    else:
        d = vals.get((column,), {})
        rows = [tuple(d.get(float(p)) for p in probs)]
    return df.sparkSession.createDataFrame(rows, T.StructType(fields))


def medians_wide(df: DataFrame, columns: Sequence[str], group_cols: Sequence[str] = (),
                 prefix: str = "_med_") -> DataFrame:
    vals = quantile_values(df, columns, [0.5], group_cols)
    groups = sorted({key[:-1] for key in vals}, key=repr) if group_cols else [()]
    fields = [T.StructField(g, df.schema[g].dataType) for g in group_cols] + [
        T.StructField(prefix + c, T.DoubleType()) for c in columns]
    rows = [(*grp, *[vals.get((*grp, c), {}).get(0.5) for c in columns]) for grp in groups]
    return df.sparkSession.createDataFrame(rows, T.StructType(fields))
