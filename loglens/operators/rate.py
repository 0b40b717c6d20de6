"""Per-client trailing request count (``request_rate``).

For every row: the number of rows of the same client whose timestamp lies in
``[t - w, t]`` (both ends inclusive, ties included).  Rows with a null
timestamp or client get 0.  ``partition_cols`` keeps independent frames apart
(e.g. train/validation/test are rated separately).

The rate depends on ``(client, timestamp)`` only, so it is computed on the
*key table*: distinct ``(partition_cols, client, timestamp)`` with a
multiplicity ``n`` (copies of a row collapse in the map-side partial
aggregate, so a group of copies never reaches one task).  ``request_rate``
joins the key table back to the rows (one shuffle join of the rows; a key
that still holds many rows is split by adaptive skew-join handling).

Two exact plans for the key table:

* ``"window"`` - ``sum(n) OVER (PARTITION BY ip ORDER BY t RANGE w PRECEDING)``.
  One task holds a whole client, and Spark re-aggregates a sliding frame each
  time it moves (cost ~ keys x keys-in-frame).  Kept as the reference form.
* ``"bucketed"`` (default) - keys are grouped by ``(ip, floor(t / B))`` with
  ``B >= w``.  Each bucket also receives a *context* copy of the previous
  bucket's last ``w`` seconds (a fraction ``w / B`` of the keys).  In one
  window ordered by time, the rate is ``sum(n)`` up to the current row minus
  ``sum(n)`` up to ``t - w - 1us``: two growing frames, each O(1) per row.  A
  hot client is spread over its time buckets; one hash exchange on
  ``(ip, bucket)`` and one sort.
* ``"dense"`` - for traffic that crowds into one bucket.  Every key becomes an event at ``t`` and a probe at
  ``t - w - 1us``; both are sorted by ranges of (ip, time), so one client's crowded minute spreads over all tasks.
  Running counts inside a piece of a range are completed by the counts of the client's pieces before it (one row per piece
  and client), and a key's rate is the count at its event minus the count at its probe.  Three narrow exchanges.
* ``"auto"`` - counts the keys per (ip, bucket) first; clients with a bucket of more than ``CROWDED`` keys
  take the dense plan, all others the bucketed one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglens.schema import RATE_WINDOW_SECONDS
from loglens.session import materialize

_MICROS = 1_000_000
_DAY_US = 86_400 * _MICROS
#: Keys of one client in one bucket beyond which ``"auto"`` takes the dense plan for the client.
CROWDED = 1_000_000
#: Ranges of the dense plan are counted in pieces of 2 ** PIECE_BITS rows, many more than tasks.
PIECE_BITS = 16


def epoch_micros(ts: str) -> Column:
    """Wall-clock microseconds since 1970 for TIMESTAMP_NTZ.

    Built from zone-free parts (day number + wall-clock time of day), so the
    session time zone never enters: no daylight-saving gaps or overlaps.
    """
    c = f"CAST(`{ts}` AS TIMESTAMP_NTZ)"
    return F.expr(f"CAST(unix_date(CAST({c} AS DATE)) AS BIGINT) * {_DAY_US}L "
                  f"+ CAST(hour({c}) AS BIGINT) * {3_600 * _MICROS}L + CAST(minute({c}) AS BIGINT) * {60 * _MICROS}L "
                  f"+ CAST(extract(SECOND FROM {c}) * {_MICROS} AS BIGINT)")


def _floor_div(x: Column, d: int) -> Column:
    """Exact floor division of a long by a positive constant."""
    # (x - pmod(x, d)) is an exact multiple of d, so the double quotient is exact
    return ((x - F.pmod(x, F.lit(d))) / F.lit(d)).cast("long")


def key_table(df: DataFrame, ip_col: str = "client_ip", ts_col: str = "timestamp",
              partition_cols: Sequence[str] = ()) -> DataFrame:
    """Distinct (partition_cols, ip, ts) with multiplicity ``_rr_n``."""
    return df.groupBy(*partition_cols, ip_col, ts_col).agg(F.count(F.lit(1)).alias("_rr_n"))


def rate_table(keys: DataFrame, window_seconds: int = RATE_WINDOW_SECONDS,
               ip_col: str = "client_ip", ts_col: str = "timestamp", partition_cols: Sequence[str] = (),
               out_col: str = "request_rate", method: str = "bucketed",
               bucket_seconds: int | None = None) -> DataFrame:
    """Key table (with ``_rr_n``) -> same columns + ``out_col`` (double)."""
    if method == "window":
        return _rate_window(keys, window_seconds, ip_col, ts_col, partition_cols, out_col)
    if method == "dense":
        return _rate_dense(keys, window_seconds, ip_col, ts_col, partition_cols, out_col)
    if method not in ("bucketed", "auto"):
        raise ValueError(f"unknown rate method {method!r}")
    bucket_s = bucket_seconds or 4 * window_seconds
    if bucket_s < window_seconds:
        raise ValueError("bucket_seconds must be >= the rate window")
    if method == "auto":
        return _rate_auto(keys, window_seconds, ip_col, ts_col, partition_cols, out_col, bucket_s)
    return _rate_bucketed(keys, window_seconds, ip_col, ts_col, partition_cols, out_col, bucket_s)


def request_rate(df: DataFrame, window_seconds: int = RATE_WINDOW_SECONDS,
                 ip_col: str = "client_ip", ts_col: str = "timestamp",
                 partition_cols: Sequence[str] = (), out_col: str = "request_rate",
                 method: str = "bucketed", bucket_seconds: int | None = None) -> DataFrame:
    """Rows of ``df`` plus ``out_col``."""
    rates = rate_table(key_table(df, ip_col, ts_col, partition_cols), window_seconds, ip_col, ts_col,
                       partition_cols, out_col, method, bucket_seconds).drop("_rr_n")
    return join_keys(df, rates, [*partition_cols, ip_col, ts_col])


def join_keys(df: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys with null-safe equality (null client/time rows keep their values)."""
    renamed = table.select(*[F.col(k).alias(f"_jk_{i}") for i, k in enumerate(keys)],
                           *[c for c in table.columns if c not in keys])
    cond = None
    for i, k in enumerate(keys):
        c = df[k].eqNullSafe(renamed[f"_jk_{i}"])
        cond = c if cond is None else cond & c
    return df.join(renamed, cond, "left").drop(*[f"_jk_{i}" for i in range(len(keys))])


def _valid(ip_col, ts_col):
    return F.col(ts_col).isNotNull() & F.col(ip_col).isNotNull()


def _rate_window(keys, w, ip_col, ts_col, pcols, out_col):
    t = epoch_micros(ts_col)
    win = (Window.partitionBy(*pcols, ip_col).orderBy(t)
           .rangeBetween(-w * _MICROS, Window.currentRow))
    return keys.withColumn(out_col, F.when(_valid(ip_col, ts_col), F.sum("_rr_n").over(win))
                           .otherwise(0).cast("double"))


def _rate_bucketed(keys, w, ip_col, ts_col, pcols, out_col, bucket_s):
    w_us, b_us = w * _MICROS, bucket_s * _MICROS
    group = list(pcols) + [ip_col]
    t, b, real, cp = "_rr_t", "_rr_b", "_rr_real", "_rr_copy"
    valid = _valid(ip_col, ts_col)
    base = keys.withColumn(t, epoch_micros(ts_col)).withColumn(b, _floor_div(F.col(t), b_us))
    tail = F.col(t) >= (F.col(b) + 1) * b_us - w_us
    # each key in its own bucket, plus (in the last w seconds of a bucket) a
    # context copy that the next bucket counts but does not output
    copies = F.array(
        F.struct(F.lit(True).alias("r"), F.col(b).alias("b")),
        F.when(valid & tail, F.struct(F.lit(False).alias("r"), (F.col(b) + 1).alias("b"))),
    )
    u = (base.select(*group, ts_col, t, "_rr_n", F.explode(copies).alias(cp))
             .where(F.col(cp).isNotNull())
             .select(*group, ts_col, t, "_rr_n", F.col(f"{cp}.r").alias(real), F.col(f"{cp}.b").alias(b)))
    # rows in [t - w, t] = rows <= t  minus  rows <= t - w - 1us: two growing
    # frames (incremental), no sliding-frame re-aggregation
    order = Window.partitionBy(*group, b).orderBy(t)
    upto = F.sum("_rr_n").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    before = F.sum("_rr_n").over(order.rangeBetween(Window.unboundedPreceding, -(w_us + 1)))
    rated = u.withColumn(out_col, upto - F.coalesce(before, F.lit(0)))
    return (rated.where(F.col(real))
                 .select(*group, ts_col, "_rr_n",
                         F.when(valid, F.col(out_col)).otherwise(0).cast("double").alias(out_col)))


def _rate_dense(keys, w, ip_col, ts_col, pcols, out_col):
    w_us = w * _MICROS
    group = list(pcols) + [ip_col]
    valid = _valid(ip_col, ts_col)
    base = keys.where(valid).select(*group, ts_col, "_rr_n", epoch_micros(ts_col).alias("_rr_t"))
    marks = F.array(F.struct(F.col("_rr_t").alias("at"), F.lit(0).alias("probe"), F.col("_rr_n").alias("n")),
                    F.struct((F.col("_rr_t") - (w_us + 1)).alias("at"), F.lit(1).alias("probe"), F.lit(0).cast("bigint").alias("n")))
    # an event at the time of a probe is sorted before it: the probe counts it
    order = [*group, "_rr_at", "_rr_probe"]
    marked = base.select(*group, "_rr_t", F.explode(marks).alias("m")).select(
        *group, "_rr_t", F.col("m.at").alias("_rr_at"), F.col("m.probe").alias("_rr_probe"), F.col("m.n").alias("_rr_n"))
    order.append("_rr_t")
    sorted_rows = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    # ids grow along the sort: their high bits number the pieces in order
    dealt = materialize(sorted_rows.withColumn("_rr_range", F.shiftright(F.monotonically_increasing_id(), PIECE_BITS)), name="rate-ranges")
    inside = Window.partitionBy("_rr_range", *group).orderBy("_rr_at", "_rr_probe").rowsBetween(Window.unboundedPreceding, 0)
    counts = dealt.groupBy("_rr_range", *group).agg(F.sum("_rr_n").alias("_rr_sum"))
    earlier = Window.partitionBy(*group).orderBy("_rr_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_rr_range", *group, F.coalesce(F.sum("_rr_sum").over(earlier), F.lit(0)).alias("_rr_before"))
    upto = join_keys(dealt.withColumn("_rr_c", F.sum("_rr_n").over(inside)), counts, ["_rr_range", *group])
    sign = F.when(F.col("_rr_probe") == 0, 1).otherwise(-1)
    rates = upto.groupBy(*group, "_rr_t").agg(F.sum(sign * (F.col("_rr_c") + F.col("_rr_before"))).cast("double").alias(out_col))
    out = keys.withColumn("_rr_t", F.when(valid, epoch_micros(ts_col)))
    joined = join_keys(out, rates, [*group, "_rr_t"])
    return joined.select(*group, ts_col, "_rr_n", F.coalesce(out_col, F.lit(0.0)).alias(out_col))


def _rate_auto(keys, w, ip_col, ts_col, pcols, out_col, bucket_s):
    group = list(pcols) + [ip_col]
    bucket = _floor_div(epoch_micros(ts_col), bucket_s * _MICROS)
    crowded = (keys.where(_valid(ip_col, ts_col)).groupBy(*group, bucket.alias("_rr_b")).agg(F.count(F.lit(1)).alias("_rr_k"))
               .where(F.col("_rr_k") > CROWDED).select(*group).distinct().withColumn("_rr_hot", F.lit(True)))
    crowded = materialize(crowded, name="rate-crowded")
    if crowded.isEmpty():
        return _rate_bucketed(keys, w, ip_col, ts_col, pcols, out_col, bucket_s)
    # clients of more than CROWDED keys each: their table is at most the keys divided by that
    marked = join_keys(keys, crowded, group)
    hot = _rate_dense(marked.where("_rr_hot").drop("_rr_hot"), w, ip_col, ts_col, pcols, out_col)
    rest = _rate_bucketed(marked.where("_rr_hot IS NULL").drop("_rr_hot"), w, ip_col, ts_col, pcols, out_col, bucket_s)
    return hot.unionByName(rest)
