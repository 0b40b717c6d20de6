"""Total order by time, a distributed global row index and the split.

``Window.orderBy`` without a partition pulls the whole table into one task.
Instead the table is range-partitioned on the order key, sorted within each
partition, and each row gets ``offset(partition) + position``.  Positions
come from ``monotonically_increasing_id`` (partition index in the high bits,
position in the low 33 bits); offsets are a running sum over the per-partition
counts, a table with one row per partition (bounded by the partition count).

The tagged frame is persisted and both the counts and the final rows are read
from it: the partition index is then a stored column, so the two readers agree
even when the upstream row order is not reproducible (a lost cached block is
rebuilt through the same range partitioner and the same total-order sort).
The per-partition counts are collected (one row per partition) and the
offsets enter the plan as a literal array.
The partition count is fixed explicitly so adaptive execution does not
coalesce the range partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.schema import TRAIN_RATIO, VAL_RATIO
from loglens.session import persist_for_reuse

_LOW_BITS = (1 << 33) - 1


def _partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return num_partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def order_by_time(df: DataFrame, ts_col: str = "timestamp", tiebreak: Sequence[str] = ()) -> DataFrame:
    """Global sort by timestamp then tie-break columns (range exchange + sort)."""
    return df.orderBy(ts_col, *tiebreak)


def with_row_index(df: DataFrame, order_cols: Sequence[str], idx_col: str = "row_idx",
                   total_col: str | None = None, num_partitions: int | None = None,
                   stage=None) -> DataFrame:
    """Add a 0-based global position in ``order_cols`` order (ties: give a total order).

    Runs one small job now (row counts per range partition); the offsets
    (one per partition) enter the plan as a literal array indexed by the
    partition index, so the result needs no join.

    ``stage`` makes the tagged frame re-readable (default: persisted).  That
    is exact as long as the input's row order is reproducible (file scans,
    narrow maps, round-robin spreads); for an input that comes out of a
    shuffle pass ``stage=materialize`` so a lost executor cannot re-tag rows
    after the offsets were taken.
    """
    n = _partitions(df, num_partitions)
    pid, local, mid, uid = "_ri_pid", "_ri_local", "_ri_mid", "_ri_uid"
    # a unique last key: copies of a row (equal on every order column) can
    # then be split across range partitions instead of landing in one task;
    # their mutual order does not change the result
    keys = [*order_cols, uid]
    tagged = (df.withColumn(uid, F.monotonically_increasing_id())
                .repartitionByRange(n, *keys)
                .sortWithinPartitions(*keys)
                .withColumn(mid, F.monotonically_increasing_id())
                .withColumn(pid, F.shiftright(F.col(mid), 33).cast("int"))
                .withColumn(local, F.col(mid).bitwiseAND(F.lit(_LOW_BITS)))
                .drop(mid))
    tagged = (stage or persist_for_reuse)(tagged)
    counts = {r[0]: r[1] for r in tagged.groupBy(pid).agg(F.count(F.lit(1))).collect()}
    offsets, running = [], 0
    for p in range(max(counts, default=-1) + 1):
        offsets.append(running)
        running += counts.get(p, 0)
    if not offsets:
        offsets = [0]
    offset = F.element_at(F.array(*[F.lit(o) for o in offsets]).cast("array<bigint>"), F.col(pid) + 1)
    out = tagged.withColumn(idx_col, offset + F.col(local))
    if total_col:
        out = out.withColumn(total_col, F.lit(running).cast("bigint"))
    return out.drop(pid, local, uid)


def split_bounds(n_col, train_ratio: float = TRAIN_RATIO, val_ratio: float = VAL_RATIO):
    """``int(n*train)``, ``int(n*(train+val))`` in double arithmetic."""
    train_end = F.floor(n_col.cast("double") * F.lit(float(train_ratio))).cast("long")
    val_end = F.floor(n_col.cast("double") * F.lit(float(train_ratio + val_ratio))).cast("long")
    return train_end, val_end


def chronological_split(df: DataFrame, ts_col: str = "timestamp", tiebreak: Sequence[str] = (),
                        train_ratio: float = TRAIN_RATIO, val_ratio: float = VAL_RATIO,
                        num_partitions: int | None = None, stage=None) -> DataFrame:
    """Label rows ``train``/``val``/``test`` by position in time order.

    Adds ``row_idx`` (global 0-based position) and ``split``.
    """
    tot = "_split_n"
    indexed = with_row_index(df, [ts_col, *tiebreak], "row_idx", tot, num_partitions, stage)
    train_end, val_end = split_bounds(F.col(tot), train_ratio, val_ratio)
    idx = F.col("row_idx")
    return (indexed.withColumn("split", F.when(idx < train_end, "train").when(idx < val_end, "val")
                                          .otherwise("test"))
                   .drop(tot))
