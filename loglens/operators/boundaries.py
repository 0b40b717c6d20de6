"""Chronological split by selected boundary keys.

A split needs no row numbers, only the keys at two ranks of the time order.  The keys (time, tie-break columns and
the row's place in the scan, which tells copies apart) are written once as a narrow table.  Ranks are then selected
in it by histogram refinement: one grouped count over at most ``BINS`` bins of the wanted interval names the bin
that holds a rank, and the next count looks inside it, until the bin is one value.  Rows of that value go
on with the next key column.  Columns without arithmetic (text) are ordered among the rows that are still tied.

The result is a projection of the input with literal boundaries: the wide rows are neither shuffled nor cached.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglens.operators.ordering import with_row_index
from loglens.operators.rate import epoch_micros
from loglens.schema import TRAIN_RATIO, VAL_RATIO
from loglens.session import materialize

#: Bins of one refinement; the counts come to the driver.
BINS = 4096
_PLACE = "_bk_place"
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _below(name: str, value: Any, kind: T.DataType) -> Column:
    """``name`` sorts before ``value`` (nulls first)."""
    if value is None:
        return F.lit(False)
    return F.coalesce(F.col(name) < F.lit(value).cast(kind), F.lit(True))


def _equal(name: str, value: Any, kind: T.DataType) -> Column:
    return F.col(name).isNull() if value is None else F.coalesce(F.col(name) == F.lit(value).cast(kind), F.lit(False))


def _ends(rows: DataFrame, name: str) -> tuple:
    """Least and greatest value, rows with a value and rows without one."""
    return tuple(rows.agg(F.min(name), F.max(name), F.count(name), F.count_if(F.col(name).isNull())).first())


def _select_whole(rows: DataFrame, name: str, rank: int, ends: tuple) -> tuple[Any, Any, int, int]:
    """(low, high, rows below, rows within): an interval of a whole-number column around a rank (nulls first) that is
    one value or holds at most ``BINS`` rows."""
    low, high, same, nulls = ends
    if rank < nulls:
        return None, None, 0, nulls
    below = nulls
    while low < high and same > BINS:
        width = -(-(high - low + 1) // BINS)
        inside = rows.where(F.col(name).between(low, high))
        # decimal arithmetic: a difference of two longs need not fit a long
        offset = F.col(name).cast("decimal(38,0)") - F.lit(str(low)).cast("decimal(38,0)")
        counts = inside.groupBy(F.floor(offset / F.lit(str(width)).cast("decimal(38,0)")).cast("int").alias("bin")) \
            .agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("low"), F.max(name).alias("high")).collect()
        for r in sorted(counts, key=lambda r: r["bin"]):
            if rank < below + r["n"]:
                low, high, same = r["low"], r["high"], r["n"]
                break
            below += r["n"]
    return low, high, below, same


def _select_ordered(rows: DataFrame, name: str, rank: int) -> tuple[Any, int, int]:
    """The same for any column that has an order, over the rows that are still tied."""
    counts = rows.groupBy(name).agg(F.count(F.lit(1)).alias("_bk_n"))
    placed = with_row_index(counts, [name], "_bk_i")
    # running sums over the distinct values: per block of positions, then inside the block that holds the rank
    blocks = placed.groupBy(F.floor(F.col("_bk_i") / BINS).alias("b")).agg(F.sum("_bk_n").alias("n")).orderBy("b").collect()
    below = 0
    for block in blocks:
        if rank < below + block["n"]:
            break
        below += block["n"]
    for r in placed.where(F.floor(F.col("_bk_i") / BINS) == block["b"]).orderBy("_bk_i").collect():
        if rank < below + r["_bk_n"]:
            return r[name], below, r["_bk_n"]
        below += r["_bk_n"]
    raise AssertionError("rank lies beyond the rows")


def key_at(keys: DataFrame, columns: Sequence[str], rank: int, ends: tuple | None = None) -> list[Any]:
    """The key of the row at a rank in the order of ``columns``: as many of them as it takes to be the only one.

    ``ends`` may give what ``_ends`` finds for the first column.
    """
    out: list[Any] = []
    for i, name in enumerate(columns):
        kind = keys.schema[name].dataType
        if isinstance(kind, _WHOLE):
            low, high, below, same = _select_whole(keys, name, rank, ends or _ends(keys, name))
            ends = None
            if low is not None and same <= BINS:  # few rows are left: the rest of the key in one go
                left = keys.where(F.col(name).between(low, high)).select(*columns[i:]).orderBy(*columns[i:]).collect()
                found = tuple(left[rank - below])
                for n in range(1, len(found) + 1):
                    if sum(tuple(r)[:n] == found[:n] for r in left) == 1:
                        break
                return out + list(found[:n])
            value = low
        else:
            value, below, same = _select_ordered(keys, name, rank)
        out.append(value)
        if same == 1:
            break
        rank -= below
        keys = keys.where(_equal(name, value, kind))
    return out


def before(schema: T.StructType, columns: Sequence[str], key: Sequence[Any]) -> Column:
    """Whether a row sorts before a key (which may hold the first columns alone)."""
    out = F.lit(False)
    for name, value in reversed(list(zip(columns, key))):
        kind = schema[name].dataType
        out = _below(name, value, kind) | (_equal(name, value, kind) & out)
    return out


def boundary_split(df: DataFrame, ts_col: str = "timestamp", tiebreak: Sequence[str] = (), train_ratio: float = TRAIN_RATIO,
                   val_ratio: float = VAL_RATIO) -> DataFrame:
    """``df`` with ``split`` = ``train`` / ``val`` / ``test`` by position in the order of time and tie-break.

    The same rows as ``chronological_split`` labels, without its row numbers.  Copies (equal on all keys) are told
    apart by their place in the scan; only where a boundary falls among copies must that order be reproducible
    (files, narrow maps).
    """
    time = "_bk_time"
    marked = df.withColumn(time, epoch_micros(ts_col)).withColumn(_PLACE, F.monotonically_increasing_id())
    columns = [time, *tiebreak, _PLACE]
    keys = materialize(marked.select(*columns), name="split-keys")
    first = _ends(keys, time)
    n = first[2] + first[3]
    ends = int(n * float(train_ratio)), int(n * float(train_ratio + val_ratio))
    label = F.lit("test")
    for name, end in (("val", ends[1]), ("train", ends[0])):
        if end >= n:
            label = F.lit(name)
        elif end > 0:
            label = F.when(before(keys.schema, columns, key_at(keys, columns, end, first)), name).otherwise(label)
    return marked.withColumn("split", label).drop(time, _PLACE)
