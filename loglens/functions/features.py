"""Row-local feature formulas.

Each formula is one Spark SQL expression (built-in functions, whole-stage
codegen); building it costs one gateway call instead of one per function.
Arguments are column names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from loglens.schema import METHOD_CODES, UNKNOWN_METHOD_CODE

TWO_PI = 2 * math.pi
EULER_GAMMA = 0.5772156649015329
_INF = "CAST('Infinity' AS DOUBLE)"


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def log1p_clipped_sql(c: str) -> str:
    return f"log1p(greatest(CAST({_q(c)} AS DOUBLE), 0.0D))"


def status_class_sql(c: str) -> str:
    return f"CAST(floor({_q(c)} / 100) AS DOUBLE)"


def is_5xx_sql(c: str) -> str:
    return f"coalesce(CAST({_q(c)} >= 500 AS DOUBLE), 0.0D)"


def is_4xx_sql(c: str) -> str:
    return f"coalesce(CAST({_q(c)} >= 400 AND {_q(c)} < 500 AS DOUBLE), 0.0D)"


def hour_of_day_sql(c: str) -> str:
    """Hour plus minute/60 (seconds ignored)."""
    return f"(CAST(hour({_q(c)}) AS DOUBLE) + CAST(minute({_q(c)}) AS DOUBLE) / 60.0D)"


def day_of_week_sql(c: str) -> str:
    """Monday = 0 ... Sunday = 6."""
    return f"CAST(weekday({_q(c)}) AS DOUBLE)"


def cyclic_sql(x: str, period: float) -> tuple[str, str]:
    angle = f"({TWO_PI!r}D * {x} / {float(period)!r}D)"
    return f"sin{angle}", f"cos{angle}"


def method_code_sql(c: str) -> str:
    whens = " ".join(f"WHEN '{m}' THEN {code}" for m, code in METHOD_CODES.items())
    return f"CAST(CASE {_q(c)} {whens} ELSE {UNKNOWN_METHOD_CODE} END AS DOUBLE)"


def finite_or_null_sql(c: str) -> str:
    """+-inf and NaN become null (they are imputed like missing values)."""
    x = f"CAST({_q(c)} AS DOUBLE)"
    return f"CASE WHEN isnan({x}) OR abs({x}) = {_INF} THEN NULL ELSE {x} END"


def average_path_length_sql(c: str) -> str:
    """c(n) = 2 H(n-1) - 2 (n-1)/n with H(i) ~ ln(i) + Euler's constant."""
    n = f"CAST({_q(c)} AS DOUBLE)"
    return (f"CASE WHEN {n} <= 1.0D THEN 0.0D WHEN {n} = 2.0D THEN 1.0D "
            f"ELSE 2.0D * (ln({n} - 1.0D) + {EULER_GAMMA!r}D) - 2.0D * ({n} - 1.0D) / {n} END")


# ---- Column forms ---------------------------------------------------------------

def log1p_clipped(c: str) -> Column:
    return F.expr(log1p_clipped_sql(c))


def status_class(c: str) -> Column:
    return F.expr(status_class_sql(c))


def is_5xx(c: str) -> Column:
    return F.expr(is_5xx_sql(c))


def is_4xx(c: str) -> Column:
    return F.expr(is_4xx_sql(c))


def time_cycle(c: str) -> dict[str, Column]:
    hs, hc = cyclic_sql(hour_of_day_sql(c), 24)
    ds, dc = cyclic_sql(day_of_week_sql(c), 7)
    return {"hour_sin": F.expr(hs), "hour_cos": F.expr(hc), "dow_sin": F.expr(ds), "dow_cos": F.expr(dc)}


def method_code(c: str) -> Column:
    return F.expr(method_code_sql(c))


def finite_or_null(c: str) -> Column:
    return F.expr(finite_or_null_sql(c))


def average_path_length(c: str) -> Column:
    return F.expr(average_path_length_sql(c))
