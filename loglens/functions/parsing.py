"""Column expressions that parse raw log text the way the original loader does.

All are plain Spark SQL expressions (whole-stage codegen, no Python).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values (must match the original loader's parsing) -------------
# a plain decimal / scientific number, optional sign, optional outer blanks
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
# infinities accepted for latency only
INFINITY_PATTERN = r"^\s*[+-]?(inf|infinity)\s*$"
# leading / trailing whitespace of any kind
OUTER_SPACE_PATTERN = r"^\s+|\s+$"
# ---- end of fixed values --------------------------------------------------

# ISO-8601 basic forms (no separators), rewritten to the extended form step by step: the date, then
# HHMMSS (a fraction and a zone may follow), HHMM and HH (a zone may follow)
BASIC_ISO_STEPS = [
    (r"^(\d{4})(\d{2})(\d{2})($|[T ])", "$1-$2-$3$4"),
    (r"^(\d{4}-\d{2}-\d{2}[T ]\d{2})(\d{2})(\d{2})", "$1:$2:$3"),
    (r"^(\d{4}-\d{2}-\d{2}[T ]\d{2})(\d{2})($|[Zz+-].*$)", "$1:$2$3"),
    (r"^(\d{4}-\d{2}-\d{2}[T ]\d{2})($|[Zz+-].*$)", "$1:00$2"),
]


def _lit(pattern: str) -> str:
    """A regex as a Spark SQL string literal (backslashes and quotes escaped)."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def strip_all_sql(e: str) -> str:
    return f"regexp_replace({e}, {_lit(OUTER_SPACE_PATTERN)}, '')"


def strip_all(c: Column) -> Column:
    return F.regexp_replace(c, OUTER_SPACE_PATTERN, "")


def _is_numeric_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def parse_double_sql(c: str, dtype: T.DataType, allow_infinity: bool = False) -> str:
    """Text or number -> double; anything unparsable (and NaN) -> null."""
    if _is_numeric_type(dtype):
        x = f"CAST({_q(c)} AS DOUBLE)"
    else:
        s = f"CAST({_q(c)} AS STRING)"
        ok = f"({s} RLIKE {_lit(NUMBER_PATTERN)})"
        if allow_infinity:
            ok = f"({ok} OR lower({s}) RLIKE {_lit(INFINITY_PATTERN)})"
        x = f"(CASE WHEN {ok} THEN try_cast({strip_all_sql(s)} AS DOUBLE) END)"
    return f"nanvl({x}, CAST(NULL AS DOUBLE))"


def parse_bigint_sql(c: str, dtype: T.DataType) -> str:
    """Text or number -> BIGINT, exact for every 64-bit integer; fractions are cut off, all else -> null."""
    if isinstance(dtype, T.IntegralType):
        return f"CAST({_q(c)} AS BIGINT)"
    through_double = f"try_cast({parse_double_sql(c, dtype)} AS BIGINT)"
    if _is_numeric_type(dtype):
        return f"try_cast({_q(c)} AS BIGINT)" if isinstance(dtype, T.DecimalType) else through_double
    s = strip_all_sql(f"CAST({_q(c)} AS STRING)")
    return f"(CASE WHEN {s} RLIKE '^[+-]?[0-9]+$' THEN try_cast({s} AS BIGINT) ELSE {through_double} END)"


def parse_bigint(c: str, dtype: T.DataType) -> Column:
    return F.expr(parse_bigint_sql(c, dtype))


def parse_flag_sql(c: str, dtype: T.DataType) -> str:
    """A 0/1 label -> INT: booleans, the texts true/false (any case) and numbers (fractions cut off); all else -> null."""
    if isinstance(dtype, T.BooleanType):
        return f"CAST({_q(c)} AS INT)"
    number = f"try_cast({parse_double_sql(c, dtype)} AS INT)"
    if _is_numeric_type(dtype):
        return number
    s = strip_all_sql(f"lower(CAST({_q(c)} AS STRING))")
    return f"(CASE {s} WHEN 'true' THEN 1 WHEN 'false' THEN 0 ELSE {number} END)"


def parse_double(c: str, dtype: T.DataType, allow_infinity: bool = False) -> Column:
    return F.expr(parse_double_sql(c, dtype, allow_infinity))


def parse_timestamp_sql(c: str, dtype: T.DataType) -> str:
    """ISO-8601 text -> TIMESTAMP_NTZ (wall clock kept); failures -> null."""
    if isinstance(dtype, T.TimestampNTZType):
        return _q(c)
    if isinstance(dtype, (T.TimestampType, T.DateType)):
        return f"CAST({_q(c)} AS TIMESTAMP_NTZ)"
    s = strip_all_sql(f"CAST({_q(c)} AS STRING)")
    for pattern, extended in BASIC_ISO_STEPS:
        s = f"regexp_replace({s}, {_lit(pattern)}, '{extended}')"
    return f"try_cast({s} AS TIMESTAMP_NTZ)"


def parse_timestamp(c: str, dtype: T.DataType) -> Column:
    return F.expr(parse_timestamp_sql(c, dtype))


def clean_text_sql(c: str, upper: bool = False) -> str:
    """str() of the value with outer whitespace stripped; null -> 'nan'."""
    from loglens.schema import MISSING_TEXT

    s = f"coalesce(CAST({_q(c)} AS STRING), '{MISSING_TEXT}')"
    if upper:
        s = f"upper({s})"
    return strip_all_sql(s)


def clean_text(c: str, upper: bool = False) -> Column:
    return F.expr(clean_text_sql(c, upper))
