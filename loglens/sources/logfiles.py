"""Log files in and out: CSV scan (text columns, never inferred), CSV export,
and a one-record batch for hand-entered logs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglens.operators.cleaning import alias_columns, clean_logs, validate_log_schema
from loglens.schema import RAW_LOG_SCHEMA

# ---- fixed values: text the original CSV reader treats as missing -----------
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# ---- end of fixed values ----------------------------------------------------


#: The usual CSV dialect: a quote inside a quoted field is doubled, blanks belong to the field.
CSV_DIALECT = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False,
               "ignoreTrailingWhiteSpace": False}


def blank_tokens(df: DataFrame) -> DataFrame:
    """Missing-value tokens of text columns -> null."""
    return df.select([F.when(F.col(c).isin(NA_TOKENS), F.lit(None).cast("string")).otherwise(F.col(c)).alias(c)
                      for c in df.columns])


def _scan(spark: SparkSession, path: str, multi_line: bool, **options) -> DataFrame:
    if not path.rstrip("/").lower().endswith(".csv"):
        raise ValueError("only CSV input is supported (path must end in .csv)")
    try:
        return spark.read.options(**CSV_DIALECT, multiLine=multi_line, enforceSchema=False, **options).csv(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            raise FileNotFoundError(f"no such file: {path}") from e
        raise


def read_raw_csv(spark: SparkSession, *paths: str, multi_line: bool = True) -> DataFrame:
    """All columns as text, named by the header; missing-value tokens -> null.

    Several paths are united by column name (a column that one lacks is null there).  Within a folder all
    files must have the same header: a file that differs fails the scan instead of being read by position.
    ``multi_line`` (default) reads line breaks inside quotes, which keeps one file in one task; pass
    False for large files without such breaks, so that they are split among tasks.
    """
    if not paths:
        raise ValueError("no path given")
    frames = [blank_tokens(_scan(spark, p, multi_line)) for p in paths]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def count_malformed(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row (records, malformed): records with more or fewer fields than the header are malformed.  Reading keeps
    them, with nulls for missing fields and without surplus ones; this count makes them seen."""
    schema = T.StructType(_scan(spark, path, multi_line).schema.fields + [T.StructField("_malformed", T.StringType())])
    rows = (spark.read.schema(schema).options(**CSV_DIALECT, multiLine=multi_line, columnPruning=False,
                                              columnNameOfCorruptRecord="_malformed").csv(path))
    first = schema.fields[0].name
    return rows.agg((F.count(first) + F.count_if(F.col(first).isNull())).alias("records"),
                    F.count("_malformed").alias("malformed"))


def load_logs(spark: SparkSession, path: str, require_labels: bool = False, multi_line: bool = True) -> DataFrame:
    """Scan a CSV log and return the cleaned log."""
    raw = read_raw_csv(spark, path, multi_line=multi_line)
    if require_labels:
        validate_log_schema(alias_columns(raw), require_labels=True)
    return clean_logs(raw)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """CSV with a header; one output folder of part files (parents are created)."""
    (df.write.mode(mode).options(**CSV_DIALECT)
       .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
       .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
       .csv(path))
    return path


def single_record(spark: SparkSession, **fields) -> DataFrame:
    """A one-row raw batch for a hand-entered log record (all text)."""
    row = {f.name: (None if fields.get(f.name) is None else str(fields[f.name])) for f in RAW_LOG_SCHEMA.fields}
    return spark.createDataFrame([row], RAW_LOG_SCHEMA)
