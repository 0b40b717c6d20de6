"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglens.session import materialize, ship_package

#: Columns of the documents table, in order.
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies (the default of every path parameter)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch: rows hold whole texts.
BATCH_ROWS = 2_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` with the package shipped to the Python workers first.

    The session's Arrow batches are set to at most ``BATCH_ROWS`` rows and stay so: Spark keeps a second set of Python
    workers for another setting, and both would hold memory.
    """
    spark = df.sparkSession
    ship_package(spark)
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    return df.mapInArrow(_tidied(fn), schema)


def _tidied(fn):
    """The same, and then memory that the task's batches took goes back to the system: workers live on."""
    def run(batches):
        yield from fn(batches)
        import pyarrow as pa

        pa.default_memory_pool().release_unused()

    return run


def cut(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: a Parquet table in the shared checkpoint folder, reread."""
    return materialize(df, name=name)


def row_with_text(docs: DataFrame, keep: list[str]) -> list[Column]:
    """``row`` (a struct of the columns to keep) and ``_text``, which is left out where the row holds it as it is."""
    row = F.struct(*keep).alias("row")
    if "text" in keep and dict(docs.dtypes)["text"] == "string":
        return [row]
    return [row, F.col("text").cast("string").alias("_text")]


def texts(batch):
    """The texts of an Arrow batch made with ``row_with_text``."""
    return batch.column("_text") if "_text" in batch.schema.names else batch.column("row").field("text")


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: A side with at most this many narrow rows may be broadcast; it is counted first.
BROADCAST_ROWS = 100_000


def join_checked(df: DataFrame, side: DataFrame, on: list[str], how: str, name: str) -> DataFrame:
    """Join a grouped side that is usually small: it is written once and counted, broadcast if it has at most
    ``BROADCAST_ROWS`` rows and joined by a shuffle otherwise (adaptive execution then splits hot keys)."""
    side = cut(side, name)
    return df.join(F.broadcast(side) if side.count() <= BROADCAST_ROWS else side, on, how)
