"""SparkSession construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app_name: str = "loglens",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Session with the settings the library relies on (UTC, ANSI, AQE)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder must be set by the deployment (a shared file
    system).  Only a local-mode session without the setting (tests, the bench)
    gets a fresh scratch folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    local = tempfile.mkdtemp(prefix="loglens-ckpt-", dir=os.environ.get("LOGLENS_SCRATCH"))
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir()


def spread(df):
    """Round-robin a frame with fewer partitions than task slots.

    A small table (one file with one row group, or a few small files packed
    into one split) is read by fewer tasks than the cluster has slots, so the
    work after it would run partly serial.  Frames that already have at least
    as many partitions as slots (any large table) are returned unchanged: no
    extra shuffle.
    """
    try:
        slots = df.sparkSession.sparkContext.defaultParallelism
        parts = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - sessions without RDD access: leave as is
        return df
    if parts < slots:
        return df.repartition(slots)
    return df


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check on any Hadoop-compatible file system (no failed read)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def materialize(df, partition_by=None, name: str = "table"):
    """Cut lineage: write ``df`` as a Parquet table under the shared checkpoint
    folder and return a fresh scan of it.

    Parquet (not a row-serialised RDD checkpoint) keeps the copy compressed and
    columnar, so later reads prune columns, push filters down and, with
    ``partition_by`` (e.g. the split label), skip whole partitions.  The files
    live on the shared file system, so they survive lost executors.
    """
    import uuid

    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    writer.parquet(path)
    return spark.read.parquet(path).select(*df.columns)


_PERSISTED: list = []


def persist_for_reuse(df):
    """Persist a frame that is read twice and must give the same rows both times.

    Jobs call :func:`release_persisted` once their results are materialised.
    """
    from pyspark import StorageLevel

    out = df.persist(StorageLevel.MEMORY_AND_DISK)
    _PERSISTED.append(out)
    return out


def release_persisted() -> None:
    while _PERSISTED:
        _PERSISTED.pop().unpersist(blocking=False)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``loglens`` importable by Python workers (once per application).

    The tree-growing and scoring functions run in executor Python processes;
    the package is zipped and added with ``addPyFile`` (the programmatic form
    of ``--py-files``), so executors need no pre-installed copy.
    """
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import loglens

    pkg = os.path.dirname(os.path.abspath(loglens.__file__))
    root = os.path.dirname(pkg)
    fd, path = tempfile.mkstemp(prefix="loglens-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
