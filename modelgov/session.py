"""Session settings and the one way this package cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
TABLE_PREFIX = "modelgov_dealt_"
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
RELEASE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "modelgov", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC timestamps."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config(RELEASE_SHUFFLES, "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder named by the session; make one up only in local mode."""
    sc = spark.sparkContext
    shared = sc.getConf().get(CHECKPOINT_KEY) or spark.conf.get(CHECKPOINT_KEY, None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if shared is None:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder every executor can reach")
        shared = os.path.join(tempfile.gettempdir(), f"modelgov-checkpoints-{sc.applicationId}")
    elif not sc.master.startswith("local") and (":/" not in shared or shared.startswith("file:")):
        raise RuntimeError(f"{CHECKPOINT_KEY} must be a URL of shared storage on a cluster: {shared!r} may be another folder on every machine")
    sc.setCheckpointDir(shared)
    return shared


def release_shuffles(spark: SparkSession) -> None:
    """Let the shuffle files of a job go when it ends, not when the driver's memory is next collected.

    A job that runs again writes them again; what several jobs read is a written table (``materialise``).
    """
    spark.conf.set(RELEASE_SHUFFLES, "true")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of ``scratch`` and all below it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder, for files of one run."""
    return f"{_run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _run_folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/modelgov-{spark.sparkContext.applicationId}"


def discard(spark: SparkSession) -> None:
    """Delete every table and file this application wrote with ``materialise`` and ``scratch``.

    Results that still read them are lost, so call it when all results are written elsewhere.
    """
    for table in spark.catalog.listTables():
        if table.name.startswith(TABLE_PREFIX):
            spark.sql(f"DROP TABLE IF EXISTS {table.name}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(_run_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and return a scan of the written table.

    The work is done once, survives executor loss, stops iterative plans from growing, and
    leaves sizes from which the optimizer picks join strategies.  Columns are packed tightly (zstd),
    for every byte is written to shared storage and read again.
    """
    spark = df.sparkSession
    folder = scratch(spark, "table")
    df.write.parquet(folder, compression="zstd")
    return spark.read.schema(df.schema).parquet(folder)


def reuse_dealing(spark: SparkSession, reuse: bool = True) -> None:
    """Let joins use rows dealt by a part of their keys, as ``dealt`` tables are; without it they are right, but shuffled."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", str(not reuse).lower())


def buckets(spark: SparkSession) -> int:
    """As many as shuffles start from."""
    return int(spark.conf.get(INITIAL_PARTITIONS, None) or spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """``materialise`` as a table dealt by columns: joins and groups that contain them read it without a shuffle.

    Buckets are as many as shuffles have partitions, so rows that come dealt by the same columns make one file a bucket.
    """
    spark = df.sparkSession
    name = f"{TABLE_PREFIX}{uuid.uuid4().hex}"
    df.write.bucketBy(buckets(spark), *by).option("path", scratch(spark, "dealt")).option("compression", "zstd").saveAsTable(name, format="parquet")
    return spark.table(name)
