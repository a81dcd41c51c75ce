"""Session construction and lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}


def get_session(app_name: str = "quillspark", master: str | None = None, **conf) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume.

    On a cluster ``master`` and all sizing come from spark-submit; only semantics are pinned here.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for materialised intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Where it is unset, a purely local master (one process)
    gets a temporary folder; anything else must be configured, because executors cannot read the driver's disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="quillspark-")
    return _local_roots[app]


def _tables_folder(spark: SparkSession) -> str:
    """The application's own folder of intermediate tables, so that its owner can drop them together."""
    return f"{checkpoint_root(spark)}/tables/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession) -> str:
    """A path of its own among the intermediate tables."""
    return f"{_tables_folder(spark)}/{uuid.uuid4().hex}"


def drop_tables(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; DataFrames that read them can't be used any more."""
    drop_folder(spark, _tables_folder(spark))


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete one intermediate table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def materialize(df: DataFrame, *partition_by: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` once and read it back: cuts lineage and survives executor loss.

    A parquet table rather than an RDD checkpoint keeps column pruning, filter pushdown and the size
    statistics by which Spark decides on broadcast joins.
    """
    spark = df.sparkSession
    path = folder or new_folder(spark)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
