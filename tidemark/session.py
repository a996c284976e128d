"""Session construction and the shared scratch area."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}


def build_session(app: str = "tidemark", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a cluster
    its executors would not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
        application = spark.sparkContext.applicationId
        if application not in _local_roots:
            _local_roots[application] = tempfile.mkdtemp(prefix="tidemark-")
        root = _local_roots[application]
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/tidemark/{label}-{uuid.uuid4().hex}"


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path names a folder, in whatever store Spark reads it from."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()


@contextmanager
def scratch_space(spark: SparkSession, label: str) -> Iterator[str]:
    """A scratch folder for tables that nobody needs afterwards; it goes when the block ends."""
    path = scratch_path(spark, label)
    try:
        yield path
    finally:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialize(df: DataFrame, label: str, within: str | None = None) -> DataFrame:
    """Cut lineage with a written table: survives executor loss and is computed once.

    The table stays below the scratch folder, or goes with the scratch space ``within``.
    """
    spark = df.sparkSession
    path = f"{within}/{label}-{uuid.uuid4().hex}" if within else scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _filesystem(spark: SparkSession, path: str) -> tuple:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def child_folders(spark: SparkSession, path: str, committed: bool = False) -> list[str]:
    """Names of the partition folders below a path; only those that a finished write left, if asked for. None if it is not there."""
    files, place = _filesystem(spark, path)
    if not files.exists(place):
        return []
    found = [s.getPath() for s in files.listStatus(place) if s.isDirectory() and "=" in s.getPath().getName()]
    if committed:
        found = [p for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return [p.getName() for p in found]


def remove_folder(spark: SparkSession, path: str) -> None:
    files, place = _filesystem(spark, path)
    files.delete(place, True)


def spread(rows: DataFrame) -> DataFrame:
    """Rows over all cores where they come in fewer partitions and each is costly to work on; as they are otherwise."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)
