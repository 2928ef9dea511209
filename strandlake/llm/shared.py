"""Helpers shared by the corpus operators: durable intermediate tables and readers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Most bytes of an Arrow batch between Spark and a worker. The default of 64 MB costs several hundred MB an executor with rows as long as texts.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limit on Arrow batches to BATCH_BYTES, where it is higher; results don't depend on it."""
    size = re.fullmatch(r"(\d+)b?", spark.conf.get(_BATCH))
    if size is None or not 0 < int(size[1]) <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, a local session (tests) gets a folder of its own; a cluster is an error, since
    a machine-local folder would be lost with its machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        # local or local[...], where driver and executors are one process; local-cluster[...] isn't
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strandlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Folders of intermediate tables that this process made and hasn't deleted.
_MADE: list[str] = []


def new_folder(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/strandlake/{tag}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables of all operators called so far, once their results are stored; how many there were."""
    jvm, n = spark.sparkContext._jvm, len(_MADE)
    while _MADE:
        path = jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


#: Shuffle files go at the end of the execution that wrote them. Otherwise they stay until the driver's collector finds their plans, which a driver with room to spare doesn't for hours.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back. The shuffle files of the write are deleted once it is done."""
    spark = df.sparkSession
    small_batches(spark)
    path, before = new_folder(spark, tag), spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete materialized tables that no later step reads."""
    jvm = spark.sparkContext._jvm
    for df in tables:
        for f in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(f).getParent()
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
