"""Rows that are kept between the rounds of an iterative operator."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, tag: str) -> str:
    """A new folder's path in the checkpoint folder; see `durable`."""
    _prepare(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """df's rows, written to the checkpoint folder that the cluster names: its plan is a scan, so that rounds don't pile up, and lost executors cost nothing that was written.

    A local session without such a folder gets one of its own; a cluster without one is an error, since a machine's folder is lost with it.
    """
    _prepare(df.sparkSession)
    return df.checkpoint()


def _prepare(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            found = "file://" + tempfile.mkdtemp(prefix="strandlake-rounds-")
        sc.setCheckpointDir(found)
