"""CSV tables and JSON summaries, in any file system that Spark writes to."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LONG_SCHEMA = "sequence string, endpoint string, `group` string, species string, resistant boolean, value_um double, censor int, amidated boolean"
GROUPS = ("gram_negative", "gram_positive", "hc50", "resistant")
WIDE_SCHEMA = "sequence string, " + ", ".join([f"{g} double" for g in GROUPS] + [f"{g}_censor int" for g in GROUPS] + [f"{g}_n long" for g in GROUPS])


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """Comma-separated parts with a header each, nulls as empty fields; single: one part, for small tables."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", '""').csv(path)


def write_long(measurements: DataFrame, path: str) -> None:
    """The long activity table: kept measurements as `records.measurements` gives them."""
    write_csv(measurements.select(F.col("s").alias("sequence"), "endpoint", F.col("grp").alias("group"), "species", "resistant", "value_um", "censor", "amidated"), path)


def read_long(spark: SparkSession, path: str) -> DataFrame:
    """s, endpoint, grp, species, resistant, value_um, censor, amidated."""
    rows = spark.read.option("header", True).option("nullValue", "").option("mode", "FAILFAST").schema(LONG_SCHEMA).csv(path)
    return rows.withColumnsRenamed({"sequence": "s", "group": "grp"})


def write_wide(wide: DataFrame, path: str) -> None:
    """The wide activity table, the sequence first; unmeasured groups are empty."""
    names = [c.strip().split()[0] for c in WIDE_SCHEMA.split(",")][1:]
    write_csv(wide.select(F.col("s").alias("sequence"), *names), path)


def read_wide(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("nullValue", "").option("mode", "FAILFAST").schema(WIDE_SCHEMA).csv(path).withColumnRenamed("sequence", "s")


def write_json(spark: SparkSession, value, path: str) -> None:
    """One JSON document (a summary: metrics, windows, settings), indented, in a folder of one part."""
    text = json.dumps(value, indent=2, sort_keys=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str):
    return json.loads("\n".join(r["value"] for r in spark.read.text(path).collect()))


def summary(df: DataFrame, key: str) -> dict:
    """A small table as {key: {column: value}}, in order of the key; what write_json takes."""
    return {r[key]: {c: v for c, v in r.asDict().items() if c != key} for r in df.orderBy(key).toLocalIterator()}
