"""Global row numbers without gathering rows: a range partitioning, and each partition's offset."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder the cluster names; a temporary one only where there are no other machines."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark._jsc.sc().getCheckpointDir().isEmpty():
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillstack-"))
    return df.checkpoint()


def number_rows(df: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """df with consecutive numbers from 1 in the given order. What is sent to all tasks is one row a partition."""
    place = F.monotonically_increasing_id()
    held = settled(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": place.bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = sorted((r["_part"], r["n"]) for r in held.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, before = [], 0
    for part, n in sizes:
        offsets.append((part, before))
        before += n
    known = df.sparkSession.createDataFrame(offsets, "_part int, _before long")
    return held.join(F.broadcast(known), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def number_within(df: DataFrame, group: str, *order: str, name: str = "idx") -> DataFrame:
    """df with consecutive numbers from 1 in each group; a group of any size is numbered by many tasks."""
    numbered = number_rows(df, group, *order, name="_number")
    first = numbered.groupBy(group).agg(F.min("_number").alias("_first"))
    return numbered.join(first, numbered[group].eqNullSafe(first[group])).drop(first[group]).withColumn(name, F.col("_number") - F.col("_first") + 1).drop("_number", "_first")
