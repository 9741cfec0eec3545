"""Distributed dense numbering (0..n-1 in key order) without a single-task window.

Rows are range-partitioned and sorted by the key; each partition's rows get
consecutive positions from ``monotonically_increasing_id`` (partition index
in the upper bits); the partition sizes -- one small row per partition --
give the offsets.  Only that per-partition table is ordered globally.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dense_index(df: DataFrame, key: str, name: str = "index",
                partitions: int | None = None) -> DataFrame:
    """Distinct ``key`` values numbered 0.. in ascending order."""
    keys = df.select(key).distinct()
    n = partitions or keys.sparkSession.sparkContext.defaultParallelism
    ranged = (keys.repartitionByRange(n, key).sortWithinPartitions(key)
              .withColumns({"_p": F.spark_partition_id(),
                            "_m": F.monotonically_increasing_id()}))
    ranged = ranged.checkpoint()  # pin the ids: they depend on partitioning
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_m0"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return (ranged.join(offsets.select("_p", "_off", "_m0"), "_p")
            .select(key, (F.col("_off") + F.col("_m") - F.col("_m0")).cast("int").alias(name)))


def sums_below(df: DataFrame, key: str, columns: list[str], ascending: bool = True) -> DataFrame:
    """``df`` (one row per ``key``) with ``<column>_below``: its sum over all earlier keys.

    Rows are range-partitioned on the key; a task sums its own range, and one
    row per task carries the sums of the ranges before it.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.asc(key) if ascending else F.desc(key)
    ranged = (df.repartitionByRange(n, order).withColumn("_task", F.spark_partition_id())
              .checkpoint())  # pins which range a row is in
    totals = ranged.groupBy("_task").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_task", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}")
                                      for c in columns])
    inside = Window.partitionBy("_task").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (ranged.withColumns({f"{c}_below": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in columns})
            .join(totals, "_task")
            .withColumns({f"{c}_below": F.col(f"{c}_below") + F.col(f"_{c}") for c in columns})
            .drop("_task", *[f"_{c}" for c in columns]))
