"""Helpers shared by the training-data operators.

``stored`` cuts lineage with a parquet table in the shared folder, so a lost
executor never forces a recomputation of what came before.  ``positions``
numbers rows without a single-task window.  ``components`` finds connected
components by alternating star contraction.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    return shared_path(spark, f"llm/{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def positions(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: the row's place from 0 within ``group`` in ``order``.

    Rows are range-partitioned on group and order, so one large group spreads
    over many tasks; a small table with one row per task and group carries
    the offsets.  Rows equal in all of ``order`` are numbered in any order.
    """
    keys = [*group, *order]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(
        df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
        .withColumns({"_task": F.spark_partition_id(),
                      "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}),
        "positions")
    runs = (ranged.groupBy("_task", *group)
            .agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")))
    before = Window.partitionBy(*group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    runs = (runs.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first"))
            .drop("_n", "_first")
            .withColumnsRenamed({c: f"_g{i}" for i, c in enumerate(group)}))
    same = F.col("_task") == F.col("_t2")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return (ranged.join(runs.withColumnRenamed("_task", "_t2"), same)
            .select(*df.columns, (F.col("_at") + F.col("_base")).alias(name)))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of undirected ``edges`` (a, b), root smallest.

    Large-star and small-star steps alternate until the edge set no longer
    changes; each round is written to the shared folder.  A node's minimum is
    a combinable aggregate, so no task gathers a node's neighbours.
    """
    now = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(), "edges")
    seen = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(least, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = (joined.select("u", F.col("m").alias("v"))
                 .union(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
                 .distinct())
        now = stored(small, "edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.select("v", "v").distinct())
        seen = state
