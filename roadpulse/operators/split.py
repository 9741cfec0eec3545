"""Deterministic train/test assignment (M-1) and bounded seeded samples (M-22).

The split is a hash bucket on the row id: no shuffle, no global sort, the
same row always lands in the same slice, and DuckDB can reproduce it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_bucket(id_col: Column, seed: int = 42, buckets: int = 1000) -> Column:
    """md5(id#seed) -> first 32 bits -> bucket in [0, buckets)."""
    key = F.concat(id_col.cast("string"), F.lit(f"#{seed}"))
    h = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")
    return h % buckets


def assign_split(df: DataFrame, id_col: str = "incident_id", test_fraction: float = 0.2,
                 seed: int = 42, name: str = "split") -> DataFrame:
    cut = int(round(test_fraction * 1000))
    known = F.when(F.col(id_col).isNull(), F.raise_error(F.lit(f"{id_col} is null: a row without id has no slice"))
                   .cast("string")).otherwise(F.col(id_col).cast("string"))
    b = hash_bucket(known, seed)
    return df.withColumn(name, F.when(b < cut, "test").otherwise("train"))


def fold_column(df: DataFrame, id_col: str = "incident_id", k: int = 5, seed: int = 7,
                name: str = "fold") -> DataFrame:
    """K-fold id for CrossValidator(foldCol=...); deterministic per row."""
    return df.withColumn(name, (hash_bucket(F.col(id_col), seed) % k).cast("int"))


def seeded_sample(df: DataFrame, n: int = 200, id_col: str = "incident_id",
                  seed: int = 42) -> DataFrame:
    """M-22: repeatable bounded sample; TakeOrdered keeps only n rows per task."""
    key = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"#{seed}")))
    return df.orderBy(key, F.col(id_col)).limit(n)
