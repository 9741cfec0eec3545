"""Incident table scans (IO-1).

CSV is read with every column as a string (never ``inferSchema``) and then
typed explicitly with ``try_cast``, so a bad value becomes null instead of
failing the job, and column order in the file does not matter.  Lines with
too few or too many fields keep their whole text in ``_corrupt_record``.
``incident_id`` is the file's column of that name, or its ``id``; an id that
is no number becomes its 64-bit hash, and a file without ids gets the hash of
the whole row.
Files matching a glob are read as one table (the reference's filename
fallback becomes a path pattern).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import RAW_INCIDENT

CORRUPT = "_corrupt_record"


def _with_id(df: DataFrame) -> DataFrame:
    source = next((c for c in ("incident_id", "id") if c in df.columns), None)
    if source is None:
        return df.withColumn("incident_id", F.xxhash64(*[c for c in df.columns if c != CORRUPT]))
    text = F.trim(F.col(source).cast("string"))
    return df.withColumn("incident_id", F.coalesce(text.try_cast("long"),
                                                   F.when(text != "", F.xxhash64(text)),
                                                   F.xxhash64(*[c for c in df.columns if c != CORRUPT])))


def _typed(df: DataFrame) -> DataFrame:
    df, cols = _with_id(df), []
    for f in RAW_INCIDENT.fields:
        if f.name in df.columns:
            c = F.col(f.name)
            if f.dataType.typeName() == "boolean":
                low = F.lower(F.trim(c.cast("string")))
                c = (F.when(low.isin("true", "1", "yes"), F.lit(True))
                     .when(low.isin("false", "0", "no"), F.lit(False)))
            elif f.dataType.typeName() != "string":
                c = c.try_cast(f.dataType)
            cols.append(c.alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    extra = [c for c in df.columns if c not in {f.name for f in RAW_INCIDENT.fields}]
    return df.select(*cols, *[F.col(c) for c in extra])


def read_incidents(spark: SparkSession, path: str, fmt: str = "csv",
                   encoding: str = "utf-8") -> DataFrame:
    """Incident rows in the raw schema (plus any extra source columns)."""
    if fmt == "csv":
        reader = (spark.read.option("header", True).option("inferSchema", False)
                  .option("mode", "PERMISSIVE").option("encoding", encoding)
                  .option("columnNameOfCorruptRecord", CORRUPT).option("multiLine", False))
        names = reader.csv(path).columns
        df = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in [*names, CORRUPT]])).csv(path)
    else:
        df = spark.read.format(fmt).load(path)
    return _typed(df)
