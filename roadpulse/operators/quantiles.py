"""Exact interpolated percentiles without gathering the values in one task.

The distinct values are counted (a combinable aggregate), ranges of them get
their running count, and only the rows that hold an asked rank reach the
driver: at most two for each percentile.  Nulls and NaN are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .ordering import sums_below


def percentiles_of(df: DataFrame, columns: list[str], probabilities: list[float]) -> dict[str, list[float | None]]:
    """Linearly interpolated percentiles of several columns in one pass; None when a column has no values."""
    checkpoint_dir(df.sparkSession)
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns])
    counted = (df.select(F.explode(pairs).alias("k")).where(F.col("k.v").isNotNull() & ~F.isnan("k.v"))
               .groupBy("k").agg(F.count(F.lit(1)).alias("n")))
    run = sums_below(counted, "k", ["n"]).checkpoint()
    spans = {r["c"]: r for r in run.groupBy(F.col("k.c").alias("c"))
             .agg(F.sum("n").alias("n"), F.min("n_below").alias("first")).collect()}  # one row per column
    places = {c: [p * (s["n"] - 1) for p in probabilities] for c, s in spans.items()}
    wanted = F.lit(False)
    for c, s in spans.items():
        for rank in sorted({r for x in places[c] for r in (math.floor(x), math.ceil(x))}):
            at = F.lit(s["first"] + rank)
            wanted = wanted | ((F.col("n_below") <= at) & (at < F.col("n_below") + F.col("n")))
    rows = run.where(wanted).select("k.c", "k.v", "n", "n_below").collect()

    def at(c: str, rank: int) -> float:
        rank += spans[c]["first"]
        return next(r["v"] for r in rows if r["n_below"] <= rank < r["n_below"] + r["n"])

    def between(c: str, x: float) -> float:
        low = at(c, math.floor(x))
        return low + (x - math.floor(x)) * (at(c, math.ceil(x)) - low)
    return {c: [between(c, x) for x in places[c]] if c in spans else [None] * len(probabilities) for c in columns}


def percentiles(df: DataFrame, column: str, probabilities: list[float]) -> list[float | None]:
    """Linearly interpolated percentiles of one column; None when it has no values."""
    return percentiles_of(df, [column], probabilities)[column]
