"""Dashboard aggregates (A-11..A-16, A-18, A-20, A-21), time windows over the
prediction log (W-2..W-4) and top-k reports (T-1).

Every aggregate is a single partial/final hash aggregate.  Only small
aggregated results are ordered (cause counts, the zone total window); top-k
reports use TakeOrdered (n rows per task); pivots take the value list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import corridor_risk_label

PRIORITY_LEVELS = ["High", "Low"]


def with_start_hour(raw: DataFrame) -> DataFrame:
    """The analytics views read the raw table: parse the start time, take its hour."""
    ts = F.col("start_datetime")
    if dict(raw.dtypes)["start_datetime"] == "string":
        ts = F.try_to_timestamp(ts)
    return raw.withColumn("hour", F.hour(ts))


def overview_kpis(raw: DataFrame) -> DataFrame:
    """A-11."""
    return raw.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(F.col("event_type") == "unplanned").alias("unplanned"),
        F.count_if(F.col("priority") == "High").alias("high_priority"),
        F.count_if(F.col("requires_road_closure")).alias("road_closures"))


def cause_counts(raw: DataFrame) -> DataFrame:
    """A-12: counts of the trimmed, lower-cased cause, nulls dropped, descending."""
    c = F.lower(F.trim(F.col("event_cause")))
    return (raw.select(c.alias("cause")).filter(F.col("cause").isNotNull())
               .groupBy("cause").agg(F.count(F.lit(1)).alias("count"))
               .orderBy(F.desc("count"), F.asc("cause")))


def hourly_counts(raw: DataFrame) -> DataFrame:
    """A-13 (rows without a parseable start time are dropped)."""
    return (with_start_hour(raw).filter(F.col("hour").isNotNull())
            .groupBy("hour").agg(F.count(F.lit(1)).alias("count")))


def zone_shares(raw: DataFrame) -> DataFrame:
    """A-14: zone counts and their share of all zoned events."""
    counts = (raw.filter(F.col("zone").isNotNull()).groupBy("zone")
              .agg(F.count(F.lit(1)).alias("count")))
    # the total over a handful of zone rows is a window over the small aggregate
    return counts.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy()))


def cause_priority_counts(raw: DataFrame, normalise: bool = True) -> DataFrame:
    """A-15 (we normalise the cause; the reference grouped the raw spelling)."""
    cause = F.lower(F.trim(F.col("event_cause"))) if normalise else F.col("event_cause")
    return (raw.select(cause.alias("event_cause"), "priority")
               .filter(F.col("event_cause").isNotNull() & F.col("priority").isNotNull())
               .groupBy("event_cause", "priority").agg(F.count(F.lit(1)).alias("count")))


def cause_priority_pivot(raw: DataFrame, levels=PRIORITY_LEVELS) -> DataFrame:
    """A-16: one row per cause, one column per priority level (value list passed)."""
    cp = cause_priority_counts(raw)
    return cp.groupBy("event_cause").pivot("priority", list(levels)).agg(F.sum("count"))


def log_summary(log: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """A-18: total, last-N-hours count, mean risks as percent to 1 digit."""
    recent = F.col("timestamp") >= F.lit(as_of) - F.expr(f"INTERVAL {int(hours)} HOURS")
    pp = F.col("priority_prob").try_cast("double")
    cp = F.col("closure_prob").try_cast("double")
    return log.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(recent).alias("last_24h"),
        F.coalesce(F.bround(F.avg(pp) * 100, 1), F.lit(0.0)).alias("avg_priority_risk"),
        F.coalesce(F.bround(F.avg(cp) * 100, 1), F.lit(0.0)).alias("avg_closure_risk"))


def last_hours(log: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """W-2: rows with timestamp >= as_of - hours (as_of replaces 'now')."""
    return log.filter(F.col("timestamp") >= F.lit(as_of) - F.expr(f"INTERVAL {int(hours)} HOURS"))


def latest(log: DataFrame, n: int = 20, order_col: str = "timestamp",
           id_col: str = "prediction_id") -> DataFrame:
    """W-4: newest n rows (TakeOrdered keeps n per task, never a full sort)."""
    return log.orderBy(F.desc(order_col), F.desc(id_col)).limit(n)


def top_clusters(profiles: DataFrame, n: int = 5) -> DataFrame:
    """T-1: largest clusters, ties by id."""
    return profiles.orderBy(F.desc("event_count"), F.asc("cluster")).limit(n)


def zone_comparison(requested: DataFrame, zone_hour: DataFrame) -> DataFrame:
    """A-20: per requested zone, events over all hours and the busiest hour's count."""
    per_zone = zone_hour.groupBy("zone").agg(
        F.sum("zone_hour_event_count").alias("total_events"),
        F.max("zone_hour_event_count").alias("peak_hour_events"))
    return (requested.join(per_zone, "zone", "left")
            .withColumns({"total_events": F.coalesce(F.col("total_events"), F.lit(0)),
                          "peak_hour_events": F.coalesce(F.col("peak_hour_events"), F.lit(0))}))


def corridor_comparison(requested: DataFrame, corridor: DataFrame) -> DataFrame:
    """A-21: requested canonical corridors -> rate + label; unknown kept as 'not found'."""
    keyed = requested.withColumn("_key", F.lower(F.trim(F.col("corridor"))))
    lk = corridor.select(F.col("corridor").alias("_key"), "corridor_risk_score")
    j = keyed.join(lk, "_key", "left").drop("_key")
    return j.withColumn("risk_level", F.when(F.col("corridor_risk_score").isNull(), "not found")
                        .otherwise(corridor_risk_label(F.col("corridor_risk_score"))))
