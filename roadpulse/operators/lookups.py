"""Historical-rate lookup tables (A-1..A-10) and their joins (J-1..J-8).

Lookups are built from the training slice only.  Each is one partial
(map-side) aggregate on its key; null keys are filtered first (the
reference's group-by drops them).  Joins are left equi-joins.  A
lookup whose counted rows stay within ``BROADCAST_ROWS`` is broadcast, so fact
rows are not shuffled for it.  A larger one is joined by its key, with the keys
that hold many fact rows (found by a frequency sketch) spread over ``SALTS``
copies of their lookup row, so that no task gathers a hot cell.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import percentiles_of

def _high():
    return F.col("priority").eqNullSafe("High").cast("int")

LOOKUP_VALUE_COLS = [
    "geo_event_count", "geo_high_priority_rate", "geo_closure_rate", "geo_avg_duration",
    "zone_hour_event_count", "corridor_risk_score", "cause_closure_rate",
    "cause_avg_duration",
]
MEDIAN_COLS = LOOKUP_VALUE_COLS + ["cause_zone_closure"]
#: Columns of the training slice that the lookups and their joins read.
INPUT_COLUMNS = ["geohash6", "zone", "hour", "corridor", "event_cause", "priority", "requires_road_closure",
                 "duration_minutes", "road_closure_binary"]
HIGH_RISK_RATE = 0.3


def _nonnull(df: DataFrame, *keys: str) -> DataFrame:
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return df.filter(cond)


def geo_stats(train: DataFrame) -> DataFrame:
    """A-1: per-cell count of causes, high rate, closure rate, mean duration."""
    return (_nonnull(train, "geohash6").groupBy("geohash6").agg(
        F.count("event_cause").alias("geo_event_count"),
        F.avg(_high()).alias("geo_high_priority_rate"),
        F.avg(F.col("requires_road_closure").cast("int")).alias("geo_closure_rate"),
        F.avg("duration_minutes").alias("geo_avg_duration")))


def zone_hour_counts(train: DataFrame) -> DataFrame:
    """A-2."""
    return (_nonnull(train, "zone", "hour").groupBy("zone", "hour")
            .agg(F.count(F.lit(1)).alias("zone_hour_event_count")))


def corridor_risk(train: DataFrame) -> DataFrame:
    """A-3: corridor high-priority rate on the normalised key."""
    return (_nonnull(train, "corridor").groupBy("corridor")
            .agg(F.avg(_high()).alias("corridor_risk_score")))


def cause_stats(train: DataFrame) -> DataFrame:
    """A-4 + A-5: cause closure rate and mean duration (before IQR capping)."""
    return (_nonnull(train, "event_cause").groupBy("event_cause").agg(
        F.avg("road_closure_binary").alias("cause_closure_rate"),
        F.avg("duration_minutes").alias("cause_avg_duration")))


def cause_zone_closure(train: DataFrame) -> DataFrame:
    """A-6."""
    return (_nonnull(train, "event_cause", "zone").groupBy("event_cause", "zone")
            .agg(F.avg("road_closure_binary").alias("cause_zone_closure")))


def high_risk_causes(causes: DataFrame, rate: float = HIGH_RISK_RATE) -> DataFrame:
    """A-10: causes whose closure rate is at least ``rate``."""
    return causes.filter(F.col("cause_closure_rate") >= rate).select("event_cause")


@dataclass
class Lookups:
    cell: DataFrame
    zone_hour: DataFrame
    corridor: DataFrame
    cause: DataFrame
    cause_zone: DataFrame
    high_risk: DataFrame
    rows: dict[str, int] = field(default_factory=dict)  # counted rows of the stored tables

    def counted(self) -> "Lookups":
        """The same with its tables counted; they should be stored."""
        return replace(self, rows={k: t.count() for k, t in self.items()})

    @classmethod
    def fit(cls, train: DataFrame) -> "Lookups":
        causes = cause_stats(train)
        return cls(geo_stats(train), zone_hour_counts(train), corridor_risk(train),
                   causes, cause_zone_closure(train), high_risk_causes(causes))

    def items(self):
        return {"cell": self.cell, "zone_hour": self.zone_hour, "corridor": self.corridor,
                "cause": self.cause, "cause_zone": self.cause_zone,
                "high_risk": self.high_risk}.items()


BROADCAST_ROWS = 200_000
HEAVY = 0.01  # share of the fact rows from which a key counts as heavy
SALTS = 32


def salted_join(df: DataFrame, lookup: DataFrame, key: str, heavy: list) -> DataFrame:
    """Left join in which each heavy key's rows go to ``SALTS`` tasks."""
    is_heavy = F.coalesce(F.col(key).isin(heavy), F.lit(False)) if heavy else F.lit(False)
    salt = F.when(is_heavy, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS))).otherwise(F.lit(0))
    copies = F.when(is_heavy, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return (df.withColumn("_salt", salt.cast("long"))
            .join(lookup.withColumn("_salt", F.explode(copies)), [key, "_salt"], "left").drop("_salt"))


def heavy_keys(df: DataFrame, key: str, share: float = HEAVY) -> list:
    """All keys that hold at least ``share`` of the rows, and perhaps some lighter ones."""
    return [k for k in df.select(key).stat.freqItems([key], share).first()[0] if k is not None]


def _joined(df: DataFrame, lk: Lookups, name: str, keys: list[str]) -> DataFrame:
    table, rows = getattr(lk, name), lk.rows.get(name)
    if rows is not None and rows <= BROADCAST_ROWS:
        return df.join(F.broadcast(table), keys, "left")
    if rows is not None and len(keys) == 1:
        return salted_join(df, table, keys[0], heavy_keys(df, keys[0]))
    return df.join(table, keys, "left")


def join_lookups(df: DataFrame, lk: Lookups) -> DataFrame:
    """J-1..J-5 (+J-6 raw): left joins; row count never changes (keys unique)."""
    for name, keys in (("cell", ["geohash6"]), ("zone_hour", ["zone", "hour"]), ("corridor", ["corridor"]),
                       ("cause", ["event_cause"]), ("cause_zone", ["event_cause", "zone"])):
        df = _joined(df, lk, name, keys)
    return df


def median_table(joined_train: DataFrame) -> DataFrame:
    """A-7: row-weighted interpolated medians of the joined training rows (one row)."""
    values = {c: v[0] for c, v in percentiles_of(joined_train, MEDIAN_COLS, [0.5]).items()}
    return joined_train.sparkSession.range(1).select(
        *[F.lit(v).cast("double").alias(c) for c, v in values.items()])


def fill_with(df: DataFrame, values: dict[str, float]) -> DataFrame:
    """Median fallback for unseen keys (scalars collected from ``median_table``)."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()
                           if c in df.columns})


def add_interactions(df: DataFrame) -> DataFrame:
    """S-9 interaction features (after median fills)."""
    return df.withColumns({
        "geo_closure_x_peak": F.col("geo_closure_rate") * F.col("is_peak_hour"),
        "geo_event_density": F.col("geo_event_count") / (F.col("zone_hour_event_count") + 1),
        "duration_x_closure_risk": F.col("cause_avg_duration") * F.col("cause_closure_rate"),
        "log_geo_event_count": F.log1p(F.col("geo_event_count")),
    })


def flag_high_risk(df: DataFrame, high_risk: DataFrame) -> DataFrame:
    """J-8: membership flag via left join on the distinct cause set."""
    hr = high_risk.select("event_cause").distinct().withColumn("_hr", F.lit(1))
    return (df.join(hr, "event_cause", "left")
              .withColumn("is_high_risk_cause", F.coalesce(F.col("_hr"), F.lit(0)))
              .drop("_hr"))
