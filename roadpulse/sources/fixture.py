"""Incident-shaped input derived from the driver's ``events`` table.

The reference ships no data, so the raw incident table (schema of
``schema.RAW_INCIDENT``) is derived row by row from ``events``.  The
derivation only shapes rows into that schema -- dirty spellings, test rows,
bad coordinates and timestamps as *strings* -- and does none of the
cleaning, feature or aggregation work, which the operators perform on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

# Names that the message parser knows, so that messages and incidents speak of the same places.
ZONES = ["Central Zone 1", "Central Zone 2", "East Zone 1", "East Zone 2", "North Zone 1", "North Zone 2", "South Zone 1",
         "South Zone 2", "West Zone 1", "West Zone 2"]
CORRIDORS = ["Mysore Road", "Bellary Road 1", "Bellary Road 2", "Tumkur Road", "Hosur Road", "ORR North 1", "ORR East 1",
             "Old Madras Road", "Ring Road"]

TS_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _fmt(ts):
    return F.date_format(ts, TS_FORMAT)


def incidents_from_events(events: DataFrame, keep: tuple = ()) -> DataFrame:
    """Raw incident rows; ``keep`` passes source columns through unchanged."""
    e, u, v = F.col("event_id"), F.col("user_id"), F.col("value")
    ts = F.col("ts").cast("timestamp")
    et = F.col("event_type")
    cause = (F.when(e % 101 == 0, F.lit("test_demo"))
             .when(e % 103 == 1, F.lit("Fog / Low Visibility"))
             .when(e % 3 == 0, F.concat(F.lit(" "), F.upper(et)))
             .otherwise(et))
    named = lambda names: F.element_at(F.array(*[F.lit(n) for n in names]), (u % len(names) + 1).cast("int"))
    corridor = (F.when(u % 4 == 0, F.lit("Non-corridor"))
                .when(e % 2 == 0, named(CORRIDORS))
                .otherwise(F.concat(F.upper(named(CORRIDORS)), F.lit(" "))))
    serious = F.when(u % 3 == 0, 8.0).when(u % 3 == 1, 35.0).otherwise(80.0)
    lat = (F.when(e % 97 == 0, F.lit(0.0))
           .when(e % 10 == 9, F.lit(12.75) + ((e * 7919) % 5500) / F.lit(10000.0))
           .otherwise(F.lit(12.8) + ((u % 15) * 300 + (e * 7919) % 81 - 40) / F.lit(10000.0)))
    lon = (F.when(e % 89 == 0, F.lit(None).cast("double"))
           .when(e % 10 == 9, F.lit(77.25) + ((e * 104729) % 6000) / F.lit(10000.0))
           .otherwise(F.lit(77.3) + ((F.floor(u / 15) % 10) * 500 + (e * 104729) % 81 - 40)
                      / F.lit(10000.0)))
    closed = F.when(e % 10 < 4, F.timestamp_micros(
        F.unix_micros(ts) + (F.floor(v * 60) - 30) * 1000000))
    ended = F.when(e % 10 < 6, F.timestamp_micros(
        F.unix_micros(ts) + F.floor(v * 120) * 1000000))
    return events.select(
        e.alias("incident_id"),
        F.when(e % 5 == 0, "planned").otherwise("unplanned").alias("event_type"),
        cause.alias("event_cause"),
        F.when(e % 11 != 0, F.concat(F.lit("veh_"), (e % 7).cast("string"))).alias("veh_type"),
        F.when(e % 50 != 7, named(ZONES)).alias("zone"),
        corridor.alias("corridor"),
        F.concat(F.lit("PS "), (u % 20).cast("string")).alias("police_station"),
        F.when(e % 3 != 0, F.concat(F.lit("J"), (e % 40).cast("string"))).alias("junction"),
        F.when(e % 200 != 13, F.when(v > serious, "High").otherwise("Low")).alias("priority"),
        ((et == "error") | (e % 37 == 0)).alias("requires_road_closure"),
        lat.alias("latitude"),
        lon.alias("longitude"),
        _fmt(ts).alias("start_datetime"),
        _fmt(ended).alias("end_datetime"),
        _fmt(closed).alias("closed_datetime"),
        _fmt(ts).alias("created_date"),
        *[F.col(k).alias(f"src_{k}") for k in keep],
    )


def incident_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents_from_events(read_table(spark, sf_dir, "events"))
