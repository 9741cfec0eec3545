"""Explicit schemas (never inferred) for incidents, the prediction log and lookups."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, I, L, B, TS = (T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(),
                     T.BooleanType(), T.TimestampType())

RAW_INCIDENT = T.StructType([
    T.StructField("incident_id", L),
    T.StructField("event_type", S),
    T.StructField("event_cause", S),
    T.StructField("veh_type", S),
    T.StructField("zone", S),
    T.StructField("corridor", S),
    T.StructField("police_station", S),
    T.StructField("junction", S),
    T.StructField("priority", S),
    T.StructField("requires_road_closure", B),
    T.StructField("latitude", D),
    T.StructField("longitude", D),
    T.StructField("start_datetime", S),
    T.StructField("end_datetime", S),
    T.StructField("closed_datetime", S),
    T.StructField("created_date", S),
])

# The 25 source columns the cleaning step drops when present.
DROP_COLS = [
    "comment", "map_file", "meta_data", "direction",
    "resolved_at_address", "resolved_at_latitude", "resolved_at_longitude",
    "resolved_by_id", "resolved_datetime", "assigned_to_police_id",
    "citizen_accident_id", "route_path", "age_of_truck",
    "reason_breakdown", "cargo_material", "id", "created_by_id",
    "last_modified_by_id", "closed_by_id", "kgid", "gba_identifier",
    "client_id", "veh_no", "authenticated", "modified_datetime",
]

PREDICTION_LOG = T.StructType([
    T.StructField("prediction_id", L),
    T.StructField("timestamp", TS),
    T.StructField("latitude", D),
    T.StructField("longitude", D),
    T.StructField("hour", I),
    T.StructField("day_of_week", I),
    T.StructField("month", I),
    T.StructField("event_cause", S),
    T.StructField("zone", S),
    T.StructField("corridor", S),
    T.StructField("priority_prob", D),
    T.StructField("closure_prob", D),
    T.StructField("duration_est_min", D),
    T.StructField("manpower_level", S),
    T.StructField("barricading_level", S),
    T.StructField("diversion_level", S),
    T.StructField("actual_priority", S),
    T.StructField("actual_closure", I),
    T.StructField("actual_duration_min", D),
    T.StructField("feedback_correct", B),
])

SCORING_REQUEST = T.StructType([
    T.StructField("request_id", L),
    T.StructField("latitude", D),
    T.StructField("longitude", D),
    T.StructField("hour", I),
    T.StructField("day_of_week", I),
    T.StructField("month", I),
    T.StructField("event_cause", S),
    T.StructField("event_type", S),
    T.StructField("veh_type", S),
    T.StructField("zone", S),
    T.StructField("corridor", S),
    T.StructField("police_station", S),
])

LABELLED_EVENT = T.StructType([
    T.StructField("event_id", L),
    T.StructField("event_ts", TS),
    T.StructField("latitude", D),
    T.StructField("longitude", D),
    T.StructField("hour", I),
    T.StructField("event_cause", S),
    T.StructField("zone", S),
    T.StructField("corridor", S),
    T.StructField("priority", S),
    T.StructField("requires_road_closure", I),
    T.StructField("duration_minutes", D),
])

CELL_LOOKUP = T.StructType([
    T.StructField("geohash6", S),
    T.StructField("geo_event_count", L),
    T.StructField("geo_high_priority_rate", D),
    T.StructField("geo_closure_rate", D),
    T.StructField("geo_avg_duration", D),
])
