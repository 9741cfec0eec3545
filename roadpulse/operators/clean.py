"""Cleaning and feature derivation over raw incident rows (P-*, S-1..S-8).

One function, ``prepare_incidents``, is shared by training and scoring so
both see identical keys (the reference lower-cases corridors only when
training; here every path normalises them).  All steps are narrow
projections/filters: no shuffle, and Catalyst pushes the box filter below
the derived columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import temporal as tf
from ..functions.geo import with_geohash
from ..schema import DROP_COLS

# Cause synonyms applied after trim + lower-case, and the
# test-row marker.
CAUSE_SYNONYMS = {"fog / low visibility": "fog_low_visibility"}
TEST_CAUSE = "test_demo"
# The city bounding box (inclusive).
LAT_MIN, LAT_MAX = 12.75, 13.30
LON_MIN, LON_MAX = 77.25, 77.85
MAX_DURATION_MIN = 24 * 60 * 7
TIMESTAMP_COLS = ["start_datetime", "end_datetime", "closed_datetime", "created_date"]


def normalise_cause(c: Column) -> Column:
    """P-2: trim, lower-case, synonym map."""
    x = F.lower(F.trim(c))
    for src, dst in CAUSE_SYNONYMS.items():
        x = F.when(x == src, F.lit(dst)).otherwise(x)
    return x


def normalise_key(c: Column) -> Column:
    """P-9: corridor key normalisation."""
    return F.lower(F.trim(c))


def parse_timestamp(c: Column) -> Column:
    """P-4: string -> timestamp, null when unparseable."""
    return F.try_to_timestamp(c)


def drop_if_present(df: DataFrame, cols=DROP_COLS) -> DataFrame:
    """P-1."""
    return df.drop(*cols)


def remove_test_rows(df: DataFrame, keep_test_rows: bool = False) -> DataFrame:
    """P-3: drop rows whose cause is the test marker; null causes stay."""
    if keep_test_rows:
        return df
    return df.filter(~F.col("event_cause").eqNullSafe(TEST_CAUSE))


def derive_duration(df: DataFrame) -> DataFrame:
    """P-5: closed - start, else end - start (only when closed is missing)."""
    st, cl, en = F.col("start_datetime"), F.col("closed_datetime"), F.col("end_datetime")

    def minutes(a):
        return (F.unix_micros(a) - F.unix_micros(st)) / F.lit(60_000_000.0)

    dur = (F.when(cl.isNotNull() & st.isNotNull(), minutes(cl))
           .when(en.isNotNull() & st.isNotNull(), minutes(en)))
    return df.withColumn("duration_minutes", dur)


def valid_duration(df: DataFrame) -> DataFrame:
    """P-6: keep null durations and those in the open interval (0, one week)."""
    d = F.col("duration_minutes")
    return df.filter(d.isNull() | ((d > 0) & (d < MAX_DURATION_MIN)))


def in_box(lat: Column, lon: Column) -> Column:
    """P-7 predicate: inclusive box; null coordinates fail."""
    return (F.coalesce(lat.between(LAT_MIN, LAT_MAX), F.lit(False))
            & F.coalesce(lon.between(LON_MIN, LON_MAX), F.lit(False)))


def add_time_features(df: DataFrame, ts_col: str = "start_datetime") -> DataFrame:
    """S-1, S-2, S-3, S-5 from the raw timestamp; bins/cyclics use the raw hour."""
    ts = F.col(ts_col)
    hour, dow, month = F.hour(ts), F.weekday(ts), F.month(ts)
    hs, hc = tf.cyclic(hour, 24)
    ms, mc = tf.cyclic(month, 12)
    ds, dc = tf.cyclic(dow, 7)
    return df.withColumns({
        "hour": hour, "day_of_week": dow, "month": month,
        "is_weekend": tf.is_weekend(dow), "is_peak_hour": tf.is_peak(hour),
        "time_of_day": tf.time_of_day(hour),
        "hour_sin": hs, "hour_cos": hc, "month_sin": ms, "month_cos": mc,
        "dow_sin": ds, "dow_cos": dc,
    })


def constant_fills(df: DataFrame) -> DataFrame:
    """P-10: deterministic fills applied before the split."""
    return df.withColumns({
        "junction": F.coalesce(F.col("junction"), F.lit("unknown_junction")),
        "hour": F.coalesce(F.col("hour"), F.lit(12)),
        "day_of_week": F.coalesce(F.col("day_of_week"), F.lit(0)),
        "month": F.coalesce(F.col("month"), F.lit(1)),
        "is_weekend": F.coalesce(F.col("is_weekend"), F.lit(0)),
        "is_peak_hour": F.coalesce(F.col("is_peak_hour"), F.lit(0)),
    })


def add_targets(df: DataFrame) -> DataFrame:
    """S-8 binary targets and S-4 time-of-day dummies."""
    return df.withColumns({
        "priority_binary": F.col("priority").eqNullSafe("High").cast("int"),
        "road_closure_binary": F.col("requires_road_closure").cast("int"),
        "is_planned": F.col("event_type").eqNullSafe("planned").cast("int"),
        **tf.time_dummies(F.col("time_of_day")),
    })


def prepare_incidents(raw: DataFrame, keep_test_rows: bool = False,
                      precision: int = 6) -> DataFrame:
    """Raw incident rows -> cleaned, featured rows inside the city box."""
    df = drop_if_present(raw)
    df = df.withColumn("event_cause", normalise_cause(F.col("event_cause")))
    df = remove_test_rows(df, keep_test_rows)
    df = df.withColumns({c: parse_timestamp(F.col(c)) for c in TIMESTAMP_COLS
                         if c in df.columns and dict(df.dtypes)[c] == "string"})
    df = valid_duration(derive_duration(df))
    df = add_time_features(df)
    df = df.withColumn("corridor", normalise_key(F.col("corridor")))
    df = df.filter(in_box(F.col("latitude"), F.col("longitude")))
    df = with_geohash(df, "latitude", "longitude", "geohash6", precision)
    df = constant_fills(df)
    return add_targets(df)


# ---- request-side checks and matrix helpers --------------------------------

# Accepted input domains of a scoring request.
REQUEST_DOMAINS = {
    "latitude": (LAT_MIN, LAT_MAX), "longitude": (LON_MIN, LON_MAX),
    "hour": (0, 23), "day_of_week": (0, 6), "month": (1, 12),
}


def quarantine_split(df: DataFrame, extra: dict[str, tuple] | None = None
                     ) -> tuple[DataFrame, DataFrame]:
    """P-8: (valid, quarantined) with an array of failure reasons."""
    domains = dict(REQUEST_DOMAINS, **(extra or {}))
    reasons = [F.when(~F.coalesce(F.col(c).between(lo, hi), F.lit(False)),
                      F.lit(f"{c}_out_of_range")) for c, (lo, hi) in domains.items()
               if c in df.columns]
    tagged = df.withColumn("reject_reasons", F.array_compact(F.array(*reasons)))
    ok = F.size("reject_reasons") == 0
    return tagged.filter(ok).drop("reject_reasons"), tagged.filter(~ok)


def align_features(df: DataFrame, features: list[str], keep: list[str] = ()) -> DataFrame:
    """P-11: select the feature list, zero-filling absent columns."""
    have = set(df.columns)
    cols = [F.col(c) for c in keep]
    cols += [F.col(c) if c in have else F.lit(0).alias(c) for c in features]
    return df.select(*cols)


def feature_matrix(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """P-12: booleans -> int, remaining numeric nulls -> 0, string nulls -> '0'."""
    types = dict(df.dtypes)
    out = {}
    for c in numeric:
        col = F.col(c).cast("int") if types.get(c) == "boolean" else F.col(c)
        out[c] = F.coalesce(col.cast("double"), F.lit(0.0))
    for c in categorical:
        out[c] = F.coalesce(F.col(c).cast("string"), F.lit("0"))
    return df.withColumns(out)


def clustered_only(df: DataFrame, label: str = "cluster") -> DataFrame:
    """P-14: keep clustered points (label >= 0); NaN labels are null."""
    lab = F.col(label)
    return df.filter(F.coalesce(lab >= 0, F.lit(False)))
