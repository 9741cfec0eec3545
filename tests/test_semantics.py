"""Null and edge semantics on small hand-made frames."""
from pyspark.sql import functions as F

from roadpulse.operators import clean, lookups as lk
from roadpulse.operators.preprocess import CategoricalImputer, IQRCapper
from roadpulse.schema import RAW_INCIDENT


def raw(spark, rows):
    base = dict(incident_id=1, event_type="unplanned", event_cause="accident", veh_type="car",
                zone="Z1", corridor="Road 1", police_station="PS", junction=None,
                priority="High", requires_road_closure=False, latitude=12.9, longitude=77.5,
                start_datetime="2024-01-01 10:00:00", end_datetime=None, closed_datetime=None,
                created_date=None)
    out = []
    for i, r in enumerate(rows):
        d = dict(base, incident_id=i + 1, **r)
        out.append(tuple(d[f.name] for f in RAW_INCIDENT.fields))
    return spark.createDataFrame(out, RAW_INCIDENT)


def test_test_rows_dropped_null_cause_kept(spark):
    df = raw(spark, [{"event_cause": " TEST_DEMO"}, {"event_cause": None},
                     {"event_cause": "Fog / Low Visibility"}])
    got = clean.prepare_incidents(df).select("incident_id", "event_cause").collect()
    assert sorted((r[0], r[1]) for r in got) == [(2, None), (3, "fog_low_visibility")]


def test_duration_closed_first_negative_not_retried(spark):
    df = raw(spark, [
        {"closed_datetime": "2024-01-01 10:30:00", "end_datetime": "2024-01-01 12:00:00"},
        {"closed_datetime": "2024-01-01 09:00:00", "end_datetime": "2024-01-01 12:00:00"},
        {"end_datetime": "2024-01-01 11:00:00"},
        {"end_datetime": "2024-01-09 11:00:00"},
        {"closed_datetime": "not a time"},
    ])
    got = dict(clean.prepare_incidents(df).select("incident_id", "duration_minutes").collect())
    assert got == {1: 30.0, 3: 60.0, 5: None}


def test_time_features(spark):
    df = raw(spark, [{"start_datetime": "2024-01-01 05:00:00"},   # Monday, hour 5
                     {"start_datetime": "2024-01-06 17:00:00"},   # Saturday
                     {"start_datetime": "garbage"}])
    rows = {r["incident_id"]: r for r in clean.prepare_incidents(df).collect()}
    assert rows[1]["day_of_week"] == 0 and rows[1]["time_of_day"] == "night"
    assert rows[2]["is_weekend"] == 1 and rows[2]["is_peak_hour"] == 1
    assert rows[2]["time_of_day"] == "evening" and rows[2]["time_of_day_evening"] == 1
    # null start: hour filled with 12, bins and cyclics stay null
    assert rows[3]["hour"] == 12 and rows[3]["time_of_day"] is None
    assert rows[3]["hour_sin"] is None and rows[3]["is_peak_hour"] == 0


def test_box_inclusive_and_nulls_dropped(spark):
    df = raw(spark, [{"latitude": 12.75, "longitude": 77.85}, {"latitude": None},
                     {"latitude": 13.31}])
    assert [r[0] for r in clean.prepare_incidents(df).select("incident_id").collect()] == [1]


def test_null_priority_counts_as_not_high(spark):
    df = raw(spark, [{"priority": None}, {"priority": "High"}])
    p = clean.prepare_incidents(df).withColumn("geohash6", F.lit("x"))
    row = lk.geo_stats(p).first()
    assert row["geo_high_priority_rate"] == 0.5


def test_count_of_cause_not_rows(spark):
    df = raw(spark, [{"event_cause": None}, {"event_cause": "accident"}])
    p = clean.prepare_incidents(df).withColumn("geohash6", F.lit("x"))
    assert lk.geo_stats(p).first()["geo_event_count"] == 1


def test_mode_ties_smallest_and_all_null(spark):
    df = spark.createDataFrame([("b", None), ("a", None), ("b", None), ("a", None)],
                               "zone string, veh_type string")
    m = CategoricalImputer(mode_cols=["zone", "veh_type"]).fit(df)
    assert m.modes == {"zone": "a"}


def test_iqr_capper_keeps_null(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4, 100]] + [(None,)],
                               "duration_minutes double")
    m = IQRCapper().fit(df)
    assert (m.lower, m.upper) == (-1.0, 7.0)   # Q1=2, Q3=4 (linear interpolation)
    out = [r[0] for r in m.transform(df).collect()]
    assert out == [1.0, 2.0, 3.0, 4.0, 7.0, None]


def test_corridor_normalised_before_grouping(spark):
    df = raw(spark, [{"corridor": "Road 1"}, {"corridor": " ROAD 1 "}])
    c = lk.corridor_risk(clean.prepare_incidents(df))
    assert c.count() == 1


def test_quarantine_reasons(spark):
    df = spark.createDataFrame([(1, 12.9, 77.5, 10, 2, 5), (2, 50.0, 77.5, 25, 2, 5),
                                (3, None, 77.5, 1, 7, 0)],
                               "request_id long, latitude double, longitude double, hour int, "
                               "day_of_week int, month int")
    ok, bad = clean.quarantine_split(df)
    assert [r[0] for r in ok.collect()] == [1]
    reasons = {r[0]: r[1] for r in bad.select("request_id", "reject_reasons").collect()}
    assert reasons[2] == ["latitude_out_of_range", "hour_out_of_range"]
    assert reasons[3] == ["latitude_out_of_range", "day_of_week_out_of_range",
                          "month_out_of_range"]


def test_empty_input(spark):
    df = spark.createDataFrame([], RAW_INCIDENT)
    p = clean.prepare_incidents(df)
    assert p.count() == 0
    assert lk.geo_stats(p).count() == 0


def test_align_features_zero_fills(spark):
    df = spark.createDataFrame([(1, 2.0)], "id long, a double")
    out = clean.align_features(df, ["a", "b"], keep=["id"]).first()
    assert (out["a"], out["b"]) == (2.0, 0)


def test_lookup_joins_keep_row_count(spark):
    df = raw(spark, [{"corridor": "Road 1"}, {"corridor": " ROAD 1 "}, {"zone": None}])
    p = clean.prepare_incidents(df)
    out = lk.join_lookups(p, lk.Lookups.fit(p))
    assert out.count() == p.count()


def test_percentiles_equal_numpy(spark):
    import random

    import numpy as np

    from roadpulse.operators.quantiles import percentiles
    rnd = random.Random(9)
    values = [rnd.choice([rnd.uniform(0, 500), 7.0, 7.0]) for _ in range(3001)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    assert np.allclose(percentiles(df, "v", probs), np.quantile(values, probs))
    assert percentiles(df.limit(0), "v", [0.5]) == [None]
    assert percentiles(spark.createDataFrame([(3.0,)], "v double"), "v", [0.25, 0.5]) == [3.0, 3.0]
