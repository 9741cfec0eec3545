"""The composed EMA equals the sequential fold (the reference's loop)."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from roadpulse.functions.geo import with_geohash
from roadpulse.operators import ema
from roadpulse.operators.ema import apply_ema

A = 0.3


def fold(lookup, events, cells):
    lk = {k: dict(v) for k, v in lookup.items()}
    applied = {}
    for (ts, eid, lat, lon, prio, clo, dur) in sorted(events, key=lambda e: (e[0], e[1])):
        gh = cells[(lat, lon)]
        x_h = 1.0 if prio == "High" else 0.0
        if gh in lk:
            o = lk[gh]
            o["n"] += 1
            o["h"] = A * x_h + (1 - A) * o["h"]
            o["c"] = A * float(clo) + (1 - A) * o["c"]
            if dur is not None:
                o["d"] = dur if o["d"] is None else A * dur + (1 - A) * o["d"]
        else:
            lk[gh] = {"n": 1, "h": x_h, "c": float(clo), "d": dur}
        applied[gh] = applied.get(gh, 0) + 1
    return lk, applied


@pytest.mark.parametrize("busy", [10_000, 4])
def test_fold_equality(spark, monkeypatch, busy):
    """Also with nearly every second split by microsecond and ranges of ids."""
    monkeypatch.setattr(ema, "BUSY", busy)
    rnd = random.Random(5)
    base = dt.datetime(2024, 1, 1)
    spots = [(12.97, 77.59), (12.98, 77.60), (13.01, 77.51), (12.80, 77.70)]
    events = []
    for i in range(600):
        lat, lon = spots[0] if i % 3 else rnd.choice(spots)      # one hot cell
        sec = rnd.choice([0, 0, 1, 59, 3600, 3601, 86400, 200000])
        ts = base + dt.timedelta(seconds=sec, microseconds=rnd.choice([0, 5]))
        events.append((ts, i * 2999, lat, lon, rnd.choice(["High", "Low", None]),
                       rnd.choice([0, 1]), rnd.choice([None, 12.5, 40.0, 95.25])))
    ev = spark.createDataFrame(events, "event_ts timestamp, event_id long, latitude double, "
                                       "longitude double, priority string, "
                                       "requires_road_closure int, duration_minutes double")
    cells_df = with_geohash(spark.createDataFrame(spots, "latitude double, longitude double"))
    cells = {(r[0], r[1]): r[2] for r in cells_df.collect()}
    lookup = {cells[spots[0]]: {"n": 5, "h": 0.4, "c": 0.1, "d": 30.0},
              cells[spots[1]]: {"n": 2, "h": 0.5, "c": 0.5, "d": None},
              "zzzzzz": {"n": 1, "h": 1.0, "c": 0.0, "d": 10.0}}
    lk_df = spark.createDataFrame([(k, v["n"], v["h"], v["c"], v["d"]) for k, v in lookup.items()],
                                  "geohash6 string, geo_event_count long, "
                                  "geo_high_priority_rate double, geo_closure_rate double, "
                                  "geo_avg_duration double")
    want, applied = fold(lookup, events, cells)
    got = {r["geohash6"]: r for r in apply_ema(lk_df, ev).collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        g = got[k]
        assert g["geo_event_count"] == w["n"]
        assert abs(g["geo_high_priority_rate"] - w["h"]) < 1e-12
        assert abs(g["geo_closure_rate"] - w["c"]) < 1e-12
        if w["d"] is None:
            assert g["geo_avg_duration"] is None
        else:
            assert abs(g["geo_avg_duration"] - w["d"]) < 1e-9
        assert g["events_applied"] == applied.get(k, 0)
