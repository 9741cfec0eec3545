"""Cases in which a cap, a prefix or rounding would change the answer."""

import datetime as dt

from pyspark.sql import functions as F

from roadpulse.operators import dbscan as dbs
from roadpulse.operators import drift as dr
from roadpulse.operators import ema
from roadpulse.operators import metrics as mt
from roadpulse.operators.smote import smote


def test_auc_and_threshold_use_raw_scores(spark):
    close = spark.createDataFrame([(0.1234561, 1), (0.1234559, 0)], "s double, y int")
    assert mt.roc_auc(close, "s", "y").first()["auc"] == 1.0
    tiny = spark.createDataFrame([(k * 1e-8, int(k > 50)) for k in range(100)], "s double, y int")
    assert mt.roc_auc(tiny, "s", "y").first()["auc"] == 1.0
    odd = spark.createDataFrame([(0.6169996, 1), (0.6169995, 0), (0.1, 0)], "s double, y int")
    best = mt.best_threshold(odd, "s", "y").first()
    assert best["threshold"] == 0.6169996 and odd.where(F.col("s") >= best["threshold"]).count() == 1
    assert mt.roc_auc(odd.where("y = 1"), "s", "y").first()["auc"] is None


def test_components_reach_the_fixpoint_on_a_long_path(spark):
    nodes = spark.range(400).select(F.col("id").alias("node"))
    forth = spark.range(399).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    edges = forth.union(forth.select(F.col("b").alias("a"), F.col("a").alias("b")))
    spark.sparkContext.getCheckpointDir()
    assert dbs._components(nodes, edges).select("label").distinct().count() == 1


def test_smote_makes_exactly_the_missing_rows_with_unique_ids(spark):
    import random
    rnd = random.Random(1)
    rows = [(k, float(rnd.gauss(0, 50)), float(rnd.gauss(0, 50)), int(k < 40)) for k in range(440)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int")
    for options, want in (({}, 400 - 40), ({"k": 60}, 400 - 40), ({"ratio": 0.5}, 200 - 40)):
        made = smote(df, "y", ["a", "b"], "id", **options).where("synthetic").collect()
        assert len(made) == want and len({r.id for r in made}) == want
        assert all(r.y == 1 and r.id < 0 for r in made)
        lo, hi = min(r[1] for r in rows[:40]), max(r[1] for r in rows[:40])
        assert all(lo <= r.a <= hi for r in made)
    two = spark.createDataFrame([(1, 0.0, 0.0, 1), (2, 1.0, 1.0, 1)] + [(k, 5.0, 5.0, 0) for k in range(3, 3001)],
                                "id long, a double, b double, y int")
    made = smote(two, "y", ["a", "b"], "id").where("synthetic")
    assert made.count() == made.select("id").distinct().count() == 2996


def test_halves_put_rows_without_time_first(spark):
    base = dt.datetime(2024, 1, 1)
    for missing in (0, 20, 80):
        rows = [(f"p{k:03d}", None if k < missing else base + dt.timedelta(seconds=k // 10)) for k in range(100)]
        log = spark.createDataFrame(rows, "prediction_id string, timestamp timestamp")
        got = {r.prediction_id: r.half for r in dr.arrival_halves(log).collect()}
        assert got == {k: "ref" if i < 50 else "cur" for i, (k, _) in enumerate(rows)}
    same = spark.createDataFrame([(f"p{k:03d}", base) for k in range(31)], "prediction_id string, timestamp timestamp")
    assert dr.arrival_halves(same).where("half = 'ref'").count() == 15
    assert dr.arrival_halves(same.limit(0)).count() == 0


def test_ema_skips_unknown_closure(spark):
    base = dt.datetime(2024, 1, 1)
    events = spark.createDataFrame(
        [(1, base, 12.9, 77.6, "High", 1, None), (2, base + dt.timedelta(hours=1), 12.9, 77.6, "Low", None, None)],
        "event_id long, event_ts timestamp, latitude double, longitude double, priority string, "
        "requires_road_closure int, duration_minutes double")
    lookup = spark.createDataFrame([], "geohash6 string, geo_event_count long, geo_high_priority_rate double, "
                                       "geo_closure_rate double, geo_avg_duration double")
    row = ema.apply_ema(lookup, events).first()
    assert abs(row["geo_closure_rate"] - 1.0) < 1e-12 and abs(row["geo_high_priority_rate"] - 0.7) < 1e-12


def test_csv_ids_and_corrupt_lines(spark, tmp_path):
    from roadpulse.operators.split import assign_split
    from roadpulse.sources.incidents import read_incidents
    (tmp_path / "a.csv").write_text("id,event_cause,latitude\n" + "".join(f"FKID{k:05d},accident,12.9\n" for k in range(500))
                                    + "7,accident\n8,accident,12.9,surplus\n9,accident,bad\n")
    df = read_incidents(spark, str(tmp_path)).cache()
    assert df.count() == 503 and df.where("incident_id is null").count() == 0
    assert df.select("incident_id").distinct().count() == 503
    corrupt = {r["_corrupt_record"] for r in df.where("_corrupt_record is not null").collect()}
    assert corrupt == {"7,accident", "8,accident,12.9,surplus"}
    split = {r["split"]: r["count"] for r in assign_split(df).groupBy("split").count().collect()}
    assert 60 <= split["test"] <= 140
