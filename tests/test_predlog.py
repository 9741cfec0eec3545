"""The stored log: damaged text lines and outcomes that arrive late or twice."""
import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from paths import SF0001
from roadpulse.sources import predlog as pl

HEAD = ("timestamp,latitude,longitude,hour,day_of_week,month,event_cause,zone,corridor,priority_prob,closure_prob,"
        "duration_est_min,manpower_level,barricading_level,diversion_level,actual_priority,actual_closure,"
        "actual_duration_min,feedback_correct")


def test_a_mixed_file_equals_its_clean_copy(spark):
    log = pl.derived_log(spark, SF0001).withColumn("corridor", F.when(
        F.col("prediction_id") % 3 == 0, F.lit("Süd, „Tor“ 7, 2")).otherwise(F.col("corridor")))
    rows = log.drop("prediction_id").collect()
    lines = [HEAD.encode()]
    for i, r in enumerate(rows):
        cells = [r["timestamp"].strftime("%Y-%m-%dT%H:%M:%S.%f")] + ["" if v is None else str(v) for v in r[1:]]
        lines.append(",".join(cells).encode("cp1252" if i % 2 else "utf-8") + (b"\r" if i % 5 == 0 else b""))
    lines += [b"", b"cut off,1,2", b"\xff\xfe"]
    folder = tempfile.mkdtemp()
    open(os.path.join(folder, "log.csv"), "wb").write(b"\n".join(lines))
    got = pl.read_text_log(spark, folder)
    clean = got.where("_corrupt_record is null").drop("prediction_id", "_corrupt_record").collect()
    assert sorted(map(repr, clean)) == sorted(map(repr, rows))
    assert {r[0] for r in got.where("_corrupt_record is not null").select("_corrupt_record").collect()} == {"cut off,1,2", "ÿþ"}


def test_text_log_round_trip(spark):
    log = pl.derived_log(spark, SF0001)
    folder = tempfile.mkdtemp() + "/log"
    pl.write_text_log(log, folder)
    back = pl.read_log(spark, folder, "csv")
    assert sorted(map(repr, back.drop("prediction_id", "_corrupt_record").collect())) == sorted(map(repr, log.drop("prediction_id").collect()))


def test_late_and_repeated_outcomes_leave_one_final_row(spark):
    root = tempfile.mkdtemp()
    log = pl.derived_log(spark, SF0001)
    pl.append_log(log, f"{root}/log")
    at = dt.datetime(2024, 1, 1)
    ids = [r["prediction_id"] for r in log.orderBy("timestamp", "prediction_id").limit(3).collect()]
    outcome = lambda rows: spark.createDataFrame(rows, pl.OUTCOME)
    new = outcome([(ids[0], at + dt.timedelta(2), "High", 1, 30.0), (ids[1], at, "Low", 0, None)])
    old = outcome([(ids[0], at, "Low", 0, 10.0), (None, at, "High", 1, 1.0), (-5, at, "High", 1, 1.0)])
    days = pl.upsert_outcomes(spark, f"{root}/log", f"{root}/outcomes", new)
    others = {f: os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(f"{root}/log") for f in fs
              if f.endswith(".parquet") and not any(str(day) in d for day in days)}
    assert len(days) == 1 and others
    for arrived in (old, new, old):
        pl.upsert_outcomes(spark, f"{root}/log", f"{root}/outcomes", arrived)
    assert others == {f: os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(f"{root}/log") for f in fs if f in others}
    got = {r["prediction_id"]: r for r in pl.read_log(spark, f"{root}/log").collect()}
    assert len(got) == log.count() == pl.read_log(spark, f"{root}/log").count()
    first, second, third = (got[i] for i in ids)
    assert (first["actual_priority"], first["actual_closure"], first["actual_duration_min"]) == ("High", 1, 30.0)
    assert first["feedback_correct"] == (first["priority_prob"] > 0.5)
    assert second["feedback_correct"] == (second["priority_prob"] <= 0.5) and third["actual_priority"] is None
    assert pl.upsert_outcomes(spark, f"{root}/log", f"{root}/outcomes", old.limit(0)) == []
