from pyspark.sql import functions as F

from roadpulse.functions import rules


def _recs(spark, p, c, d, cause, hour, t=0.396):
    df = spark.createDataFrame([(p, c, d, cause, hour)],
                               "p double, c double, d double, cause string, hour int")
    return df.select(rules.recommendations(F.col("p"), F.col("c"), F.col("d"), F.col("cause"),
                                           F.col("hour"), t).alias("r")).first()["r"]


def test_levels(spark):
    r = _recs(spark, 0.8, 0.5, 30.0, "accident", 8)
    assert r["manpower"].startswith("HIGH — Deploy 8-12")
    assert r["barricading"].startswith("FULL ROAD CLOSURE — Deploy")
    assert r["diversion"].startswith("URGENT")
    r = _recs(spark, 0.5, 0.2, 95.0, "accident", 12)
    assert r["manpower"].startswith("MEDIUM")
    assert r["barricading"].startswith("PARTIAL")
    assert r["diversion"].startswith("RECOMMENDED")
    r = _recs(spark, 0.1, 0.1, 10.0, "accident", 12)
    assert r["manpower"].startswith("LOW") and r["barricading"].startswith("MINIMAL")
    assert r["diversion"].startswith("MONITOR")


def test_public_event_override(spark):
    r = _recs(spark, 0.1, 0.1, 10.0, "protest", 12)
    assert r["manpower"] == rules.PUBLIC_EVENT_MANPOWER
    assert r["barricading"] == rules.PUBLIC_EVENT_BARRICADE
    assert r["diversion"].startswith("MONITOR")


def test_text_and_rounding(spark):
    r = _recs(spark, 0.1234, 0.5, 2.5, "x", 1)
    assert r["priority_score"] == "12.3%" and r["closure_risk"] == "50.0%"
    assert r["estimated_duration_min"] == 2      # half-even like Python round()


def test_labels_and_log_level(spark):
    df = spark.createDataFrame([(0.5, 0.396), (0.51, 0.3959)], "p double, c double")
    rows = df.select(rules.priority_label(F.col("p")), rules.closure_label(F.col("c"))).collect()
    assert [tuple(r) for r in rows] == [("LOW", "LIKELY"), ("HIGH", "UNLIKELY")]
    lv = spark.range(1).select(rules.log_level(F.lit(rules.MANPOWER_HIGH))).first()[0]
    assert lv == "HIGH — Dep"
