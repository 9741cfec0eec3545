"""Lookup joins by size: broadcast, or salted for heavy cells; drift without a shuffle of log rows."""
from pyspark.sql import functions as F

from roadpulse.operators import drift, lookups as lk


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_lookups_are_broadcast_and_large_ones_salted(spark, monkeypatch):
    facts = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("c"), (F.col("id") % 500).cast("string"))).alias("geohash6"),
        F.lit("z").alias("zone"), F.lit(1).alias("hour"), F.lit("k").alias("corridor"), F.lit("e").alias("event_cause"), "id")
    cell = facts.groupBy("geohash6").agg(F.count(F.lit(1)).alias("geo_event_count")).checkpoint()
    one = lambda *names: spark.createDataFrame([tuple(1 if n == "hour" else n[0] for n in names) + (5,)], [*names, "v_" + names[0]])
    tables = lk.Lookups(cell, one("zone", "hour"), one("corridor"), one("event_cause"),
                        one("event_cause", "zone").withColumnRenamed("v_event_cause", "v2"), one("event_cause")).counted()
    small = lk.join_lookups(facts, tables)
    assert "SortMergeJoin" not in plan(small) and "hashpartitioning(geohash6" not in plan(small)
    want = {r["id"]: r["geo_event_count"] for r in small.collect()}
    monkeypatch.setattr(lk, "BROADCAST_ROWS", 100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert "hot" in lk.heavy_keys(facts, "geohash6")
        large = lk.join_lookups(facts, tables)
        assert "_salt" in plan(large)
        assert {r["id"]: r["geo_event_count"] for r in large.collect()} == want and large.count() == 3000
        spread = lk.salted_join(facts, cell, "geohash6", ["hot"]).withColumn("p", F.spark_partition_id())
        spread = spread.where("geohash6 = 'hot'").groupBy("p").count().collect()
        assert len(spread) > 3 and max(r["count"] for r in spread) < 600
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_histograms_and_psi_do_not_shuffle_rows(spark):
    log = spark.range(2000).select((F.col("id") % 97 / 97.0).alias("s"), F.when(F.col("id") < 1000, "ref").otherwise("cur").alias("half"),
                                   F.lit("s").alias("g"))
    for df in (drift.histogram(log, "s", 20), drift.psi_table(log, "g", "half", "s")):
        df.collect()
        text = plan(df)
        assert "SortMergeJoin" not in text.split("Initial Plan")[0] or "hashpartitioning(_v" not in text
    counts = [r["count"] for r in drift.histogram(log, "s", 20).orderBy("bin").collect()]
    assert sum(counts) == 2000 and len(counts) == 20
    grouped = drift.histogram(log, "s", 4, by=["half"]).collect()
    assert sum(r["count"] for r in grouped) == 2000 and len(grouped) == 8
    assert drift.histogram(log.limit(0), "s", 4).collect() == []
