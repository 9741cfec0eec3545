"""Bin edges and empty inputs."""
import pytest
from pyspark.sql import functions as F

from roadpulse.functions import temporal as tf
from roadpulse.operators import drift as dr
from roadpulse.operators import metrics as mt
from roadpulse.operators.dbscan import dbscan
from roadpulse.operators.ema import apply_ema
from roadpulse.schema import CELL_LOOKUP, LABELLED_EVENT


@pytest.mark.parametrize("hour,label", [(0, "night"), (5, "night"), (6, "morning"),
                                        (11, "morning"), (12, "afternoon"), (16, "afternoon"),
                                        (17, "evening"), (20, "evening"), (21, "late_evening"),
                                        (23, "late_evening"), (None, None)])
def test_time_of_day_right_closed(spark, hour, label):
    df = spark.createDataFrame([(hour,)], "h int")
    assert df.select(tf.time_of_day(F.col("h"))).first()[0] == label


def test_empty_inputs(spark):
    no_pts = spark.createDataFrame([], "id long, latitude double, longitude double")
    assert dbscan(no_pts).count() == 0
    lookup = spark.createDataFrame([("tdr1v9", 3, 0.5, 0.0, 20.0)], CELL_LOOKUP)
    no_ev = spark.createDataFrame([], LABELLED_EVENT)
    out = apply_ema(lookup, no_ev).collect()
    assert len(out) == 1 and out[0]["geo_event_count"] == 3 and out[0]["events_applied"] == 0
    no_log = spark.createDataFrame([], "prediction_id long, timestamp timestamp, "
                                       "priority_prob double, closure_prob double, "
                                       "duration_est_min double")
    assert dr.prediction_drift(no_log).count() == 0
    no_scores = spark.createDataFrame([], "s double, y int")
    assert mt.roc_auc(no_scores, "s", "y").first()["auc"] is None
    assert dr.histogram(spark.createDataFrame([], "v double"), "v", 5).count() == 0


def test_all_null_column_histogram_and_psi(spark):
    df = spark.createDataFrame([(None,), (None,)], "v double")
    assert dr.histogram(df, "v", 4).count() == 0
