"""Time features (S-1..S-6) as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Peak hours, weekend days (0=Monday), time-of-day bins.
PEAK_HOURS = [7, 8, 9, 17, 18, 19, 20]
WEEKEND_DAYS = [5, 6]
# right-closed bins: (-1,5] night, (5,11] morning, (11,16] afternoon,
# (16,20] evening, (20,24] late_evening
TIME_OF_DAY_BINS = [(-1, 5, "night"), (5, 11, "morning"), (11, 16, "afternoon"),
                    (16, 20, "evening"), (20, 24, "late_evening")]
# one-hot drops the first level ('night'); remaining dummy columns, sorted
TIME_DUMMIES = ["time_of_day_afternoon", "time_of_day_evening",
                "time_of_day_late_evening", "time_of_day_morning"]
CYCLICAL_FEATURES = ["hour_sin", "hour_cos", "month_sin", "month_cos", "dow_sin", "dow_cos"]


def time_of_day(hour: Column) -> Column:
    """Right-closed bins; null (or out of range) hour gives null."""
    expr = None
    for lo, hi, label in TIME_OF_DAY_BINS:
        cond = (hour > lo) & (hour <= hi)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr


def is_peak(hour: Column) -> Column:
    return F.coalesce(hour.isin(PEAK_HOURS), F.lit(False)).cast("int")


def is_weekend(dow: Column) -> Column:
    return F.coalesce(dow.isin(WEEKEND_DAYS), F.lit(False)).cast("int")


def cyclic(value: Column, period: int) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * value / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def time_dummies(tod: Column) -> dict[str, Column]:
    """One-hot of time_of_day over the fixed saved level list (S-4)."""
    return {name: F.coalesce((tod == name[len("time_of_day_"):]).cast("int"), F.lit(0))
            for name in TIME_DUMMIES}


def duration_from_log(log_pred: Column) -> Column:
    """expm1 of a log1p-scale prediction, floored at 1 minute, 60 when missing (S-6)."""
    return F.coalesce(F.greatest(F.lit(1.0), F.expm1(log_pred)), F.lit(60.0))
