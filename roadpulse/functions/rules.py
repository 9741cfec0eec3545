"""Dispatch rules and score labels (S-11..S-14) as column expressions.

The closure threshold is a parameter (a Column or float) so it can come
from the fitted model state rather than a constant.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .temporal import PEAK_HOURS

# Recommendation texts, cut-offs, public-event causes.
MANPOWER_HIGH = "HIGH — Deploy 8-12 officers + 2 PCR vans"
MANPOWER_MEDIUM = "MEDIUM — Deploy 4-6 officers + 1 PCR van"
MANPOWER_LOW = "LOW — 2 officers sufficient"
BARRICADE_FULL = "FULL ROAD CLOSURE — Deploy heavy barricades, signage, and rerouting boards"
BARRICADE_PARTIAL = "PARTIAL — Lane-level barricading recommended"
BARRICADE_MINIMAL = "MINIMAL — Cones / soft barricades only"
DIVERSION_URGENT = "URGENT — Activate alternate route NOW. Notify Waze/Google Maps."
DIVERSION_RECOMMENDED = "RECOMMENDED — Pre-position route advisory boards"
DIVERSION_MONITOR = "MONITOR — No diversion needed currently"
PUBLIC_EVENT_MANPOWER = "HIGH — Political/public event protocol. Coordinate with event organizers."
PUBLIC_EVENT_BARRICADE = "FULL ROAD CLOSURE recommended for public safety"
PUBLIC_EVENT_CAUSES = ["public_event", "procession", "protest", "vip_movement"]
DEFAULT_CLOSURE_THRESHOLD = 0.396
MANPOWER_CUTS = (0.75, 0.45)
LONG_DURATION_MIN = 90
GAUGE_BANDS = (40, 70)
CORRIDOR_RISK_CUTS = (0.7, 0.4)
LOG_LEVEL_CHARS = 10


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def manpower(priority_prob: Column, cause: Column) -> Column:
    base = (F.when(priority_prob >= MANPOWER_CUTS[0], MANPOWER_HIGH)
            .when(priority_prob >= MANPOWER_CUTS[1], MANPOWER_MEDIUM)
            .otherwise(MANPOWER_LOW))
    return F.when(_public(cause), PUBLIC_EVENT_MANPOWER).otherwise(base)


def barricading(closure_prob: Column, cause: Column, thresh=DEFAULT_CLOSURE_THRESHOLD) -> Column:
    t = _c(thresh)
    base = (F.when(closure_prob >= t, BARRICADE_FULL)
            .when(closure_prob >= t * 0.5, BARRICADE_PARTIAL)
            .otherwise(BARRICADE_MINIMAL))
    return F.when(_public(cause), PUBLIC_EVENT_BARRICADE).otherwise(base)


def diversion(closure_prob: Column, duration_est: Column, hour: Column,
              thresh=DEFAULT_CLOSURE_THRESHOLD) -> Column:
    t = _c(thresh)
    peak = F.coalesce(hour.isin(PEAK_HOURS), F.lit(False))
    return (F.when((closure_prob >= t) & peak, DIVERSION_URGENT)
            .when((closure_prob >= t * 0.75) | (duration_est > LONG_DURATION_MIN),
                  DIVERSION_RECOMMENDED)
            .otherwise(DIVERSION_MONITOR))


def _public(cause: Column) -> Column:
    return F.coalesce(cause.isin(PUBLIC_EVENT_CAUSES), F.lit(False))


def percent_text(p: Column) -> Column:
    """S-11: 'xx.x%' from a probability."""
    return F.format_string("%.1f%%", p * 100)


def recommendations(priority_prob: Column, closure_prob: Column, duration_est: Column,
                    cause: Column, hour: Column, thresh=DEFAULT_CLOSURE_THRESHOLD) -> Column:
    """S-12 as one struct column."""
    return F.struct(
        manpower(priority_prob, cause).alias("manpower"),
        barricading(closure_prob, cause, thresh).alias("barricading"),
        diversion(closure_prob, duration_est, hour, thresh).alias("diversion"),
        F.bround(duration_est, 0).cast("long").alias("estimated_duration_min"),
        percent_text(priority_prob).alias("priority_score"),
        percent_text(closure_prob).alias("closure_risk"),
    )


def priority_label(p: Column) -> Column:
    """S-13."""
    return F.when(p > 0.5, "HIGH").otherwise("LOW")


def closure_label(p: Column, thresh=DEFAULT_CLOSURE_THRESHOLD) -> Column:
    return F.when(p >= _c(thresh), "LIKELY").otherwise("UNLIKELY")


def gauge_band(pct: Column) -> Column:
    """S-13 gauge bands on a 0-100 scale."""
    return (F.when(pct < GAUGE_BANDS[0], "low").when(pct < GAUGE_BANDS[1], "medium")
            .otherwise("high"))


def corridor_risk_label(rate: Column) -> Column:
    """S-14."""
    return (F.when(rate > CORRIDOR_RISK_CUTS[0], "HIGH")
            .when(rate > CORRIDOR_RISK_CUTS[1], "MEDIUM").otherwise("LOW"))


def log_level(text: Column) -> Column:
    """IO-3: recommendation level as written to the log (first 10 characters)."""
    return F.substring(text, 1, LOG_LEVEL_CHARS)
