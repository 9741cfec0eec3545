"""Ordered exponential-moving-average upkeep of the cell lookup (W-5).

Applying one labelled event to a cell is the affine map
``v -> (1-a) v + a x``.  Folding a cell's events in time order is the
composition of those maps, which is associative (but not commutative), so
it can be evaluated as a tree instead of one long ordered scan:

* level 0: events of one cell within one second, ranked newest first
  (``j`` = number of later events): ``b = sum a (1-a)^j x``, ``n`` events; a
  (cell, second) with more than ``BUSY`` events is first split by microsecond
  and by ranges of ids, whose maps compose to the second's in the same way;
* each higher level (second -> hour -> day -> whole cell) composes its
  ordered children: ``b = sum b_child (1-a)^(events after the child)``.

Every window therefore sees at most 4096 ids or children (or ``BUSY`` events of one
cell-second), so a hot cell never lands whole in one task, and the result
is the exact fold (up to floating-point summation order).  The final value
is ``(1-a)^n * start + b`` where ``start`` is the stored value, or -- for a
cell not yet in the lookup -- the cell's first event (the reference starts
a new cell from its first event).  Durations fold only over events that
carry one; a cell whose stored duration is null starts from its first
known duration.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import with_geohash

ALPHA = 0.3
# (unit of the child key in seconds, unit of the parent key in seconds)
_LEVELS = [(1, 3600), (3600, 86400), (86400, None)]


def with_cells(events: DataFrame) -> DataFrame:
    """The events that have a place, with their cell."""
    return with_geohash(events.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()),
                        "latitude", "longitude", "geohash6")


def _prep_events(events: DataFrame, ts_col: str, id_col: str) -> DataFrame:
    return with_cells(events).select(
        "geohash6", F.col(ts_col).alias("_ts"), F.col(id_col).alias("_id"),
        F.col("priority").eqNullSafe("High").cast("double").alias("x_high"),
        F.col("requires_road_closure").cast("double").alias("x_cl"),
        F.col("duration_minutes").cast("double").alias("x_d"),
        F.floor(F.unix_micros(F.col(ts_col)) / 1_000_000).alias("k1"))


BUSY = 10_000


def _seconds(ev: DataFrame, alpha: float) -> DataFrame:
    """Level 0 of all (cell, second) groups; busy ones through finer levels."""
    busy = ev.groupBy("geohash6", "k1").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > BUSY).select("geohash6", "k1")
    if busy.isEmpty():
        return _leaf(ev, alpha, ["k1"])
    us = F.unix_micros("_ts")
    fine = ev.join(busy, ["geohash6", "k1"], "left_semi").withColumns(
        {"_us": us, "_ms": F.floor(us / 1000), "_idr": F.shiftright("_id", 24), "_ids": F.shiftright("_id", 12)})
    level = _leaf(fine, alpha, ["k1", "_ms", "_us", "_idr", "_ids"])
    for keys in (["k1", "_ms", "_us", "_idr"], ["k1", "_ms", "_us"], ["k1", "_ms"], ["k1"]):
        child = next(c for c in ("_ids", "_idr", "_us", "_ms") if c in level.columns and c not in keys)
        level = _folded(level, child, keys, alpha)
    return _leaf(ev.join(busy, ["geohash6", "k1"], "left_anti"), alpha, ["k1"]).unionByName(level)


def _leaf(ev: DataFrame, alpha: float, keys: list[str]) -> DataFrame:
    """Fold the events of each (cell, keys)."""
    newest = Window.partitionBy("geohash6", *keys).orderBy(F.desc("_ts"), F.desc("_id"))
    later = newest.rowsBetween(Window.unboundedPreceding, -1)
    has_d = F.col("x_d").isNotNull().cast("int")
    has_cl = F.col("x_cl").isNotNull().cast("int")
    r = ev.withColumns({
        "_j": F.row_number().over(newest) - 1,
        "_jd": F.coalesce(F.sum(has_d).over(later), F.lit(0)),
        "_jc": F.coalesce(F.sum(has_cl).over(later), F.lit(0)),
    })
    decay = lambda j: F.lit(alpha) * F.pow(F.lit(1 - alpha), F.col(j))
    return r.groupBy("geohash6", *keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(decay("_j") * F.col("x_high")).alias("b_high"),
        F.count("x_cl").alias("n_cl"),
        F.coalesce(F.sum(F.when(F.col("x_cl").isNotNull(), decay("_jc") * F.col("x_cl"))),
                   F.lit(0.0)).alias("b_cl"),
        F.count("x_d").alias("n_d"),
        F.coalesce(F.sum(F.when(F.col("x_d").isNotNull(), decay("_jd") * F.col("x_d"))),
                   F.lit(0.0)).alias("b_d"))


def _compose(children: DataFrame, child_key: str, parent_key: str | None,
             unit_ratio: int | None, alpha: float) -> DataFrame:
    """Compose ordered children into their parent (cell, parent_key)."""
    df = children
    part = ["geohash6"]
    if parent_key is not None:
        df = df.withColumn(parent_key, F.floor(F.col(child_key) / unit_ratio))
        part.append(parent_key)
    return _folded(df, child_key, part[1:], alpha)


def _folded(df: DataFrame, child_key: str, keys: list[str], alpha: float) -> DataFrame:
    """Compose the children of each (cell, keys) in order of ``child_key``."""
    part = ["geohash6", *keys]
    later = (Window.partitionBy(*part).orderBy(F.desc(child_key))
             .rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumns({"_after": F.coalesce(F.sum("n").over(later), F.lit(0)),
                         "_after_c": F.coalesce(F.sum("n_cl").over(later), F.lit(0)),
                         "_after_d": F.coalesce(F.sum("n_d").over(later), F.lit(0))})
    q = F.lit(1 - alpha)
    return df.groupBy(*part).agg(
        F.sum("n").alias("n"),
        F.sum(F.col("b_high") * F.pow(q, F.col("_after"))).alias("b_high"),
        F.sum("n_cl").alias("n_cl"),
        F.sum(F.col("b_cl") * F.pow(q, F.col("_after_c"))).alias("b_cl"),
        F.sum("n_d").alias("n_d"),
        F.sum(F.col("b_d") * F.pow(q, F.col("_after_d"))).alias("b_d"))


def cell_updates(events: DataFrame, alpha: float = ALPHA, ts_col: str = "event_ts",
                 id_col: str = "event_id") -> DataFrame:
    """Per-cell composed update: n, b_* and the cell's first event values."""
    ev = _prep_events(events, ts_col, id_col)
    level = _seconds(ev, alpha)
    child = "k1"
    for unit, parent_unit in _LEVELS:
        parent = None if parent_unit is None else f"k{parent_unit}"
        level = _compose(level, child, parent, None if parent_unit is None
                         else parent_unit // unit, alpha)
        child = parent
    order = F.struct("_ts", "_id")
    firsts = ev.groupBy("geohash6").agg(
        F.min_by("x_high", order).alias("first_high"),
        F.min_by("x_cl", F.when(F.col("x_cl").isNotNull(), order)).alias("first_cl"),
        F.min_by("x_d", F.when(F.col("x_d").isNotNull(), order)).alias("first_d"))
    return level.join(firsts, "geohash6")


def apply_ema(lookup: DataFrame, events: DataFrame, alpha: float = ALPHA,
              ts_col: str = "event_ts", id_col: str = "event_id") -> DataFrame:
    """Updated cell lookup (all cells) plus ``events_applied`` per cell."""
    up = cell_updates(events, alpha, ts_col, id_col)
    q = F.lit(1 - alpha)
    old = lookup.select("geohash6", F.lit(True).alias("_old"),
                        F.col("geo_event_count").alias("o_n"),
                        F.col("geo_high_priority_rate").alias("o_high"),
                        F.col("geo_closure_rate").alias("o_cl"),
                        F.col("geo_avg_duration").alias("o_d"))
    j = old.join(up, "geohash6", "full_outer")
    touched = F.col("n").isNotNull()
    is_old = F.col("_old").isNotNull()

    def fold(o, first, n, b):
        start = F.when(is_old, F.col(o)).otherwise(F.col(first))
        return F.when(touched, F.pow(q, F.col(n)) * start + F.col(b)).otherwise(F.col(o))

    def fold_known(o, first, n, b):
        """Null observations neither count nor decay."""
        start = F.coalesce(F.when(is_old, F.col(o)), F.col(first))
        return (F.when(~touched | (F.col(n) == 0), F.col(o))
                .otherwise(F.pow(q, F.col(n)) * start + F.col(b)))
    return j.select(
        "geohash6",
        (F.coalesce(F.col("o_n"), F.lit(0)) + F.coalesce(F.col("n"), F.lit(0)))
        .cast("long").alias("geo_event_count"),
        fold("o_high", "first_high", "n", "b_high").alias("geo_high_priority_rate"),
        fold_known("o_cl", "first_cl", "n_cl", "b_cl").alias("geo_closure_rate"),
        fold_known("o_d", "first_d", "n_d", "b_d").alias("geo_avg_duration"),
        F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("events_applied"))


def labelled_events_from_incidents(prepared: DataFrame) -> DataFrame:
    """Shape prepared incident rows as labelled events (api ingest schema)."""
    return prepared.select(
        F.col("incident_id").alias("event_id"), F.col("start_datetime").alias("event_ts"),
        "latitude", "longitude", "hour", "event_cause", "zone", "corridor", "priority",
        F.col("requires_road_closure").cast("int").alias("requires_road_closure"),
        "duration_minutes")
