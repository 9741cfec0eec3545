"""Histograms (A-19), PSI (D-1), prediction/feature drift (D-2, D-3), status
labels (D-4) and the arrival-order halves of a log (W-1).

Binning: bounds come from a small per-group aggregate (min/max per column
or feature) and go back into the plan as literals, so rows are never shuffled
for them (``with_bounds``); each row maps to a bin index with
``least(floor((v-lo)/w), n-1)``, then a grouped count; empty bins are filled
from a ``sequence`` of bin ids so the +1 smoothing of PSI sees every bin.
Windows only run over those small per-group tables, never over rows
(except the ranking inside the one second that straddles the W-1 cut).
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .ordering import sums_below

PSI_BINS = 10
# PSI status cut-offs and labels (code semantics: 0.25 is "significant").
PSI_CUTS = (0.10, 0.25)
PREDICTION_STATUS = ("STABLE", "DRIFTING", "SIGNIFICANT_SHIFT")
FEATURE_STATUS = ("NO_DRIFT", "MODERATE_DRIFT", "SIGNIFICANT_DRIFT")
PREDICTION_COLS = ["priority_prob", "closure_prob", "duration_est_min"]
FEATURE_COLS = ["latitude", "longitude", "hour", "geo_event_count", "geo_closure_rate",
                "zone_hour_event_count"]


LITERAL_GROUPS = 1_000  # bounds of more groups are joined


def with_bounds(df: DataFrame, bounds: DataFrame, keys: list[str], names: tuple[str, ...] = ("lo", "hi")) -> DataFrame:
    """``df`` with its group's bounds beside each row; rows of unknown groups go."""
    rows = bounds.select(*keys, *names).limit(LITERAL_GROUPS + 1).collect()
    if len(rows) > LITERAL_GROUPS:
        return df.join(bounds.select(*keys, *names), keys)
    if not rows:
        return df.limit(0).withColumns({n: F.lit(None).cast("double") for n in names})
    kinds = {f.name: f.dataType for f in bounds.schema.fields}
    parts = []
    for r in rows:
        parts += [F.struct(*[F.lit(r[k]).cast(kinds[k]).alias(k) for k in keys]),
                  F.struct(*[F.lit(r[n]).cast("double").alias(n) for n in names])]
    known = F.try_element_at(F.create_map(*parts), F.struct(*[F.col(k).cast(kinds[k]).alias(k) for k in keys]))
    out = df.withColumn("_bounds", known).filter(F.col("_bounds").isNotNull())
    return out.withColumns({n: F.col(f"_bounds.{n}") for n in names}).drop("_bounds")


def bin_index(v: Column, lo: Column, hi: Column, n: int) -> Column:
    """Equal-width bin over [lo, hi], last bin closed; lo == hi puts all rows last."""
    width = (hi - lo) / F.lit(float(n))
    idx = F.least(F.floor((v - lo) / width).cast("int"), F.lit(n - 1))
    return F.when(hi == lo, F.lit(n - 1)).otherwise(idx)


def status(psi: Column, labels=PREDICTION_STATUS) -> Column:
    """D-4."""
    return (F.when(psi < PSI_CUTS[0], labels[0]).when(psi < PSI_CUTS[1], labels[1])
            .otherwise(labels[2]))


def status_label(psi: float, labels=PREDICTION_STATUS) -> str:
    """D-4 on a driver scalar."""
    return labels[0] if psi < PSI_CUTS[0] else labels[1] if psi < PSI_CUTS[1] else labels[2]


def histogram(df: DataFrame, col: str, bins: int = 20, by: list[str] = ()) -> DataFrame:
    """A-19: fixed-count histogram per group; width = (max-min)/bins, or 1 when 0."""
    by = list(by)
    keys = by or ["_all"]
    v = F.col(col).try_cast("double")
    vals = df.select(*[F.col(k) for k in by] if by else [F.lit(0).alias("_all")],
                     v.alias("_v")).filter(F.col("_v").isNotNull())
    bounds = vals.groupBy(*keys).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    width = F.when(F.col("hi") > F.col("lo"),
                   (F.col("hi") - F.col("lo")) / F.lit(float(bins))).otherwise(F.lit(1.0))
    bounds = bounds.withColumn("width", width)
    idx = F.least(F.floor((F.col("_v") - F.col("lo")) / F.col("width")).cast("int"),
                  F.lit(bins - 1))
    counts = (with_bounds(vals, bounds, keys, ("lo", "width")).withColumn("bin", idx)
              .groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("count")))
    dense = bounds.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = dense.join(counts, keys + ["bin"], "left")
    return out.select(*by, "bin",
                      (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_lo"),
                      (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("bin_hi"),
                      F.coalesce(F.col("count"), F.lit(0)).alias("count"))


def arrival_halves(log: DataFrame, order_cols=("timestamp", "prediction_id"),
                   name: str = "half") -> DataFrame:
    """W-1: first n//2 rows in arrival order -> 'ref', the rest -> 'cur'.

    Rows without a time come first; rows of one time (or without one) are in
    order of id, those without an id first.  Rows that share both time and id get one label.  The cut
    is located in the running counts of the distinct times, then in those of
    the ids at the cut's time (``ordering.sums_below``); two scalars reach the
    driver and no task ranks all rows.
    """
    checkpoint_dir(log.sparkSession)
    ts_col, id_col = order_cols
    at = F.unix_micros(F.col(ts_col).cast("timestamp"))
    ids = F.col(id_col)
    mid = log.count() // 2
    before = log.filter(at.isNull()).count()
    count = F.count(F.lit(1)).alias("n")
    if mid == 0:
        return log.withColumn(name, F.lit("cur"))
    if mid <= before:
        earlier, scope, left = F.lit(False), at.isNull(), mid
    else:
        times = sums_below(log.filter(at.isNotNull()).groupBy(at.alias("at")).agg(count), "at", ["n"])
        cut = times.filter((F.col("n_below") + before < mid)
                           & (F.col("n_below") + F.col("n") + before >= mid)).first()
        earlier = at.isNull() | (at < F.lit(cut["at"]))
        scope, left = at == F.lit(cut["at"]), mid - before - cut["n_below"]
    inside = log.filter(scope)
    nameless = inside.filter(ids.isNull()).count()
    named = sums_below(inside.filter(ids.isNotNull()).groupBy(ids.alias("id")).agg(count), "id", ["n"])
    last = named.filter(F.col("n_below") + nameless < left).agg(F.max("id")).first()[0]
    first = ids.isNull() if last is None else ids.isNull() | (ids <= F.lit(last))
    ref = F.coalesce(earlier, F.lit(False)) | (F.coalesce(scope, F.lit(False)) & first)
    return log.withColumn(name, F.when(ref, "ref").otherwise("cur"))


def psi_table(df: DataFrame, group: str, side: str, value: str, bins: int = PSI_BINS,
              ref_label: str = "ref", cur_label: str = "cur") -> DataFrame:
    """D-1 per group: joint min/max edges, +1 per bin, sum (c-r)*ln(c/r)."""
    v = F.col(value)
    valid = v.isNotNull() & ~F.isnan(v)
    bounds = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_all"),
        F.min(F.when(valid, v)).alias("lo"), F.max(F.when(valid, v)).alias("hi"),
        F.count_if(valid & (F.col(side) == ref_label)).alias("n_ref"),
        F.count_if(valid & (F.col(side) == cur_label)).alias("n_cur"))
    vals = df.select(group, side, v.alias("_v")).filter(valid)
    counts = (with_bounds(vals, bounds.filter(F.col("lo").isNotNull()), [group])
              .withColumn("bin", bin_index(F.col("_v"), F.col("lo"), F.col("hi"), bins))
              .groupBy(group, "bin").agg(
                  F.count_if(F.col(side) == ref_label).alias("r"),
                  F.count_if(F.col(side) == cur_label).alias("c")))
    dense = (bounds.filter(F.col("lo").isNotNull())
             .select(group, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")))
    full = (dense.join(counts, [group, "bin"], "left")
            .withColumns({"r": F.coalesce(F.col("r"), F.lit(0)) + 1,
                          "c": F.coalesce(F.col("c"), F.lit(0)) + 1}))
    tot = Window.partitionBy(group)
    full = full.withColumns({"rp": F.col("r") / F.sum("r").over(tot),
                             "cp": F.col("c") / F.sum("c").over(tot)})
    psi = full.groupBy(group).agg(
        F.sum((F.col("cp") - F.col("rp")) * F.log(F.col("cp") / F.col("rp"))).alias("psi"))
    return bounds.select(group, "n_all", "n_ref", "n_cur").join(psi, group, "left")


def prediction_drift(log: DataFrame, cols=PREDICTION_COLS, min_rows: int = 40,
                     min_side: int = 10) -> DataFrame:
    """D-2: PSI of each score column, first half vs second half of the log.

    The three columns are unpivoted with ``stack`` so one pass bins them all.
    """
    halves = arrival_halves(log)
    n = len(cols)
    stack = ", ".join(f"'{c}', try_cast({c} AS DOUBLE)" for c in cols)
    long = halves.select("half", F.expr(f"stack({n}, {stack}) AS (score_column, value)"))
    t = psi_table(long, "score_column", "half", "value")
    enough = F.col("n_all") >= min_rows
    sides = (F.col("n_ref") >= min_side) & (F.col("n_cur") >= min_side)
    return t.select(
        "score_column", "n_ref", "n_cur",
        F.when(enough & sides, F.bround(F.col("psi"), 4)).alias("psi"),
        F.when(~enough | ~sides, "INSUFFICIENT_DATA")
         .otherwise(status(F.col("psi"), PREDICTION_STATUS)).alias("status"))


def fit_reference_bins(train: DataFrame, cols=FEATURE_COLS, bins: int = PSI_BINS) -> DataFrame:
    """D-3 (fit time): per-feature equal-width edges and counts from training rows.

    Stored once (parquet) with the model; the outer bins extend to ±inf when
    current rows fall outside the training range.
    """
    n = len(cols)
    stack = ", ".join(f"'{c}', CAST({c} AS DOUBLE)" for c in cols)
    long = train.select(F.expr(f"stack({n}, {stack}) AS (feature, value)")).filter(
        F.col("value").isNotNull())
    bounds = long.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    counts = (with_bounds(long, bounds, ["feature"])
              .withColumn("bin", bin_index(F.col("value"), F.col("lo"), F.col("hi"), bins))
              .groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("ref_count")))
    dense = bounds.select("feature", "lo", "hi",
                          F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return (dense.join(counts, ["feature", "bin"], "left")
            .withColumn("ref_count", F.coalesce(F.col("ref_count"), F.lit(0))))


def feature_drift(reference_bins: DataFrame, current: DataFrame, cols=FEATURE_COLS,
                  bins: int = PSI_BINS, min_rows: int = 20) -> DataFrame:
    """D-3: PSI of current feature values against the saved training bins."""
    present = [c for c in cols if c in current.columns]
    n = len(present)
    stack = ", ".join(f"'{c}', CAST({c} AS DOUBLE)" for c in present)
    long = current.select(F.expr(f"stack({n}, {stack}) AS (feature, value)")).filter(
        F.col("value").isNotNull())
    edges = reference_bins.select("feature", "lo", "hi").distinct()
    idx = F.when(F.col("value") < F.col("lo"), F.lit(0)).when(
        F.col("value") > F.col("hi"), F.lit(bins - 1)).otherwise(
        bin_index(F.col("value"), F.col("lo"), F.col("hi"), bins))
    cur = (with_bounds(long, edges, ["feature"]).withColumn("bin", idx)
           .groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("cur_count")))
    full = (reference_bins.join(cur, ["feature", "bin"], "left")
            .withColumns({"r": F.col("ref_count") + 1,
                          "c": F.coalesce(F.col("cur_count"), F.lit(0)) + 1}))
    tot = Window.partitionBy("feature")
    full = full.withColumns({"rp": F.col("r") / F.sum("r").over(tot),
                             "cp": F.col("c") / F.sum("c").over(tot),
                             "n_cur": F.sum(F.col("c") - 1).over(tot)})
    agg = full.groupBy("feature").agg(
        F.first("n_cur").alias("n_cur"),
        F.sum((F.col("cp") - F.col("rp")) * F.log(F.col("cp") / F.col("rp"))).alias("psi"))
    enough = F.col("n_cur") >= min_rows
    return agg.select(
        "feature", "n_cur",
        F.when(enough, F.bround(F.col("psi"), 4)).alias("psi"),
        F.when(~enough, "INSUFFICIENT_DATA")
         .otherwise(status(F.col("psi"), FEATURE_STATUS)).alias("status"))
