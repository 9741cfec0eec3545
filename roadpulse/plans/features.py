"""Training-feature plan (flow A up to the feature matrix).

raw incidents -> prepare -> split -> train-only lookups -> joins + median
fills -> interactions -> IQR cap -> imputation -> high-risk flag.
Driver work is limited to a few scalars (medians, IQR bounds, modes).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.temporal import CYCLICAL_FEATURES, TIME_DUMMIES
from ..operators import lookups as lk
from ..operators.clean import prepare_incidents
from ..operators.preprocess import CategoricalImputer, IQRCapper
from ..operators.split import assign_split
from ..session import checkpoint_dir

TARGET_ENC_COLS = ["event_cause", "veh_type", "corridor", "police_station", "zone", "junction"]

# The three feature lists (priority excludes corridor signals
# and the smoothed priority label; closure adds closure-rate features).
FEATURES_PRIORITY = [
    "is_planned", "hour", "day_of_week", "month", "is_weekend", "is_peak_hour",
    "latitude", "longitude",
    "geo_event_count", "geo_closure_rate", "geo_avg_duration",
    "zone_hour_event_count",
    "event_cause", "veh_type", "police_station", "zone", "junction",
    "log_geo_event_count", "geo_event_density",
] + TIME_DUMMIES + CYCLICAL_FEATURES

FEATURES_ALL = [
    "is_planned", "hour", "day_of_week", "month", "is_weekend", "is_peak_hour",
    "latitude", "longitude",
    "geo_event_count", "geo_high_priority_rate", "geo_closure_rate", "geo_avg_duration",
    "zone_hour_event_count", "corridor_risk_score",
    "event_cause", "veh_type", "corridor", "police_station", "zone", "junction",
    "cause_avg_duration",
    "log_geo_event_count", "geo_event_density",
    "duration_x_closure_risk",
] + TIME_DUMMIES + CYCLICAL_FEATURES

FEATURES_CLOSURE = FEATURES_ALL + [
    "cause_closure_rate", "is_high_risk_cause", "geo_closure_x_peak", "cause_zone_closure",
]


@dataclass
class FeatureState:
    """Everything scoring needs to rebuild features for new rows."""
    lookups: lk.Lookups
    medians: dict[str, float]
    capper: object
    imputer: object
    extras: dict = field(default_factory=dict)


def enrich(df: DataFrame, state: FeatureState) -> DataFrame:
    """Shared by training and scoring: J-1..J-6, fills, S-9, M-2, M-3, J-8."""
    out = lk.join_lookups(df, state.lookups)
    out = lk.fill_with(out, state.medians)
    out = lk.add_interactions(out)
    out = state.capper.transform(out)
    out = state.imputer.transform(out)
    return lk.flag_high_risk(out, state.lookups.high_risk)


def fit_feature_state(train: DataFrame) -> FeatureState:
    """Fit lookups, medians, IQR bounds and modes on the training slice.

    The slice is persisted (memory, spilling to disk; lost blocks recompute
    from the scan) only while the fit runs; the lookups -- small keyed
    aggregates -- are checkpointed to the shared folder for the joins that
    follow.
    """
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fitted = lk.Lookups.fit(train)
        # checkpointed (shared folder), not cached: lineage is cut and no
        # cache entry lingers for the planner to match against later plans
        lookups = lk.Lookups(**{name: materialize(t) for name, t in fitted.items()}).counted()
        joined = lk.join_lookups(train, lookups)
        medians = lk.median_table(joined).first().asDict()
        capper = IQRCapper("duration_minutes", 1.5).fit(train)
        imputer = CategoricalImputer().fit(train)
    finally:
        train.unpersist()
    return FeatureState(lookups, {k: float(v) for k, v in medians.items() if v is not None},
                        capper, imputer)


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage by writing to the session's shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def build_training_features(raw: DataFrame, seed: int = 42, test_fraction: float = 0.2
                            ) -> tuple[DataFrame, FeatureState]:
    """Featured rows of both slices (column ``split``) and the fitted state."""
    return features_of(assign_split(prepare_incidents(raw), test_fraction=test_fraction, seed=seed))


def features_of(prepared: DataFrame) -> tuple[DataFrame, FeatureState]:
    """The same from prepared rows with their slices."""
    train = prepared.filter(F.col("split") == "train")
    state = fit_feature_state(train)
    return enrich(prepared, state), state
