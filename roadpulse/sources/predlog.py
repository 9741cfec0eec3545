"""Prediction log: derivation from the driver's tables, append sink (IO-3),
scan (IO-2), and outcome backfill (J-10).

The log is a parquet dataset partitioned by ``log_date`` so
time-window reads prune partitions.  Ground-truth columns stay null until
backfilled (never empty strings).  Outcomes arrive late and more than once:
``upsert_outcomes`` keeps them all in a table of their own and rewrites only the
days whose predictions they name, each row with its latest outcome.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules
from ..schema import PREDICTION_LOG
from .fixture import incidents_from_events
from .tables import read_table

LOG_COLUMNS = [f.name for f in PREDICTION_LOG.fields]


def score_rows_to_log(scored: DataFrame, thresh=rules.DEFAULT_CLOSURE_THRESHOLD) -> DataFrame:
    """Scored rows (with probabilities) -> log records with cut recommendation levels."""
    p, c, d = F.col("priority_prob"), F.col("closure_prob"), F.col("duration_est_min")
    cause, hour = F.col("event_cause"), F.col("hour")
    return scored.select(
        *[F.col(x) for x in ["prediction_id", "timestamp", "latitude", "longitude", "hour",
                             "day_of_week", "month", "event_cause", "zone", "corridor",
                             "priority_prob", "closure_prob", "duration_est_min"]],
        rules.log_level(rules.manpower(p, cause)).alias("manpower_level"),
        rules.log_level(rules.barricading(c, cause, thresh)).alias("barricading_level"),
        rules.log_level(rules.diversion(c, d, hour, thresh)).alias("diversion_level"),
        F.lit(None).cast("string").alias("actual_priority"),
        F.lit(None).cast("int").alias("actual_closure"),
        F.lit(None).cast("double").alias("actual_duration_min"),
        F.lit(None).cast("boolean").alias("feedback_correct"),
    )


def scored_rows_from_events(events: DataFrame) -> DataFrame:
    """Stand-in scores shaped like model output, one per event (FIXTURES §5)."""
    inc = incidents_from_events(events, keep=("ts", "value"))
    e, ts = F.col("incident_id"), F.col("src_ts")
    return inc.select(
        e.alias("prediction_id"), ts.alias("timestamp"),
        "latitude", "longitude",
        F.hour(ts).alias("hour"), F.weekday(ts).alias("day_of_week"),
        F.month(ts).alias("month"), "event_cause", "zone", "corridor",
        ((e * 7919) % 10000 / F.lit(10000.0)).alias("priority_prob"),
        ((e * 104729) % 10000 / F.lit(10000.0)).alias("closure_prob"),
        F.col("src_value").alias("duration_est_min"))


def derived_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_rows_to_log(scored_rows_from_events(read_table(spark, sf_dir, "events")))


def append_log(log: DataFrame, path: str) -> None:
    """IO-3 sink: append, partitioned by date for pruning.

    Rebalancing gathers a day's rows into few files and splits a large day.
    """
    (log.select(*LOG_COLUMNS).withColumn("log_date", F.to_date("timestamp"))
        .hint("rebalance", "log_date").write.mode("append").partitionBy("log_date").parquet(path))


def read_log(spark: SparkSession, path: str, fmt: str = "parquet", since=None) -> DataFrame:
    """IO-2 scan with the explicit schema; ``fmt`` csv reads a text log as ``read_text_log``.

    With ``since`` only rows from that time on, read from the partitions of its day and later.
    """
    if fmt == "csv":
        df = read_text_log(spark, path)
        return df if since is None else df.filter(F.col("timestamp") >= F.lit(since))
    df = spark.read.parquet(path)
    if since is not None:
        df = df.filter((F.col("log_date") >= F.to_date(F.lit(since))) & (F.col("timestamp") >= F.lit(since)))
    return df.select(*LOG_COLUMNS)


# Characters of code page 1252 at the bytes 80 to 9F that ISO 8859-1 has as controls.
_CP1252 = {0x80: "\u20ac", 0x82: "\u201a", 0x83: "\u0192", 0x84: "\u201e", 0x85: "\u2026", 0x86: "\u2020", 0x87: "\u2021",
           0x88: "\u02c6", 0x89: "\u2030", 0x8a: "\u0160", 0x8b: "\u2039", 0x8c: "\u0152", 0x8e: "\u017d", 0x91: "\u2018",
           0x92: "\u2019", 0x93: "\u201c", 0x94: "\u201d", 0x95: "\u2022", 0x96: "\u2013", 0x97: "\u2014", 0x98: "\u02dc",
           0x99: "\u2122", 0x9a: "\u0161", 0x9b: "\u203a", 0x9c: "\u0153", 0x9e: "\u017e", 0x9f: "\u0178"}

TEXT_COLUMNS = [c for c in LOG_COLUMNS if c != "prediction_id"]


def decoded(raw: Column) -> Column:
    """A line's bytes as text: UTF-8 if they are valid, else code page 1252."""
    latin = F.decode(raw, "ISO-8859-1")
    other = F.translate(latin, "".join(map(chr, _CP1252)), "".join(_CP1252.values()))
    return F.when(F.is_valid_utf8(raw.cast("string")), F.decode(raw, "UTF-8")).otherwise(other)


def _fields(line: Column) -> tuple[Column, str]:
    """The pieces ``p`` of an unquoted line, and SQL that makes its 19 fields of them; commas within texts are told apart by the three numbers between the two groups of texts.

    The line ends in four outcome fields.  Before them three levels and before the numbers cause, zone and corridor
    are texts; pieces that are too many belong to the last text of their group.  Null if no such reading exists.
    """
    number = r"'^([+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?)?$'"
    place = (f"get(filter(sequence(9, size(p) - 10), i -> p[i] rlike {number} and p[i + 1] rlike {number} "
             f"and p[i + 2] rlike {number}), 0)")
    read = (f"transform(array({place}), i -> if(i is null, null, concat(slice(p, 1, 8), "
            "array(array_join(slice(p, 9, i - 8), ',')), slice(p, i + 1, 5), "
            "array(array_join(slice(p, i + 6, size(p) - i - 9), ',')), slice(p, size(p) - 3, 4))))[0]")
    return F.split(line, ",", -1), read


def read_text_log(spark: SparkSession, path: str) -> DataFrame:
    """The text log's rows (without ids): unquoted lines, each in UTF-8 or code page 1252; header and blank lines left out.

    A line that cannot be read as 19 fields keeps only its text, in ``_corrupt_record``.
    """
    lines = spark.read.text(path).select(decoded(F.col("value").cast("binary")).alias("line"))
    lines = lines.where((F.trim("line") != "") & ~F.col("line").startswith("timestamp,"))
    parts, read = _fields(F.regexp_replace("line", "\r$", ""))
    cells = lines.withColumn("p", parts).withColumn("p", F.expr(f"if(size(p) < 19, null, {read})"))
    kinds = {f.name: f.dataType for f in PREDICTION_LOG.fields}

    def value(k: int, name: str) -> Column:
        text = F.nullif(F.trim(F.get("p", F.lit(k))), F.lit(""))
        if kinds[name] == T.BooleanType():
            low = F.lower(text)
            return F.when(low.isin("true", "1"), True).when(low.isin("false", "0"), False)
        return F.nullif(F.get("p", F.lit(k)), F.lit("")) if kinds[name] == T.StringType() else text.try_cast(kinds[name])

    return cells.select(F.lit(None).cast("long").alias("prediction_id"),
                        *[value(k, c).alias(c) for k, c in enumerate(TEXT_COLUMNS)],
                        F.when(F.col("p").isNull(), F.col("line")).alias("_corrupt_record"))


def write_text_log(log: DataFrame, path: str) -> None:
    """IO-3's text form: unquoted lines in UTF-8."""
    texts = [F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if c == "timestamp" else F.col(c).cast("string"), F.lit(""))
             for c in TEXT_COLUMNS]
    log.select(F.concat_ws(",", *texts).alias("value")).write.text(path)


def backfill_outcomes(log: DataFrame, outcomes: DataFrame) -> DataFrame:
    """J-10: attach observed outcomes (by id) and mark whether the call was right.

    ``outcomes``: prediction_id, priority, requires_road_closure, duration_minutes.
    """
    o = outcomes.select(
        F.col("prediction_id").alias("_pid"), F.col("priority").alias("_ap"),
        F.col("requires_road_closure").cast("int").alias("_ac"),
        F.col("duration_minutes").alias("_ad"))
    j = log.join(o, log.prediction_id == o._pid, "left")
    correct = F.when(F.col("_ap").isNotNull(),
                     (F.col("priority_prob") > 0.5) == (F.col("_ap") == "High"))
    return j.select(
        *[c for c in LOG_COLUMNS if c not in ("actual_priority", "actual_closure",
                                              "actual_duration_min", "feedback_correct")],
        F.coalesce(F.col("actual_priority"), F.col("_ap")).alias("actual_priority"),
        F.coalesce(F.col("actual_closure"), F.col("_ac")).alias("actual_closure"),
        F.coalesce(F.col("actual_duration_min"), F.col("_ad")).alias("actual_duration_min"),
        F.coalesce(F.col("feedback_correct"), correct).alias("feedback_correct"))


OUTCOME = "prediction_id long, observed_at timestamp, priority string, requires_road_closure int, duration_minutes double"


def upsert_outcomes(spark: SparkSession, log_path: str, outcomes_path: str, arrived: DataFrame) -> list:
    """J-10 on the stored log: remember outcomes that arrived and rewrite the days that they name; returns those days.

    ``arrived``: prediction_id, observed_at, priority, requires_road_closure, duration_minutes.  Of several outcomes of
    one prediction the last observed counts, whatever the order of arrival, so a repeated or late batch, or a run again after a
    failure, leaves the same rows.
    """
    names = [c.split()[0] for c in OUTCOME.split(", ")]
    stamp = uuid.uuid4().hex
    (arrived.select(*[F.col(c).cast(k).alias(c) for c, k in (x.split() for x in OUTCOME.split(", "))])
     .where("prediction_id is not null").write.mode("append").parquet(f"{outcomes_path}/{stamp}"))
    now = spark.read.schema(OUTCOME).parquet(f"{outcomes_path}/{stamp}").select("prediction_id").distinct()
    log = spark.read.parquet(log_path)
    days = [r["log_date"] for r in log.join(now, "prediction_id", "left_semi").select("log_date").distinct().collect()]
    if not days:
        return []
    touched = log.where(F.col("log_date").isin([d for d in days if d is not None])
                        | (F.col("log_date").isNull() if None in days else F.lit(False)))
    rest = F.struct("observed_at", *[c for c in names if c not in ("prediction_id", "observed_at")])
    newest = (spark.read.schema(OUTCOME).option("recursiveFileLookup", "true").parquet(outcomes_path)
              .groupBy("prediction_id").agg(F.max(rest).alias("o")))
    actual = ("actual_priority", "actual_closure", "actual_duration_min", "feedback_correct")
    right = F.when(F.col("o.priority").isNotNull(), (F.col("priority_prob") > 0.5) == (F.col("o.priority") == "High"))
    known = F.col("o").isNotNull()
    joined = touched.join(newest, "prediction_id", "left").select(
        *[c for c in LOG_COLUMNS if c not in actual],
        *[F.when(known, v).otherwise(F.col(c)).alias(c) for c, v in zip(actual, (
            F.col("o.priority"), F.col("o.requires_road_closure"), F.col("o.duration_minutes"), right))], "log_date")
    # the new files are staged beside the days and take their place when all are written, so the days can be read meanwhile
    (joined.hint("rebalance", "log_date").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("log_date").parquet(log_path))
    return sorted(days, key=str)
