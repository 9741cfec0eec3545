"""DuckDB reference SQL for the correctness gate.

Each query is written independently of the Spark code (the geohash is a
recursive bisection, not the bit formula) and runs against the driver's
pre-registered parquet views.  Doubles are rounded to 6 digits in both
engines so the order of floating-point summation does not matter.
"""

from __future__ import annotations

from textwrap import dedent

D = "::DOUBLE"

# The places of the fixture, and the corridors that messages ask for.
_ZONES = """['Central Zone 1', 'Central Zone 2', 'East Zone 1', 'East Zone 2', 'North Zone 1', 'North Zone 2', 'South Zone 1',
  'South Zone 2', 'West Zone 1', 'West Zone 2']"""
_CORRIDORS = """['Mysore Road', 'Bellary Road 1', 'Bellary Road 2', 'Tumkur Road', 'Hosur Road', 'ORR North 1', 'ORR East 1',
  'Old Madras Road', 'Ring Road']"""
_ASKED = """['Mysore Road', 'Bellary Road 1', 'Bellary Road 2', 'Tumkur Road', 'Hosur Road', 'ORR North 1', 'ORR East 1',
  'Old Madras Road', 'Magadi Road']"""

RAW = f"""
incidents_raw AS (
  SELECT event_id AS incident_id,
    CASE WHEN event_id % 5 = 0 THEN 'planned' ELSE 'unplanned' END AS event_type,
    CASE WHEN event_id % 101 = 0 THEN 'test_demo'
         WHEN event_id % 103 = 1 THEN 'Fog / Low Visibility'
         WHEN event_id % 3 = 0 THEN ' ' || upper(event_type)
         ELSE event_type END AS event_cause,
    CASE WHEN event_id % 11 <> 0 THEN 'veh_' || CAST(event_id % 7 AS VARCHAR) END AS veh_type,
    CASE WHEN event_id % 50 <> 7 THEN {_ZONES}[user_id % 10 + 1] END AS zone,
    CASE WHEN user_id % 4 = 0 THEN 'Non-corridor'
         WHEN event_id % 2 = 0 THEN {_CORRIDORS}[user_id % 9 + 1]
         ELSE upper({_CORRIDORS}[user_id % 9 + 1]) || ' ' END AS corridor,
    'PS ' || CAST(user_id % 20 AS VARCHAR) AS police_station,
    CASE WHEN event_id % 3 <> 0 THEN 'J' || CAST(event_id % 40 AS VARCHAR) END AS junction,
    CASE WHEN event_id % 200 <> 13 THEN CASE WHEN value > CASE user_id % 3 WHEN 0 THEN 8 WHEN 1 THEN 35 ELSE 80 END THEN 'High' ELSE 'Low' END END AS priority,
    (event_type = 'error' OR event_id % 37 = 0) AS requires_road_closure,
    CASE WHEN event_id % 97 = 0 THEN 0.0{D}
         WHEN event_id % 10 = 9 THEN 12.75{D} + ((event_id * 7919) % 5500){D} / 10000.0{D}
         ELSE 12.8{D} + ((user_id % 15) * 300 + (event_id * 7919) % 81 - 40){D} / 10000.0{D}
    END AS latitude,
    CASE WHEN event_id % 89 = 0 THEN NULL{D}
         WHEN event_id % 10 = 9 THEN 77.25{D} + ((event_id * 104729) % 6000){D} / 10000.0{D}
         ELSE 77.3{D} + (((user_id // 15) % 10) * 500 + (event_id * 104729) % 81 - 40){D} / 10000.0{D}
    END AS longitude,
    strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS start_datetime,
    CASE WHEN event_id % 10 < 6 THEN strftime(ts + to_seconds(CAST(floor(value * 120) AS BIGINT)),
         '%Y-%m-%d %H:%M:%S.%f') END AS end_datetime,
    CASE WHEN event_id % 10 < 4 THEN strftime(ts + to_seconds(CAST(floor(value * 60) AS BIGINT) - 30),
         '%Y-%m-%d %H:%M:%S.%f') END AS closed_datetime,
    strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS created_date,
    ts AS src_ts, value AS src_value
  FROM events)"""

PREP = f"""
c_cause AS (
  SELECT * REPLACE (
    CASE WHEN lower(trim(event_cause)) = 'fog / low visibility' THEN 'fog_low_visibility'
         ELSE lower(trim(event_cause)) END AS event_cause)
  FROM incidents_raw),
c_ts AS (
  SELECT * REPLACE (TRY_CAST(start_datetime AS TIMESTAMP) AS start_datetime,
                    TRY_CAST(end_datetime AS TIMESTAMP) AS end_datetime,
                    TRY_CAST(closed_datetime AS TIMESTAMP) AS closed_datetime,
                    TRY_CAST(created_date AS TIMESTAMP) AS created_date)
  FROM c_cause WHERE event_cause IS DISTINCT FROM 'test_demo'),
c_dur AS (
  SELECT *,
    CASE WHEN closed_datetime IS NOT NULL AND start_datetime IS NOT NULL
           THEN (epoch_us(closed_datetime) - epoch_us(start_datetime)){D} / 60000000.0{D}
         WHEN end_datetime IS NOT NULL AND start_datetime IS NOT NULL
           THEN (epoch_us(end_datetime) - epoch_us(start_datetime)){D} / 60000000.0{D}
    END AS duration_minutes
  FROM c_ts),
c_box AS (
  SELECT * REPLACE (lower(trim(corridor)) AS corridor),
    CAST(hour(start_datetime) AS INTEGER) AS raw_hour,
    CAST(isodow(start_datetime) - 1 AS INTEGER) AS raw_dow,
    CAST(month(start_datetime) AS INTEGER) AS raw_month
  FROM c_dur
  WHERE (duration_minutes IS NULL OR (duration_minutes > 0 AND duration_minutes < 10080))
    AND latitude BETWEEN 12.75{D} AND 13.30{D} AND longitude BETWEEN 77.25{D} AND 77.85{D}),
gh_rec(incident_id, lat, lon, la0, la1, lo0, lo1, code, k) AS (
  SELECT incident_id, latitude, longitude, -90.0{D}, 90.0{D}, -180.0{D}, 180.0{D}, 0::BIGINT, 0
  FROM c_box
  UNION ALL
  SELECT incident_id, lat, lon,
    CASE WHEN k % 2 = 1 AND lat > (la0 + la1) / 2 THEN (la0 + la1) / 2 ELSE la0 END,
    CASE WHEN k % 2 = 1 AND NOT (lat > (la0 + la1) / 2) THEN (la0 + la1) / 2 ELSE la1 END,
    CASE WHEN k % 2 = 0 AND lon > (lo0 + lo1) / 2 THEN (lo0 + lo1) / 2 ELSE lo0 END,
    CASE WHEN k % 2 = 0 AND NOT (lon > (lo0 + lo1) / 2) THEN (lo0 + lo1) / 2 ELSE lo1 END,
    code * 2 + CASE WHEN k % 2 = 0 THEN CAST(lon > (lo0 + lo1) / 2 AS BIGINT)
                    ELSE CAST(lat > (la0 + la1) / 2 AS BIGINT) END,
    k + 1
  FROM gh_rec WHERE k < 30),
gh AS (
  SELECT incident_id,
    substr('0123456789bcdefghjkmnpqrstuvwxyz', CAST(((code >> 25) & 31) + 1 AS INTEGER), 1) ||
    substr('0123456789bcdefghjkmnpqrstuvwxyz', CAST(((code >> 20) & 31) + 1 AS INTEGER), 1) ||
    substr('0123456789bcdefghjkmnpqrstuvwxyz', CAST(((code >> 15) & 31) + 1 AS INTEGER), 1) ||
    substr('0123456789bcdefghjkmnpqrstuvwxyz', CAST(((code >> 10) & 31) + 1 AS INTEGER), 1) ||
    substr('0123456789bcdefghjkmnpqrstuvwxyz', CAST(((code >> 5) & 31) + 1 AS INTEGER), 1) ||
    substr('0123456789bcdefghjkmnpqrstuvwxyz', CAST((code & 31) + 1 AS INTEGER), 1) AS geohash6
  FROM gh_rec WHERE k = 30),
prepared AS (
  SELECT b.* EXCLUDE (raw_hour, raw_dow, raw_month, junction),
    coalesce(b.junction, 'unknown_junction') AS junction,
    coalesce(raw_hour, 12) AS hour,
    coalesce(raw_dow, 0) AS day_of_week,
    coalesce(raw_month, 1) AS month,
    coalesce(CAST(raw_dow IN (5, 6) AS INTEGER), 0) AS is_weekend,
    coalesce(CAST(raw_hour IN (7, 8, 9, 17, 18, 19, 20) AS INTEGER), 0) AS is_peak_hour,
    CASE WHEN raw_hour > -1 AND raw_hour <= 5 THEN 'night'
         WHEN raw_hour > 5 AND raw_hour <= 11 THEN 'morning'
         WHEN raw_hour > 11 AND raw_hour <= 16 THEN 'afternoon'
         WHEN raw_hour > 16 AND raw_hour <= 20 THEN 'evening'
         WHEN raw_hour > 20 AND raw_hour <= 24 THEN 'late_evening' END AS time_of_day,
    sin(2 * pi() * raw_hour / 24.0{D}) AS hour_sin, cos(2 * pi() * raw_hour / 24.0{D}) AS hour_cos,
    sin(2 * pi() * raw_month / 12.0{D}) AS month_sin, cos(2 * pi() * raw_month / 12.0{D}) AS month_cos,
    sin(2 * pi() * raw_dow / 7.0{D}) AS dow_sin, cos(2 * pi() * raw_dow / 7.0{D}) AS dow_cos,
    g.geohash6,
    CASE WHEN priority = 'High' THEN 1 ELSE 0 END AS priority_binary,
    CAST(requires_road_closure AS INTEGER) AS road_closure_binary,
    CASE WHEN event_type = 'planned' THEN 1 ELSE 0 END AS is_planned,
    CASE WHEN raw_hour > 11 AND raw_hour <= 16 THEN 1 ELSE 0 END AS time_of_day_afternoon,
    CASE WHEN raw_hour > 16 AND raw_hour <= 20 THEN 1 ELSE 0 END AS time_of_day_evening,
    CASE WHEN raw_hour > 20 AND raw_hour <= 24 THEN 1 ELSE 0 END AS time_of_day_late_evening,
    CASE WHEN raw_hour > 5 AND raw_hour <= 11 THEN 1 ELSE 0 END AS time_of_day_morning,
    CASE WHEN CAST('0x' || substr(md5(CAST(b.incident_id AS VARCHAR) || '#42'), 1, 8) AS BIGINT)
              % 1000 < 200 THEN 'test' ELSE 'train' END AS split
  FROM c_box b JOIN gh g USING (incident_id)),
train AS (SELECT * FROM prepared WHERE split = 'train')"""

LOOKUPS = """
lk_cell AS (
  SELECT geohash6, count(event_cause) AS geo_event_count,
    avg(CASE WHEN priority = 'High' THEN 1 ELSE 0 END) AS geo_high_priority_rate,
    avg(CAST(requires_road_closure AS INTEGER)) AS geo_closure_rate,
    avg(duration_minutes) AS geo_avg_duration
  FROM train WHERE geohash6 IS NOT NULL GROUP BY geohash6),
lk_zone_hour AS (
  SELECT zone, hour, count(*) AS zone_hour_event_count
  FROM train WHERE zone IS NOT NULL GROUP BY zone, hour),
lk_corridor AS (
  SELECT corridor, avg(CASE WHEN priority = 'High' THEN 1 ELSE 0 END) AS corridor_risk_score
  FROM train WHERE corridor IS NOT NULL GROUP BY corridor),
lk_cause AS (
  SELECT event_cause, avg(road_closure_binary) AS cause_closure_rate,
    avg(duration_minutes) AS cause_avg_duration
  FROM train WHERE event_cause IS NOT NULL GROUP BY event_cause),
lk_cause_zone AS (
  SELECT event_cause, zone, avg(road_closure_binary) AS cause_zone_closure
  FROM train WHERE event_cause IS NOT NULL AND zone IS NOT NULL GROUP BY event_cause, zone),
lk_high_risk AS (SELECT event_cause FROM lk_cause WHERE cause_closure_rate >= 0.3),
joined AS (
  SELECT p.*, c.geo_event_count, c.geo_high_priority_rate, c.geo_closure_rate, c.geo_avg_duration,
    zh.zone_hour_event_count, co.corridor_risk_score, ca.cause_closure_rate, ca.cause_avg_duration,
    cz.cause_zone_closure
  FROM prepared p
  LEFT JOIN lk_cell c ON p.geohash6 = c.geohash6
  LEFT JOIN lk_zone_hour zh ON p.zone = zh.zone AND p.hour = zh.hour
  LEFT JOIN lk_corridor co ON p.corridor = co.corridor
  LEFT JOIN lk_cause ca ON p.event_cause = ca.event_cause
  LEFT JOIN lk_cause_zone cz ON p.event_cause = cz.event_cause AND p.zone = cz.zone),
medians AS (
  SELECT
    quantile_cont(geo_event_count, 0.5) AS m_geo_event_count,
    quantile_cont(geo_high_priority_rate, 0.5) AS m_geo_high_priority_rate,
    quantile_cont(geo_closure_rate, 0.5) AS m_geo_closure_rate,
    quantile_cont(geo_avg_duration, 0.5) AS m_geo_avg_duration,
    quantile_cont(zone_hour_event_count, 0.5) AS m_zone_hour_event_count,
    quantile_cont(corridor_risk_score, 0.5) AS m_corridor_risk_score,
    quantile_cont(cause_closure_rate, 0.5) AS m_cause_closure_rate,
    quantile_cont(cause_avg_duration, 0.5) AS m_cause_avg_duration,
    quantile_cont(cause_zone_closure, 0.5) AS m_cause_zone_closure
  FROM joined WHERE split = 'train'),
iqr AS (
  SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper
  FROM (SELECT quantile_cont(duration_minutes, 0.25) AS q1,
               quantile_cont(duration_minutes, 0.75) AS q3 FROM train)),
mode_rank AS (
  SELECT col, val, row_number() OVER (PARTITION BY col ORDER BY n DESC, val ASC) AS rk
  FROM (SELECT col, val, count(*) AS n FROM (
          SELECT 'event_cause' AS col, event_cause AS val FROM train UNION ALL
          SELECT 'veh_type', veh_type FROM train UNION ALL
          SELECT 'zone', zone FROM train UNION ALL
          SELECT 'corridor', corridor FROM train UNION ALL
          SELECT 'police_station', police_station FROM train)
        WHERE val IS NOT NULL GROUP BY col, val)),
modes AS (
  SELECT max(CASE WHEN col = 'event_cause' THEN val END) AS event_cause,
         max(CASE WHEN col = 'veh_type' THEN val END) AS veh_type,
         max(CASE WHEN col = 'zone' THEN val END) AS zone,
         max(CASE WHEN col = 'corridor' THEN val END) AS corridor,
         max(CASE WHEN col = 'police_station' THEN val END) AS police_station
  FROM mode_rank WHERE rk = 1),
features AS (
  SELECT j.* REPLACE (
      coalesce(j.geo_event_count, m.m_geo_event_count) AS geo_event_count,
      coalesce(j.geo_high_priority_rate, m.m_geo_high_priority_rate) AS geo_high_priority_rate,
      coalesce(j.geo_closure_rate, m.m_geo_closure_rate) AS geo_closure_rate,
      coalesce(j.geo_avg_duration, m.m_geo_avg_duration) AS geo_avg_duration,
      coalesce(j.zone_hour_event_count, m.m_zone_hour_event_count) AS zone_hour_event_count,
      coalesce(j.corridor_risk_score, m.m_corridor_risk_score) AS corridor_risk_score,
      coalesce(j.cause_closure_rate, m.m_cause_closure_rate) AS cause_closure_rate,
      coalesce(j.cause_avg_duration, m.m_cause_avg_duration) AS cause_avg_duration,
      coalesce(j.cause_zone_closure, m.m_cause_zone_closure) AS cause_zone_closure,
      CASE WHEN j.duration_minutes IS NULL THEN NULL
           ELSE least(greatest(j.duration_minutes, i.lower), i.upper) END AS duration_minutes,
      coalesce(j.event_cause, mo.event_cause) AS event_cause,
      coalesce(j.veh_type, mo.veh_type) AS veh_type,
      coalesce(j.zone, mo.zone) AS zone,
      coalesce(j.corridor, mo.corridor) AS corridor,
      coalesce(j.police_station, mo.police_station) AS police_station)
  FROM joined j, medians m, iqr i, modes mo),
features2 AS (
  SELECT f.*,
    f.geo_closure_rate * f.is_peak_hour AS geo_closure_x_peak,
    f.geo_event_count / (f.zone_hour_event_count + 1) AS geo_event_density,
    f.cause_avg_duration * f.cause_closure_rate AS duration_x_closure_risk,
    ln(1 + f.geo_event_count) AS log_geo_event_count,
    CASE WHEN f.event_cause IN (SELECT event_cause FROM lk_high_risk) THEN 1 ELSE 0 END
      AS is_high_risk_cause
  FROM features f)"""

BASE = [RAW, PREP, LOOKUPS]


def with_base(final_sql: str, extra_ctes: str = "") -> str:
    ctes = ",".join(BASE) + ("," + extra_ctes if extra_ctes else "")
    return dedent(f"WITH RECURSIVE {ctes}\n{final_sql}")


def rounded(sql: str, double_cols: list[str], digits: int = 6, nudge: str = "") -> str:
    if not double_cols:
        return sql
    rep = ", ".join(f"round({c}{nudge}, {digits}) + 0.0::DOUBLE AS {c}" for c in double_cols)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) _q"


FEATURE_DOUBLES = ["latitude", "longitude", "duration_minutes", "hour_sin", "hour_cos",
                   "month_sin", "month_cos", "dow_sin", "dow_cos"]

SQL = {
    "incident_features": rounded(with_base("""
SELECT incident_id, event_type, event_cause, veh_type, zone, corridor, police_station, junction,
  priority, requires_road_closure, latitude, longitude, duration_minutes, hour, day_of_week, month,
  is_weekend, is_peak_hour, time_of_day, hour_sin, hour_cos, month_sin, month_cos, dow_sin, dow_cos,
  geohash6, priority_binary, road_closure_binary, is_planned, time_of_day_afternoon,
  time_of_day_evening, time_of_day_late_evening, time_of_day_morning, split
FROM prepared"""), FEATURE_DOUBLES),
    "geo_stats": rounded(with_base("SELECT * FROM lk_cell"),
                         ["geo_high_priority_rate", "geo_closure_rate", "geo_avg_duration"]),
}

TRAINING_DOUBLES = FEATURE_DOUBLES + [
    "geo_event_count", "geo_high_priority_rate", "geo_closure_rate", "geo_avg_duration",
    "zone_hour_event_count", "corridor_risk_score", "cause_closure_rate", "cause_avg_duration",
    "cause_zone_closure", "geo_closure_x_peak", "geo_event_density", "duration_x_closure_risk",
    "log_geo_event_count"]
MEDIAN_NAMES = ["geo_event_count", "geo_high_priority_rate", "geo_closure_rate",
                "geo_avg_duration", "zone_hour_event_count", "corridor_risk_score",
                "cause_closure_rate", "cause_avg_duration", "cause_zone_closure"]

SQL.update({
    "zone_hour_counts": with_base("SELECT * FROM lk_zone_hour"),
    "corridor_risk": rounded(with_base("SELECT * FROM lk_corridor"), ["corridor_risk_score"]),
    "cause_stats": rounded(with_base("SELECT * FROM lk_cause"),
                           ["cause_closure_rate", "cause_avg_duration"]),
    "cause_zone_closure": rounded(with_base("SELECT * FROM lk_cause_zone"), ["cause_zone_closure"]),
    "high_risk_causes": with_base("SELECT * FROM lk_high_risk"),
    "train_medians": rounded(with_base(
        "SELECT " + ", ".join(f"m_{c} AS {c}" for c in MEDIAN_NAMES) + " FROM medians"),
        MEDIAN_NAMES),
    "iqr_bounds": rounded(with_base("SELECT q1, q3, lower, upper FROM iqr"),
                          ["q1", "q3", "lower", "upper"]),
    "category_modes": with_base("SELECT * FROM modes"),
    "training_features": rounded(with_base("""
SELECT incident_id, event_type, event_cause, veh_type, zone, corridor, police_station, junction,
  priority, requires_road_closure, latitude, longitude, duration_minutes, hour, day_of_week, month,
  is_weekend, is_peak_hour, time_of_day, hour_sin, hour_cos, month_sin, month_cos, dow_sin, dow_cos,
  geohash6, priority_binary, road_closure_binary, is_planned, time_of_day_afternoon,
  time_of_day_evening, time_of_day_late_evening, time_of_day_morning, split,
  geo_event_count, geo_high_priority_rate, geo_closure_rate, geo_avg_duration,
  zone_hour_event_count, corridor_risk_score, cause_closure_rate, cause_avg_duration,
  cause_zone_closure, geo_closure_x_peak, geo_event_density, duration_x_closure_risk,
  log_geo_event_count, is_high_risk_cause
FROM features2"""), TRAINING_DOUBLES),
})

# ---------------------------------------------------------------------------
# dashboard, prediction log, drift, EMA, messages
# ---------------------------------------------------------------------------
from ..functions import keywords as _kw  # noqa: E402
from ..functions import rules as _r  # noqa: E402


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_PUBLIC = ", ".join(_q(c) for c in _r.PUBLIC_EVENT_CAUSES)
_T = f"{_r.DEFAULT_CLOSURE_THRESHOLD}{D}"
_MANPOWER = f"""CASE WHEN event_cause IN ({_PUBLIC}) THEN {_q(_r.PUBLIC_EVENT_MANPOWER)}
    WHEN priority_prob >= 0.75{D} THEN {_q(_r.MANPOWER_HIGH)}
    WHEN priority_prob >= 0.45{D} THEN {_q(_r.MANPOWER_MEDIUM)}
    ELSE {_q(_r.MANPOWER_LOW)} END"""
_BARRICADE = f"""CASE WHEN event_cause IN ({_PUBLIC}) THEN {_q(_r.PUBLIC_EVENT_BARRICADE)}
    WHEN closure_prob >= {_T} THEN {_q(_r.BARRICADE_FULL)}
    WHEN closure_prob >= {_T} * 0.5{D} THEN {_q(_r.BARRICADE_PARTIAL)}
    ELSE {_q(_r.BARRICADE_MINIMAL)} END"""
_DIVERSION = f"""CASE WHEN closure_prob >= {_T} AND hour IN (7, 8, 9, 17, 18, 19, 20)
      THEN {_q(_r.DIVERSION_URGENT)}
    WHEN closure_prob >= {_T} * 0.75{D} OR duration_est_min > 90 THEN {_q(_r.DIVERSION_RECOMMENDED)}
    ELSE {_q(_r.DIVERSION_MONITOR)} END"""

LOG_CTES = f"""
plog_scored AS (
  SELECT incident_id AS prediction_id, src_ts AS "timestamp", latitude, longitude,
    CAST(hour(src_ts) AS INTEGER) AS hour, CAST(isodow(src_ts) - 1 AS INTEGER) AS day_of_week,
    CAST(month(src_ts) AS INTEGER) AS month, event_cause, zone, corridor,
    ((incident_id * 7919) % 10000){D} / 10000.0{D} AS priority_prob,
    ((incident_id * 104729) % 10000){D} / 10000.0{D} AS closure_prob,
    src_value AS duration_est_min
  FROM incidents_raw),
plog AS (
  SELECT *, substr({_MANPOWER}, 1, 10) AS manpower_level,
    substr({_BARRICADE}, 1, 10) AS barricading_level,
    substr({_DIVERSION}, 1, 10) AS diversion_level,
    NULL::VARCHAR AS actual_priority, NULL::INTEGER AS actual_closure,
    NULL{D} AS actual_duration_min, NULL::BOOLEAN AS feedback_correct
  FROM plog_scored),
plog_asof AS (SELECT max("timestamp") AS as_of FROM plog),
plog_half AS (
  SELECT *, CASE WHEN row_number() OVER (ORDER BY "timestamp", prediction_id)
                      <= (SELECT count(*) FROM plog) // 2 THEN 'ref' ELSE 'cur' END AS half
  FROM plog)"""

_TSF = "'%Y-%m-%d %H:%M:%S.%f'"
_LOG_SELECT = f"""prediction_id, strftime("timestamp", {_TSF}) AS "timestamp", latitude, longitude,
  hour, day_of_week, month, event_cause, zone, corridor, priority_prob, closure_prob,
  duration_est_min, manpower_level, barricading_level, diversion_level, actual_priority,
  actual_closure, actual_duration_min, feedback_correct"""
_LOG_DOUBLES = ["latitude", "longitude", "priority_prob", "closure_prob", "duration_est_min",
                "actual_duration_min"]


def _psi_sql(long_cte: str, group: str) -> str:
    """PSI over (group, side, v) rows of ``long_cte``: joint edges, 10 bins, +1."""
    return f"""
b AS (SELECT {group}, count(*) AS n_all,
        min(v) FILTER (WHERE v IS NOT NULL AND NOT isnan(v)) AS lo,
        max(v) FILTER (WHERE v IS NOT NULL AND NOT isnan(v)) AS hi,
        count(*) FILTER (WHERE v IS NOT NULL AND NOT isnan(v) AND side = 'ref') AS n_ref,
        count(*) FILTER (WHERE v IS NOT NULL AND NOT isnan(v) AND side = 'cur') AS n_cur
      FROM {long_cte} GROUP BY {group}),
binned AS (
  SELECT l.{group}, l.side,
    CASE WHEN b.hi = b.lo THEN 9
         ELSE least(CAST(floor((l.v - b.lo) / ((b.hi - b.lo) / 10.0{D})) AS INTEGER), 9) END AS bin
  FROM {long_cte} l JOIN b USING ({group}) WHERE l.v IS NOT NULL AND NOT isnan(l.v)),
cnt AS (SELECT {group}, bin, count(*) FILTER (WHERE side = 'ref') AS r,
          count(*) FILTER (WHERE side = 'cur') AS c FROM binned GROUP BY {group}, bin),
dense AS (SELECT b.{group}, s.bin FROM b, (SELECT unnest(range(10)) AS bin) s
          WHERE b.lo IS NOT NULL),
full_bins AS (
  SELECT d.{group}, coalesce(cnt.r, 0) + 1 AS r, coalesce(cnt.c, 0) + 1 AS c
  FROM dense d LEFT JOIN cnt ON d.{group} = cnt.{group} AND d.bin = cnt.bin),
pct AS (SELECT {group}, r / sum(r) OVER (PARTITION BY {group}) AS rp,
          c / sum(c) OVER (PARTITION BY {group}) AS cp FROM full_bins),
psi AS (SELECT {group}, sum((cp - rp) * ln(cp / rp)) AS psi FROM pct GROUP BY {group})"""


def _contains_chain(col: str, pairs, longest: bool = True) -> str:
    seq = _kw.by_length(pairs) if longest else pairs
    arms = "\n      ".join(f"WHEN contains({col}, {_q(k)}) THEN {_q(v) if isinstance(v, str) else v}"
                           for k, v in seq)
    return f"CASE {arms} END"


def _any_sql(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {_q(w)})" for w in words) + ")"


_TOPIC = "CASE " + " ".join(
    f"WHEN {_any_sql('low', ws)} THEN {_q(t)}" for t, ws in _kw.EXPLAIN_TOPICS) + " ELSE 'generic' END"
_WORDS = "[" + ", ".join(_q(k) for k, _ in _kw.CAUSE_KEYWORDS) + "]"
_SAMPLES = "[" + ", ".join(_q(t) for t in _kw.SAMPLE_MESSAGES) + "]"
_HELP = ", ".join(_q(h) for h in _kw.HELP_EXACT)

MSGS_FIXTURE = f"""
msgs AS (
  SELECT incident_id AS message_id, src_ts AS sent_at,
    CASE WHEN incident_id % 7 = 0 THEN {_SAMPLES}[((incident_id // 7) % {len(_kw.SAMPLE_MESSAGES)}) + 1]
         WHEN incident_id % 14 = 1 THEN 'Compare ' || {_ASKED}[(incident_id // 14) % 9 + 1] || ' vs '
              || {_ASKED}[(incident_id // 14 + 4) % 9 + 1]
         WHEN incident_id % 14 = 2 THEN 'compare ' || {_ZONES}[(incident_id // 14) % 10 + 1] || ' versus '
              || {_ZONES}[(incident_id // 14 + 3) % 10 + 1]
         ELSE {_WORDS}[(incident_id % {len(_kw.CAUSE_KEYWORDS)}) + 1] || ' at '
              || printf('%.4f', coalesce(latitude, 0.0{D})) || ', '
              || printf('%.4f', coalesce(longitude, 0.0{D})) || ' at '
              || CAST(incident_id % 12 + 1 AS VARCHAR)
              || CASE WHEN incident_id % 2 = 0 THEN 'am' ELSE 'pm' END END AS text
  FROM incidents_raw)"""
PARSE_CTES = f"""
m1 AS (
  SELECT message_id, sent_at, text, lower(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))) AS low,
    regexp_extract(text, {_q(_kw.LAT_LON_PATTERN)}, 1) AS lat_s,
    regexp_extract(text, {_q(_kw.LAT_LON_PATTERN)}, 2) AS lon_s
  FROM msgs),
m2 AS (
  SELECT *,
    CASE WHEN regexp_extract(low, {_q(_kw.AMPM_PATTERN)}, 1) <> '' THEN
           CASE WHEN regexp_extract(low, {_q(_kw.AMPM_PATTERN)}, 2) = 'pm'
                     AND CAST(regexp_extract(low, {_q(_kw.AMPM_PATTERN)}, 1) AS INTEGER) < 12
                  THEN CAST(regexp_extract(low, {_q(_kw.AMPM_PATTERN)}, 1) AS INTEGER) + 12
                WHEN regexp_extract(low, {_q(_kw.AMPM_PATTERN)}, 2) = 'am'
                     AND CAST(regexp_extract(low, {_q(_kw.AMPM_PATTERN)}, 1) AS INTEGER) = 12
                  THEN 0
                ELSE CAST(regexp_extract(low, {_q(_kw.AMPM_PATTERN)}, 1) AS INTEGER) END
         WHEN regexp_extract(low, {_q(_kw.HOUR24_PATTERN)}, 1) <> ''
           THEN CAST(regexp_extract(low, {_q(_kw.HOUR24_PATTERN)}, 1) AS INTEGER)
         WHEN regexp_extract(low, {_q(_kw.AT_HOUR_PATTERN)}, 1) <> ''
           THEN CAST(regexp_extract(low, {_q(_kw.AT_HOUR_PATTERN)}, 1) AS INTEGER) END AS h_raw,
    CASE WHEN lat_s <> '' THEN CAST(lat_s AS DOUBLE) END AS lat_v,
    CASE WHEN lon_s <> '' THEN CAST(lon_s AS DOUBLE) END AS lon_v,
    {_contains_chain('low', _kw.CAUSE_KEYWORDS)} AS cause_v,
    {_contains_chain('low', _kw.ZONE_KEYWORDS)} AS zone_v,
    {_contains_chain('low', _kw.CORRIDOR_KEYWORDS)} AS corridor_v,
    {_contains_chain('low', _kw.DAY_KEYWORDS, longest=False)} AS day_v
  FROM m1),
m3 AS (
  SELECT *, CASE WHEN h_raw IS NOT NULL THEN least(greatest(h_raw, 0), 23) END AS hour_v,
    CASE WHEN low IN ({_HELP}) THEN 'help'
         WHEN {_any_sql('low', _kw.STATUS_WORDS)} THEN 'status'
         WHEN {_any_sql('low', _kw.COMPARE_WORDS)} THEN 'compare'
         WHEN {_any_sql('low', _kw.HOTSPOT_WORDS)} THEN 'hotspot'
         WHEN {_any_sql('low', _kw.EXPLAIN_WORDS)} THEN 'explain'
         WHEN lat_v IS NOT NULL OR cause_v IS NOT NULL OR h_raw IS NOT NULL THEN 'predict'
         ELSE 'help' END AS intent
  FROM m2),
parsed AS (
  SELECT message_id, sent_at, low, intent,
    intent = 'help' AND low NOT IN ({_HELP}) AS fallback,
    CASE WHEN intent = 'predict' THEN lat_v END AS latitude,
    CASE WHEN intent = 'predict' THEN lon_v END AS longitude,
    CASE WHEN intent = 'predict' THEN hour_v END AS hour,
    CASE WHEN intent = 'predict' THEN cause_v END AS event_cause,
    CASE WHEN intent = 'predict' THEN zone_v END AS zone,
    CASE WHEN intent = 'predict' THEN corridor_v END AS corridor,
    CASE WHEN intent = 'predict' THEN day_v END AS day_of_week,
    CASE WHEN intent = 'hotspot' THEN zone_v END AS hotspot_zone,
    CASE WHEN intent = 'explain' THEN {_TOPIC} END AS explain_topic
  FROM m3),
kw_corr AS (SELECT * FROM (VALUES {", ".join(f"({i}, {_q(k)}, {_q(v)})" for i, (k, v) in enumerate(_kw.by_length(_kw.CORRIDOR_KEYWORDS)))}) t(ord, kw, name)),
kw_zone AS (SELECT * FROM (VALUES {", ".join(f"({i}, {_q(k)}, {_q(v)})" for i, (k, v) in enumerate(_kw.by_length(_kw.ZONE_KEYWORDS)))}) t(ord, kw, name)),
req AS (
  SELECT message_id, kind, name,
    CAST(row_number() OVER (PARTITION BY message_id, kind ORDER BY min(ord)) - 1 AS INTEGER) AS position
  FROM (SELECT p.message_id, 'corridor' AS kind, k.name, k.ord FROM parsed p JOIN kw_corr k
          ON p.intent = 'compare' AND contains(p.low, k.kw)
        UNION ALL
        SELECT p.message_id, 'zone', k.name, k.ord FROM parsed p JOIN kw_zone k
          ON p.intent = 'compare' AND contains(p.low, k.kw))
  GROUP BY message_id, kind, name)"""

MSG_CTES = MSGS_FIXTURE + "," + PARSE_CTES
CONV_CTES = """
msgs AS (SELECT conv_id * 1000000 + turn AS message_id, NULL::TIMESTAMP AS sent_at, text
         FROM conversations),""" + PARSE_CTES

EMA_CTES = f"""
ev AS (
  SELECT geohash6, start_datetime AS ts, incident_id AS id,
    CASE WHEN priority = 'High' THEN 1.0{D} ELSE 0.0{D} END AS x_high,
    CAST(requires_road_closure AS INTEGER){D} AS x_cl, duration_minutes AS x_d
  FROM prepared WHERE split = 'test'),
evr AS (
  SELECT *, row_number() OVER (PARTITION BY geohash6 ORDER BY ts DESC, id DESC) - 1 AS j,
    CASE WHEN x_d IS NOT NULL THEN row_number() OVER (
      PARTITION BY geohash6, x_d IS NULL ORDER BY ts DESC, id DESC) - 1 END AS jd
  FROM ev),
upd AS (
  SELECT geohash6, count(*) AS n,
    sum(0.3{D} * pow(0.7{D}, j) * x_high) AS b_high,
    sum(0.3{D} * pow(0.7{D}, j) * x_cl) AS b_cl,
    count(x_d) AS n_d,
    coalesce(sum(0.3{D} * pow(0.7{D}, jd) * x_d) FILTER (WHERE x_d IS NOT NULL), 0.0{D}) AS b_d,
    arg_max(x_high, j) AS f_high, arg_max(x_cl, j) AS f_cl,
    arg_max(x_d, jd) FILTER (WHERE x_d IS NOT NULL) AS f_d
  FROM evr GROUP BY geohash6),
ema AS (
  SELECT coalesce(o.geohash6, u.geohash6) AS geohash6,
    CAST(coalesce(o.geo_event_count, 0) + coalesce(u.n, 0) AS BIGINT) AS geo_event_count,
    CASE WHEN u.n IS NULL THEN o.geo_high_priority_rate
         ELSE pow(0.7{D}, u.n) * (CASE WHEN o.geohash6 IS NOT NULL THEN o.geo_high_priority_rate
                                       ELSE u.f_high END) + u.b_high END AS geo_high_priority_rate,
    CASE WHEN u.n IS NULL THEN o.geo_closure_rate
         ELSE pow(0.7{D}, u.n) * (CASE WHEN o.geohash6 IS NOT NULL THEN o.geo_closure_rate
                                       ELSE u.f_cl END) + u.b_cl END AS geo_closure_rate,
    CASE WHEN u.n IS NULL OR u.n_d = 0 THEN o.geo_avg_duration
         ELSE pow(0.7{D}, u.n_d) * coalesce(o.geo_avg_duration, u.f_d) + u.b_d END AS geo_avg_duration,
    CAST(coalesce(u.n, 0) AS BIGINT) AS events_applied
  FROM lk_cell o FULL OUTER JOIN upd u ON o.geohash6 = u.geohash6)"""

_FEATS = ["latitude", "longitude", "hour", "geo_event_count", "geo_closure_rate",
          "zone_hour_event_count"]
_FEAT_LONG = " UNION ALL ".join(
    f"SELECT {_q(f)} AS feature, split, CAST({f} AS DOUBLE) AS v FROM features2" for f in _FEATS)

SQL.update({
    "overview_kpis": with_base("""
SELECT count(*) AS total_events,
  CAST(count_if(event_type = 'unplanned') AS BIGINT) AS unplanned,
  CAST(count_if(priority = 'High') AS BIGINT) AS high_priority,
  CAST(count_if(requires_road_closure) AS BIGINT) AS road_closures
FROM incidents_raw"""),
    "cause_counts": with_base("""
SELECT lower(trim(event_cause)) AS cause, count(*) AS count FROM incidents_raw
WHERE event_cause IS NOT NULL GROUP BY 1"""),
    "hourly_counts": with_base("""
SELECT CAST(hour(TRY_CAST(start_datetime AS TIMESTAMP)) AS INTEGER) AS hour, count(*) AS count
FROM incidents_raw WHERE TRY_CAST(start_datetime AS TIMESTAMP) IS NOT NULL GROUP BY 1"""),
    "zone_shares": rounded(with_base("""
SELECT zone, count(*) AS count, count(*) / sum(count(*)) OVER () AS share
FROM incidents_raw WHERE zone IS NOT NULL GROUP BY zone"""), ["share"]),
    "cause_priority_counts": with_base("""
SELECT lower(trim(event_cause)) AS event_cause, priority, count(*) AS count FROM incidents_raw
WHERE event_cause IS NOT NULL AND priority IS NOT NULL GROUP BY 1, 2"""),
    "cause_priority_pivot": with_base("""
SELECT event_cause, CAST(sum(count) FILTER (WHERE priority = 'High') AS BIGINT) AS "High",
  CAST(sum(count) FILTER (WHERE priority = 'Low') AS BIGINT) AS "Low"
FROM (SELECT lower(trim(event_cause)) AS event_cause, priority, count(*) AS count
      FROM incidents_raw WHERE event_cause IS NOT NULL AND priority IS NOT NULL GROUP BY 1, 2)
GROUP BY event_cause""", ),
    "prediction_log": rounded(with_base(f"SELECT {_LOG_SELECT} FROM plog", LOG_CTES),
                              _LOG_DOUBLES),
    "log_summary": rounded(with_base(f"""
SELECT count(*) AS total,
  CAST(count_if("timestamp" >= (SELECT as_of FROM plog_asof) - INTERVAL 24 HOUR) AS BIGINT) AS last_24h,
  coalesce(round_even(avg(priority_prob) * 100, 1), 0.0{D}) AS avg_priority_risk,
  coalesce(round_even(avg(closure_prob) * 100, 1), 0.0{D}) AS avg_closure_risk
FROM plog""", LOG_CTES), ["avg_priority_risk", "avg_closure_risk"]),
    "recent_predictions": rounded(with_base(f"""
SELECT {_LOG_SELECT} FROM plog
WHERE "timestamp" >= (SELECT as_of FROM plog_asof) - INTERVAL 24 HOUR""", LOG_CTES), _LOG_DOUBLES),
    "latest_predictions": rounded(with_base(f"""
SELECT prediction_id, strftime("timestamp", {_TSF}) AS "timestamp", event_cause, zone,
  priority_prob, closure_prob, duration_est_min
FROM plog ORDER BY plog."timestamp" DESC, prediction_id DESC LIMIT 20""", LOG_CTES),
        ["priority_prob", "closure_prob", "duration_est_min"]),
    "recommendations": rounded(with_base(f"""
SELECT prediction_id,
  {_MANPOWER} AS manpower, {_BARRICADE} AS barricading, {_DIVERSION} AS diversion,
  CAST(round_even(duration_est_min, 0) AS BIGINT) AS estimated_duration_min,
  CASE WHEN priority_prob > 0.5{D} THEN 'HIGH' ELSE 'LOW' END AS priority_label,
  CASE WHEN closure_prob >= {_T} THEN 'LIKELY' ELSE 'UNLIKELY' END AS closure_label,
  CASE WHEN priority_prob * 100 < 40 THEN 'low' WHEN priority_prob * 100 < 70 THEN 'medium'
       ELSE 'high' END AS priority_band,
  priority_prob * 100 AS priority_pct, closure_prob * 100 AS closure_pct
FROM plog_scored""", LOG_CTES), ["priority_pct", "closure_pct"]),
    "score_histogram": rounded(with_base(f"""
SELECT s.bin, lo + s.bin * w AS bin_lo, lo + (s.bin + 1) * w AS bin_hi,
  CAST(coalesce(c.cnt, 0) AS BIGINT) AS count
FROM (SELECT lo, CASE WHEN hi > lo THEN (hi - lo) / 20.0{D} ELSE 1.0{D} END AS w
      FROM (SELECT min(priority_prob * 100) AS lo, max(priority_prob * 100) AS hi FROM plog)) bnd
CROSS JOIN (SELECT CAST(unnest(range(20)) AS INTEGER) AS bin) s
LEFT JOIN (
  SELECT least(CAST(floor((priority_prob * 100 - lo) / w) AS INTEGER), 19) AS bin, count(*) AS cnt
  FROM plog, (SELECT lo, CASE WHEN hi > lo THEN (hi - lo) / 20.0{D} ELSE 1.0{D} END AS w
      FROM (SELECT min(priority_prob * 100) AS lo, max(priority_prob * 100) AS hi FROM plog)) b2
  GROUP BY 1) c ON c.bin = s.bin""", LOG_CTES), ["bin_lo", "bin_hi"]),
    "log_halves": with_base("""
SELECT half, count(*) AS rows, min(prediction_id) AS first_id, max(prediction_id) AS last_id
FROM plog_half GROUP BY half""", LOG_CTES),
    "prediction_drift": with_base("""
SELECT b.score_column, b.n_ref, b.n_cur,
  CASE WHEN b.n_all >= 40 AND b.n_ref >= 10 AND b.n_cur >= 10 THEN round_even(psi.psi, 4) END AS psi,
  CASE WHEN b.n_all < 40 OR b.n_ref < 10 OR b.n_cur < 10 THEN 'INSUFFICIENT_DATA'
       WHEN psi.psi < 0.10 THEN 'STABLE' WHEN psi.psi < 0.25 THEN 'DRIFTING'
       ELSE 'SIGNIFICANT_SHIFT' END AS status
FROM b LEFT JOIN psi USING (score_column)""", LOG_CTES + """,
plong AS (
  SELECT 'priority_prob' AS score_column, half AS side, priority_prob AS v FROM plog_half UNION ALL
  SELECT 'closure_prob', half, closure_prob FROM plog_half UNION ALL
  SELECT 'duration_est_min', half, duration_est_min FROM plog_half),""" + _psi_sql("plong", "score_column")),
    "feature_drift": with_base(f"""
SELECT feature, n_cur,
  CASE WHEN n_cur >= 20 THEN round_even(psi, 4) END AS psi,
  CASE WHEN n_cur < 20 THEN 'INSUFFICIENT_DATA' WHEN psi < 0.10 THEN 'NO_DRIFT'
       WHEN psi < 0.25 THEN 'MODERATE_DRIFT' ELSE 'SIGNIFICANT_DRIFT' END AS status
FROM (SELECT feature, sum(c - 1) AS n_cur, sum((cp - rp) * ln(cp / rp)) AS psi
      FROM (SELECT feature, r, c, r / sum(r) OVER (PARTITION BY feature) AS rp,
                   c / sum(c) OVER (PARTITION BY feature) AS cp FROM fd_full)
      GROUP BY feature)""", f"""
flong AS ({_FEAT_LONG}),
fb AS (SELECT feature, min(v) AS lo, max(v) AS hi FROM flong
       WHERE split = 'train' AND v IS NOT NULL GROUP BY feature),
fidx AS (
  SELECT f.feature, f.split,
    CASE WHEN f.v < fb.lo THEN 0 WHEN f.v > fb.hi THEN 9 WHEN fb.hi = fb.lo THEN 9
         ELSE least(CAST(floor((f.v - fb.lo) / ((fb.hi - fb.lo) / 10.0{D})) AS INTEGER), 9) END AS bin
  FROM flong f JOIN fb USING (feature) WHERE f.v IS NOT NULL),
fcnt AS (SELECT feature, bin, count(*) FILTER (WHERE split = 'train') AS rc,
           count(*) FILTER (WHERE split = 'test') AS cc FROM fidx GROUP BY feature, bin),
fd_full AS (
  SELECT d.feature, coalesce(fcnt.rc, 0) + 1 AS r, coalesce(fcnt.cc, 0) + 1 AS c
  FROM (SELECT feature, unnest(range(10)) AS bin FROM fb) d
  LEFT JOIN fcnt ON d.feature = fcnt.feature AND d.bin = fcnt.bin)"""),
    "ema_cell_update": rounded(with_base("SELECT * FROM ema", EMA_CTES),
                               ["geo_high_priority_rate", "geo_closure_rate", "geo_avg_duration"],
                               nudge=" + 1e-12::DOUBLE"),
    "message_intents": rounded(with_base("""
SELECT message_id, intent, fallback,
  CASE WHEN intent = 'predict' THEN coalesce(latitude, 12.9716::DOUBLE) END AS latitude,
  CASE WHEN intent = 'predict' THEN coalesce(longitude, 77.5946::DOUBLE) END AS longitude,
  CASE WHEN intent = 'predict' THEN coalesce(hour, CAST(hour(sent_at) AS INTEGER)) END AS hour,
  CASE WHEN intent = 'predict' THEN coalesce(event_cause, 'congestion') END AS event_cause,
  CASE WHEN intent = 'predict' THEN coalesce(zone, 'Central Zone 2') END AS zone,
  CASE WHEN intent = 'predict' THEN coalesce(corridor, 'Non-corridor') END AS corridor,
  CASE WHEN intent = 'predict' THEN coalesce(day_of_week, CAST(isodow(sent_at) - 1 AS INTEGER)) END
    AS day_of_week,
  CASE WHEN intent = 'predict' THEN CAST(month(sent_at) AS INTEGER) END AS month,
  hotspot_zone, explain_topic,
  CASE WHEN intent = 'predict' THEN concat_ws(',',
    CASE WHEN latitude IS NULL THEN 'latitude' END, CASE WHEN longitude IS NULL THEN 'longitude' END,
    CASE WHEN hour IS NULL THEN 'hour' END, CASE WHEN event_cause IS NULL THEN 'event_cause' END,
    CASE WHEN zone IS NULL THEN 'zone' END, CASE WHEN corridor IS NULL THEN 'corridor' END,
    CASE WHEN day_of_week IS NULL THEN 'day_of_week' END) END AS defaulted
FROM parsed""", MSG_CTES), ["latitude", "longitude"]),
    "intent_mix": with_base("""
SELECT intent, coalesce(explain_topic, '-') AS explain_topic, count(*) AS messages
FROM parsed GROUP BY 1, 2""", MSG_CTES),
    "compare_requests": with_base("SELECT message_id, position, name, kind FROM req", MSG_CTES),
    "corridor_comparison": rounded(with_base("""
SELECT r.message_id, r.position, r.name AS corridor, c.corridor_risk_score,
  CASE WHEN c.corridor_risk_score IS NULL THEN 'not found'
       WHEN c.corridor_risk_score > 0.7 THEN 'HIGH' WHEN c.corridor_risk_score > 0.4 THEN 'MEDIUM'
       ELSE 'LOW' END AS risk_level
FROM req r LEFT JOIN lk_corridor c ON lower(trim(r.name)) = c.corridor
WHERE r.kind = 'corridor'""", MSG_CTES), ["corridor_risk_score"]),
    "zone_comparison": with_base("""
SELECT r.name AS zone, r.message_id, r.position,
  CAST(coalesce(z.total_events, 0) AS BIGINT) AS total_events,
  CAST(coalesce(z.peak_hour_events, 0) AS BIGINT) AS peak_hour_events
FROM req r LEFT JOIN (SELECT zone, sum(zone_hour_event_count) AS total_events,
                             max(zone_hour_event_count) AS peak_hour_events
                      FROM lk_zone_hour GROUP BY zone) z ON r.name = z.zone
WHERE r.kind = 'zone'""", MSG_CTES),
    "outcome_backfill": rounded(with_base("""
SELECT l.prediction_id, p.priority AS actual_priority,
  CAST(p.requires_road_closure AS INTEGER) AS actual_closure,
  p.duration_minutes AS actual_duration_min,
  CASE WHEN p.priority IS NOT NULL THEN (l.priority_prob > 0.5) = (p.priority = 'High') END
    AS feedback_correct
FROM plog l LEFT JOIN prepared p ON l.prediction_id = p.incident_id""", LOG_CTES),
        ["actual_duration_min"]),
})

# ---------------------------------------------------------------------------
# split, sample, evaluation, gate, window, quarantine, encoding
# ---------------------------------------------------------------------------
SWL = LOG_CTES + """,
swl AS (
  SELECT l.prediction_id, l."timestamp", l.priority_prob, l.closure_prob, l.duration_est_min,
    p.split, p.priority_binary, p.road_closure_binary, p.duration_minutes
  FROM plog_scored l JOIN prepared p ON l.prediction_id = p.incident_id),
swl_test AS (SELECT * FROM swl WHERE split = 'test')"""


def _auc_sql(src: str, score: str, label: str) -> str:
    return f"""(SELECT (sum(pos * neg_below) + 0.5 * sum(pos * neg)) / (sum(pos) * sum(neg)) AS auc,
      CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives
    FROM (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING
                                                 AND 1 PRECEDING), 0) AS neg_below
          FROM (SELECT {score} AS score, count_if({label} = 1) AS pos,
                       count_if({label} = 0) AS neg
                FROM {src} WHERE {score} IS NOT NULL AND {label} IS NOT NULL GROUP BY 1)))"""


_CLS = """
cm AS (SELECT CAST(priority_prob > 0.5 AS INTEGER) AS p, priority_binary AS y FROM swl_test),
per AS (SELECT sum(CASE WHEN y = 0 AND p = 0 THEN 1 ELSE 0 END) AS tp0,
          sum(CASE WHEN p = 0 THEN 1 ELSE 0 END) AS pp0, sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS s0,
          sum(CASE WHEN y = 1 AND p = 1 THEN 1 ELSE 0 END) AS tp1,
          sum(CASE WHEN p = 1 THEN 1 ELSE 0 END) AS pp1, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS s1
        FROM cm),
pr AS (SELECT *, CASE WHEN pp0 > 0 THEN tp0 / pp0 ELSE 0.0 END AS p0,
          CASE WHEN s0 > 0 THEN tp0 / s0 ELSE 0.0 END AS r0,
          CASE WHEN pp1 > 0 THEN tp1 / pp1 ELSE 0.0 END AS p1,
          CASE WHEN s1 > 0 THEN tp1 / s1 ELSE 0.0 END AS r1 FROM per),
prf AS (SELECT *, CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0.0 END AS f0,
          CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0.0 END AS f1_, s0 + s1 AS n
        FROM pr)"""

SQL.update({
    "split_balance": with_base(
        "SELECT split, priority_binary, count(*) AS rows FROM prepared GROUP BY 1, 2"),
    "seeded_sample": rounded(with_base("""
SELECT incident_id, event_cause, zone, latitude, longitude, priority FROM prepared
ORDER BY md5(CAST(incident_id AS VARCHAR) || '#42'), incident_id LIMIT 200"""),
        ["latitude", "longitude"]),
    "classification_report": rounded(with_base("""
SELECT '0' AS label, p0 AS precision, r0 AS recall, f0 AS f1, CAST(s0 AS BIGINT) AS support FROM prf
UNION ALL SELECT '1', p1, r1, f1_, CAST(s1 AS BIGINT) FROM prf
UNION ALL SELECT 'accuracy', NULL, NULL, (tp0 + tp1) / n, CAST(n AS BIGINT) FROM prf
UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1_) / 2, CAST(n AS BIGINT) FROM prf
UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n,
  (f0 * s0 + f1_ * s1) / n, CAST(n AS BIGINT) FROM prf""", SWL + "," + _CLS),
        ["precision", "recall", "f1"]),
    "roc_auc": rounded(with_base(f"""
SELECT *, 'priority' AS model FROM {_auc_sql('swl_test', 'priority_prob', 'priority_binary')}
UNION ALL
SELECT *, 'closure' FROM {_auc_sql('swl_test', 'closure_prob', 'road_closure_binary')}""", SWL),
        ["auc"]),
    "best_threshold": rounded(with_base("""
SELECT score AS threshold, f1, precision, recall FROM (
  SELECT score, precision, recall, 2 * precision * recall / (precision + recall + 1e-8) AS f1 FROM (
    SELECT score,
      CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
      CASE WHEN pt > 0 THEN tp / pt ELSE 1.0 END AS recall FROM (
      SELECT score,
        sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
        sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
        sum(pos) OVER () AS pt
      FROM (SELECT closure_prob AS score, count_if(road_closure_binary = 1) AS pos,
                   count_if(road_closure_binary = 0) AS neg FROM swl_test
            WHERE closure_prob IS NOT NULL GROUP BY 1))))
ORDER BY f1 DESC, score ASC LIMIT 1""", SWL), ["threshold", "f1", "precision", "recall"]),
    "regression_metrics": rounded(with_base("""
SELECT avg(abs(p - y)) AS mae, quantile_cont(abs(p - y), 0.5) AS median_ae,
  1 - sum((y - p) * (y - p)) / sum((y - my) * (y - my)) AS r2,
  1 - sum((ly - lp) * (ly - lp)) / sum((ly - mly) * (ly - mly)) AS r2_log,
  count(*) AS n
FROM (SELECT p, y, ln(1 + p) AS lp, ln(1 + y) AS ly, avg(y) OVER () AS my,
             avg(ln(1 + y)) OVER () AS mly
      FROM (SELECT duration_est_min AS p, duration_minutes AS y FROM swl_test
            WHERE duration_est_min IS NOT NULL AND duration_minutes IS NOT NULL))""", SWL),
        ["mae", "median_ae", "r2", "r2_log"]),
    "promotion_gate": rounded(with_base(f"""
SELECT model, current_metric, new_metric, current_metric * 0.95 AS threshold,
  CASE WHEN new_metric >= current_metric * (1 - 0.05) THEN 'PROMOTE' ELSE 'REJECT' END AS decision
FROM (
  SELECT 'priority' AS model,
    (SELECT auc FROM {_auc_sql('h_ref', 'priority_prob', 'priority_binary')}) AS current_metric,
    (SELECT auc FROM {_auc_sql('h_cur', 'priority_prob', 'priority_binary')}) AS new_metric
  UNION ALL
  SELECT 'closure',
    (SELECT auc FROM {_auc_sql('h_ref', 'closure_prob', 'road_closure_binary')}),
    (SELECT auc FROM {_auc_sql('h_cur', 'closure_prob', 'road_closure_binary')}))""",
        SWL + """,
swl_half AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY "timestamp", prediction_id)
                     <= (SELECT count(*) FROM swl) // 2 THEN 'ref' ELSE 'cur' END AS half FROM swl),
h_ref AS (SELECT * FROM swl_half WHERE half = 'ref'),
h_cur AS (SELECT * FROM swl_half WHERE half = 'cur')"""),
        ["current_metric", "new_metric", "threshold"]),
    "retrain_window": with_base("""
SELECT CAST(6 AS INTEGER) AS window_months, full_rows, window_rows,
  CASE WHEN window_rows < 100 THEN 'full' ELSE 'window' END AS source,
  CASE WHEN window_rows < 100 THEN full_rows ELSE window_rows END AS used_rows,
  CASE WHEN (CASE WHEN window_rows < 100 THEN full_rows ELSE window_rows END) < 200
       THEN 'SKIPPED' ELSE 'READY' END AS status
FROM (SELECT count(*) AS full_rows,
        CAST(count_if(start_datetime >= (SELECT max(start_datetime) FROM prepared)
                                        - INTERVAL 6 MONTH) AS BIGINT) AS window_rows
      FROM prepared)"""),
    "request_quarantine": with_base(f"""
SELECT request_id, reasons = '' AS valid, reasons FROM (
  SELECT incident_id AS request_id, concat_ws(',',
    CASE WHEN NOT coalesce(latitude BETWEEN 12.75{D} AND 13.30{D}, false) THEN 'latitude_out_of_range' END,
    CASE WHEN NOT coalesce(longitude BETWEEN 77.25{D} AND 77.85{D}, false) THEN 'longitude_out_of_range' END,
    CASE WHEN NOT coalesce(h BETWEEN 0 AND 23, false) THEN 'hour_out_of_range' END,
    CASE WHEN NOT coalesce(d BETWEEN 0 AND 6, false) THEN 'day_of_week_out_of_range' END,
    CASE WHEN NOT coalesce(m BETWEEN 1 AND 12, false) THEN 'month_out_of_range' END) AS reasons
  FROM (SELECT incident_id, latitude, longitude,
          hour(TRY_CAST(start_datetime AS TIMESTAMP)) AS h,
          isodow(TRY_CAST(start_datetime AS TIMESTAMP)) - 1 AS d,
          month(TRY_CAST(start_datetime AS TIMESTAMP)) AS m FROM incidents_raw))"""),
    "target_encoding": rounded(with_base(" UNION ALL ".join(f"""
SELECT '{c}' AS "column", {c} AS category,
  w * m + (1 - w) * (SELECT avg(priority_binary) FROM features2 WHERE split = 'train') AS encoding
FROM (SELECT {c}, avg(priority_binary) AS m, 1 / (1 + exp(-(count(*) - 20) / 5.0)) AS w
      FROM features2 WHERE split = 'train' AND {c} IS NOT NULL GROUP BY {c})"""
        for c in ["event_cause", "veh_type", "corridor", "police_station", "zone", "junction"])),
        ["encoding"]),
})

_MON = """
  count(*) AS predictions, avg(priority_prob) AS avg_priority_prob,
  avg(closure_prob) AS avg_closure_prob"""
SQL.update({
    "hourly_monitoring": rounded(with_base(f"""
SELECT strftime(ws, {_TSF}) AS window_start, strftime(ws + INTERVAL 1 HOUR, {_TSF}) AS window_end,
  {_MON}
FROM (SELECT date_trunc('hour', "timestamp") AS ws, priority_prob, closure_prob FROM plog)
GROUP BY ws""", LOG_CTES), ["avg_priority_prob", "avg_closure_prob"]),
    "rolling_monitoring": rounded(with_base(f"""
SELECT strftime(ws, {_TSF}) AS window_start, strftime(ws + INTERVAL 24 HOUR, {_TSF}) AS window_end,
  {_MON}
FROM (SELECT date_trunc('hour', "timestamp") - k * INTERVAL 1 HOUR AS ws, priority_prob, closure_prob
      FROM plog, (SELECT unnest(generate_series(0, 23)) AS k) g)
GROUP BY ws""", LOG_CTES), ["avg_priority_prob", "avg_closure_prob"]),
})

# DBSCAN by brute force: haversine band self-join, core counts, transitive
# closure over core-core edges (recursive CTE), border -> lowest cluster.
_EPS = "radians(0.005)"
DBSCAN_CTES = f"""
pts AS (SELECT incident_id AS id, latitude AS lat, longitude AS lon, event_cause, priority, zone
        FROM prepared),
nb AS (
  SELECT a.id AS a, b.id AS b
  FROM pts a JOIN pts b ON abs(a.lat - b.lat) <= 0.0051{D} AND abs(a.lon - b.lon) <= 0.0060{D}
  WHERE 2 * asin(sqrt(least(pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2)
        + cos(radians(a.lat)) * cos(radians(b.lat))
          * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2), 1.0{D}))) <= {_EPS}),
core AS (SELECT a AS id FROM nb GROUP BY a HAVING count(*) >= 10),
cedge AS (SELECT nb.a, nb.b FROM nb JOIN core c1 ON nb.a = c1.id JOIN core c2 ON nb.b = c2.id),
reach(src, dst) AS (
  SELECT id, id FROM core
  UNION
  SELECT r.src, e.b FROM reach r JOIN cedge e ON r.dst = e.a),
comp AS (SELECT src AS id, min(dst) AS label FROM reach GROUP BY src),
cnum AS (SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS cluster
         FROM (SELECT DISTINCT label FROM comp)),
core_lab AS (SELECT c.id, n.cluster FROM comp c JOIN cnum n USING (label)),
border AS (
  SELECT nb.a AS id, min(cl.cluster) AS cluster FROM nb JOIN core_lab cl ON nb.b = cl.id
  WHERE nb.a NOT IN (SELECT id FROM core) GROUP BY nb.a),
labels AS (
  SELECT p.id, coalesce(cl.cluster, b.cluster, -1) AS cluster, cl.id IS NOT NULL AS is_core
  FROM pts p LEFT JOIN core_lab cl ON p.id = cl.id LEFT JOIN border b ON p.id = b.id),
cpoints AS (SELECT p.id, p.lat AS latitude, p.lon AS longitude, p.event_cause, p.priority,
                   p.zone, l.cluster, l.is_core FROM pts p JOIN labels l USING (id)),
top_cause AS (
  SELECT cluster, event_cause AS top_cause FROM (
    SELECT cluster, event_cause, row_number() OVER (PARTITION BY cluster
                                                    ORDER BY count(*) DESC, event_cause) AS rk
    FROM cpoints WHERE cluster >= 0 AND event_cause IS NOT NULL GROUP BY cluster, event_cause)
  WHERE rk = 1),
profiles AS (
  SELECT c.cluster, count(c.event_cause) AS event_count,
    avg(CASE WHEN c.priority = 'High' THEN 1 ELSE 0 END) * 100 AS high_priority_pct,
    avg(c.latitude) AS centroid_lat, avg(c.longitude) AS centroid_lon, t.top_cause
  FROM cpoints c LEFT JOIN top_cause t USING (cluster) WHERE c.cluster >= 0
  GROUP BY c.cluster, t.top_cause)"""
_PROF = ["high_priority_pct", "centroid_lat", "centroid_lon"]
SQL.update({
    "dbscan_labels": with_base("SELECT id, cluster, is_core FROM labels", DBSCAN_CTES),
    "cluster_profiles": rounded(with_base("SELECT * FROM profiles", DBSCAN_CTES), _PROF,
                                nudge=" + 1e-12::DOUBLE"),
    "top_hotspots": rounded(with_base(
        "SELECT * FROM profiles ORDER BY event_count DESC, cluster ASC LIMIT 5", DBSCAN_CTES), _PROF,
        nudge=" + 1e-12::DOUBLE"),
    "zone_hotspots": rounded(with_base("""
SELECT h.zone, p.* FROM (SELECT DISTINCT zone, cluster FROM cpoints WHERE cluster >= 0) h
JOIN profiles p USING (cluster)""", DBSCAN_CTES), _PROF, nudge=" + 1e-12::DOUBLE"),
    "clustered_points": rounded(with_base("""
SELECT id, latitude, longitude, cluster, event_cause, priority FROM cpoints WHERE cluster >= 0""",
        DBSCAN_CTES), ["latitude", "longitude"]),
})

SQL.update({
    "conversation_intents": rounded(with_base("""
SELECT message_id, intent, fallback, latitude, longitude, hour, event_cause, zone, corridor,
  day_of_week, hotspot_zone, explain_topic FROM parsed""", CONV_CTES), ["latitude", "longitude"]),
})

SQL.update({
    "log_roundtrip": SQL["prediction_log"],
    "lookup_roundtrip": rounded(with_base(" UNION ALL ".join(
        [f"SELECT '{t}' AS lookup, {k} AS key, '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM lk_{t}" for t, k, cs in (
            ("cell", "geohash6", ["geo_event_count", "geo_high_priority_rate", "geo_closure_rate", "geo_avg_duration"]),
            ("zone_hour", "concat_ws('|', hour, zone)", ["zone_hour_event_count"]), ("corridor", "corridor", ["corridor_risk_score"]),
            ("cause", "event_cause", ["cause_closure_rate", "cause_avg_duration"]),
            ("cause_zone", "event_cause || '|' || zone", ["cause_zone_closure"])) for c in cs]
        + ["SELECT 'high_risk', event_cause, '', NULL::DOUBLE FROM lk_high_risk"]
        + [f"SELECT 'median', '{c}', '', m_{c} FROM medians WHERE m_{c} IS NOT NULL" for c in MEDIAN_NAMES])), ["value"]),
    "csv_incidents": rounded(with_base("""
SELECT incident_id, event_type, event_cause, veh_type, zone, corridor, police_station, junction, priority, requires_road_closure,
  latitude, longitude, start_datetime, closed_datetime, NULL::VARCHAR AS damaged FROM incidents_raw
UNION ALL
SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
  'damaged ' || CAST(incident_id AS VARCHAR) FROM incidents_raw WHERE incident_id % 500 = 0"""), ["latitude", "longitude"]),
    "damaged_log": "SELECT * EXCLUDE (prediction_id) REPLACE (CASE WHEN prediction_id % 5 = 0 THEN coalesce(corridor, '') "
                   "|| ', near \u2019Caf\u00e9\u2019, 2' ELSE corridor END AS corridor) FROM (" + SQL["prediction_log"] + ")",
    "outcome_upsert": SQL["outcome_backfill"],
    "lookup_upkeep": "SELECT * EXCLUDE (events_applied) FROM (" + SQL["ema_cell_update"] + ")",
})

SQL["smote_balance"] = with_base("""
SELECT road_closure_binary, false AS synthetic, n AS rows, n AS distinct_ids FROM classes
UNION ALL
SELECT road_closure_binary, true, most - n, most - n FROM classes, (SELECT max(n) AS most, min(n) AS least FROM classes)
WHERE n = least AND most > least""", """classes AS (SELECT road_closure_binary, count(*) AS n FROM prepared WHERE split = 'train' GROUP BY 1)""")
