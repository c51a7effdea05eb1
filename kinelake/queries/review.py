"""Lead times, error analysis, traces, alerts and picks."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinelake.functions.channels import ACCEL
from kinelake.operators import alerts, review
from kinelake.operators.alerts import SmootherConfig
from kinelake.queries.evaluation import PREDICTIONS_SQL, predictions
from kinelake.queries.registry import query
from kinelake.queries.standins import CATALOG_SQL, SAMPLES_SQL, catalog, longs, samples, table

_LEAD_SQL = f"""WITH {PREDICTIONS_SQL},
lt AS (
  SELECT global_subject_id, activity_code, trial_id,
         (max(fall_impact_frame) - min(start_frame) FILTER (predicted_label = 'pre_impact' AND start_frame < fall_impact_frame))
         / 100 * 1000.0::DOUBLE AS lead_time_ms
  FROM pr WHERE fall_impact_frame IS NOT NULL GROUP BY ALL)"""
_TRIAL = ["global_subject_id", "activity_code", "trial_id"]


def _lead_times(spark, sf_dir):
    return review.lead_time(predictions(spark, sf_dir), _TRIAL)


@query("lead_time", f"{_LEAD_SQL}\nSELECT {', '.join(_TRIAL)}, round(lead_time_ms, 6) AS lead_time_ms FROM lt")
def lead_time(spark, sf_dir):
    return _lead_times(spark, sf_dir).withColumn("lead_time_ms", F.round("lead_time_ms", 6))


_SUMMARY = """count(*) AS n_trials, count(lead_time_ms) AS n_flagged, round(count(lead_time_ms) / count(*), 6) AS detection_rate,
       round(avg(lead_time_ms), 6) AS mean_lead_ms, round(median(lead_time_ms), 6) AS median_lead_ms"""


def _summary(lead_times, *by):
    found = review.lead_time_summary(lead_times, by)
    return found.select(
        *by, "n_trials", "n_flagged", *[F.round(c, 6).alias(c) for c in ("detection_rate", "mean_lead_ms", "median_lead_ms")]
    )


@query("lead_time_summary", f"{_LEAD_SQL}\nSELECT {_SUMMARY} FROM lt")
def lead_time_summary(spark, sf_dir):
    return _summary(_lead_times(spark, sf_dir))


@query("fold_lead_times", f"{_LEAD_SQL}\nSELECT global_subject_id, {_SUMMARY} FROM lt GROUP BY global_subject_id")
def fold_lead_times(spark, sf_dir):
    """A fold's test set is one subject, so folds are summarised by subject."""
    return _summary(_lead_times(spark, sf_dir), "global_subject_id")


_EDGES = ", ".join(f"({lo}, {hi})" for lo, hi in zip(review.DISTANCE_EDGES, review.DISTANCE_EDGES[1:]))


@query(
    "errors_by_distance",
    f"""WITH {PREDICTIONS_SQL}, e(low, high) AS (VALUES {_EDGES})
SELECT low::BIGINT AS low, high::BIGINT AS high, count(*) AS n, round(avg((predicted_label = label)::INT), 6) AS accuracy,
       round(avg((predicted_label = 'pre_impact' AND label <> 'pre_impact')::INT), 6) AS false_pre_impact_rate
FROM pr JOIN e ON start_frame - fall_onset_frame > low AND start_frame - fall_onset_frame <= high
GROUP BY low, high""",
)
def errors_by_distance(spark, sf_dir):
    found = review.errors_by_distance(predictions(spark, sf_dir))
    return found.select(*longs("low", "high"), "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "false_pre_impact_rate")])


@query(
    "adl_false_positives",
    f"""WITH {PREDICTIONS_SQL}
SELECT global_subject_id, count(*) AS n, round(avg((predicted_label = label)::INT), 6) AS accuracy,
       round(avg((predicted_label = 'pre_impact')::INT), 6) AS pre_impact_rate
FROM pr WHERE fall_onset_frame IS NULL GROUP BY global_subject_id""",
)
def adl_false_positives(spark, sf_dir):
    found = review.adl_false_positives(predictions(spark, sf_dir), ["global_subject_id"])
    return found.select("global_subject_id", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "pre_impact_rate")])


@query(
    "trial_trace",
    f"""WITH {PREDICTIONS_SQL}
SELECT trial, start_frame::BIGINT AS start_frame, end_frame::BIGINT AS end_frame, label, predicted_label,
       round(p_non_fall, 6) AS p_non_fall, round(p_pre_impact, 6) AS p_pre_impact, round(p_fall, 6) AS p_fall,
       CASE WHEN start_frame <= fall_impact_frame AND fall_impact_frame < end_frame THEN 'impact'
            WHEN start_frame <= fall_onset_frame AND fall_onset_frame < end_frame THEN 'onset' END AS marker,
       predicted_label <> label AS mismatch
FROM pr""",
)
def trial_trace(spark, sf_dir):
    found = review.trial_trace(predictions(spark, sf_dir))
    probs = [F.round(c, 6).alias(c) for c in ("p_non_fall", "p_pre_impact", "p_fall")]
    return found.select("trial", "start_frame", "end_frame", "label", "predicted_label", *probs, "marker", "mismatch")


def smoother_sql(source: str, keys: str, c: SmootherConfig = SmootherConfig()) -> str:
    """Recursive CTE ``al``: state codes along ``source(keys, window_index, p0, p1, p2)``."""
    a = c.ema_alpha
    e = {k: f"({a!r}::DOUBLE * x.p{k} + {1 - a!r}::DOUBLE * p.e{k})" for k in range(3)}
    fall, latch = 2, c.fall_latch

    def step(code: str, pre: str, hit: str) -> str:
        return f"""CASE WHEN {code} > {fall} THEN {code} - 1
              WHEN {hit} >= {c.fall_enter} THEN {fall + latch}
              WHEN {code} = {fall} AND {hit} >= {c.fall_exit} THEN {fall}
              WHEN {code} = 0 THEN CASE WHEN {pre} >= {c.pre_impact_enter} THEN 1 ELSE 0 END
              ELSE CASE WHEN {pre} >= {c.pre_impact_exit} THEN 1 ELSE 0 END END"""

    join = " AND ".join(f"x.{k.strip()} = p.{k.strip()}" for k in keys.split(","))
    prior = ", ".join(f"p.{k.strip()}" for k in keys.split(","))
    return f"""
al({keys}, window_index, e0, e1, e2, code) AS (
  SELECT {keys}, window_index, p0, p1, p2, {step("0", "p1", "p2")} FROM {source} WHERE window_index = 0
  UNION ALL
  SELECT {prior}, x.window_index, {e[0]}, {e[1]}, {e[2]}, {step("p.code", e[1], e[2])}
  FROM al p JOIN {source} x ON {join} AND x.window_index = p.window_index + 1)"""


# A rising and falling risk along each trial, with some jitter, so that every state occurs.
_RISK = {
    "p_pre_impact": "least(0.9, greatest(0.05, 0.9 - abs(start_frame - coalesce(fall_onset_frame, 120)) / CASE WHEN trial % 2 = 0 THEN 43 ELSE 173 END + (window_index * 7 + trial) % 11 / 97))",
    "p_fall": "CASE WHEN start_frame >= coalesce(fall_impact_frame, 90000) - 20 AND (window_index + trial) % 5 <> 0 THEN 0.75 ELSE 0.03 END",
}
_RISK_SQL = f"""risk AS (SELECT *, {", ".join(f"({e})::DOUBLE AS r_{n}" for n, e in _RISK.items())} FROM pr),
rp AS (SELECT *, r_p_pre_impact * (1 - r_p_fall) AS p1, r_p_fall AS p2,
              1 - r_p_pre_impact * (1 - r_p_fall) - r_p_fall AS p0 FROM risk)"""
_ALERT_SQL = f"""WITH RECURSIVE {PREDICTIONS_SQL}, {_RISK_SQL}, {smoother_sql("rp", "trial")},
st AS (SELECT al.*, CASE least(code, 2) WHEN 0 THEN 'calm' WHEN 1 THEN 'pre_impact' ELSE 'fall' END AS state FROM al)"""


def _risk(spark, sf_dir):
    rows = predictions(spark, sf_dir).drop("p_non_fall", "p_pre_impact", "p_fall")
    rows = rows.withColumns({f"r_{n}": F.expr(e).cast("double") for n, e in _RISK.items()})
    pre = F.col("r_p_pre_impact") * (1 - F.col("r_p_fall"))
    rows = rows.withColumns({"p_pre_impact": pre, "p_fall": F.col("r_p_fall")})
    rows = rows.withColumn("p_non_fall", 1 - F.col("p_pre_impact") - F.col("p_fall"))
    keep = ["start_frame", "end_frame", "fall_onset_frame", "fall_impact_frame", "p_non_fall", "p_pre_impact", "p_fall"]
    return rows.select("trial", "window_index", *keep)


def _alerts(spark, sf_dir):
    return alerts.smooth_alerts(_risk(spark, sf_dir), ["trial"])


@query(
    "smooth_alerts",
    f"""{_ALERT_SQL}
SELECT trial, window_index::BIGINT AS window_index, round(e0, 6) AS s_non_fall, round(e1, 6) AS s_pre_impact,
       round(e2, 6) AS s_fall, state FROM st""",
)
def smooth_alerts(spark, sf_dir):
    smoothed = [F.round(c, 6).alias(c) for c in ("s_non_fall", "s_pre_impact", "s_fall")]
    return _alerts(spark, sf_dir).select("trial", "window_index", *smoothed, "state")


@query(
    "state_changes",
    f"""{_ALERT_SQL}
SELECT trial, window_index::BIGINT AS window_index, previous, state FROM (
  SELECT *, lag(state) OVER (PARTITION BY trial ORDER BY window_index) AS previous FROM st)
WHERE state IS DISTINCT FROM previous""",
)
def state_changes(spark, sf_dir):
    return review.state_changes(_alerts(spark, sf_dir), ["trial"]).select("trial", "window_index", "previous", "state")


_TIMING_SQL = f"""{_ALERT_SQL},
tm AS (
  SELECT st.trial, max(fall_onset_frame) / 100 AS onset_s, max(fall_impact_frame) / 100 AS impact_s,
         min(start_frame) FILTER (state <> 'calm') / 100 AS first_escalation_s, min(start_frame) FILTER (state = 'fall') / 100 AS first_fall_s
  FROM st JOIN rp ON rp.trial = st.trial AND rp.window_index = st.window_index
  WHERE fall_onset_frame IS NOT NULL GROUP BY st.trial),
safe AS (
  SELECT *, onset_s - first_escalation_s AS lead_s, first_fall_s - impact_s AS fall_lag_s, first_fall_s IS NOT NULL AS reached_fall,
         coalesce(onset_s - first_escalation_s <= 0.3::DOUBLE AND first_fall_s - impact_s <= 1.0, false) AS safe_for_demo FROM tm)"""
_SECONDS = ["onset_s", "impact_s", "first_escalation_s", "first_fall_s", "lead_s", "fall_lag_s"]


@query(
    "alert_timing",
    f"""{_TIMING_SQL}
SELECT trial, {", ".join(f"round({c}, 6) AS {c}" for c in _SECONDS)}, reached_fall, safe_for_demo FROM safe""",
)
def alert_timing(spark, sf_dir):
    found = review.alert_timing(_alerts(spark, sf_dir), ["trial"])
    return found.select("trial", *[F.round(c, 6).alias(c) for c in _SECONDS], "reached_fall", "safe_for_demo")


@query(
    "demo_candidates",
    f"""{_TIMING_SQL}
SELECT trial, round(abs(lead_s) + abs(fall_lag_s), 6) AS offset_s FROM safe WHERE safe_for_demo
ORDER BY round(abs(lead_s) + abs(fall_lag_s), 6), trial LIMIT 5""",
)
def demo_candidates(spark, sf_dir):
    found = review.demo_candidates(_alerts(spark, sf_dir), ["trial"])
    return found.select("trial", F.round("offset_s", 6).alias("offset_s"))


@query(
    "current_state",
    f"""{_ALERT_SQL}
SELECT trial, max(window_index)::BIGINT AS window_index, arg_max(state, window_index) AS state FROM st GROUP BY trial""",
)
def current_state(spark, sf_dir):
    found = alerts.latest_states(_alerts(spark, sf_dir), ["trial"], "window_index")
    return found.select("trial", "window_index", "state")


@query(
    "settling_check",
    f"""WITH {SAMPLES_SQL}, {CATALOG_SQL},
su AS (SELECT subject_id, row_number() OVER (ORDER BY subject_id) - 1 AS k, count(*) OVER () AS m FROM (SELECT DISTINCT subject_id FROM c)),
ta AS (SELECT subject_id FROM su WHERE k % greatest(1, m // 8) = 0 AND k / greatest(1, m // 8) < 8),
pk AS (SELECT subject_id, label, arg_min(trial, trial_id) AS trial FROM c JOIN ta USING (subject_id) GROUP BY ALL),
sd AS (
  SELECT subject_id, label, stddev_samp(sqrt(acc_x*acc_x + acc_y*acc_y + acc_z*acc_z)) AS v
  FROM s JOIN pk USING (trial) WHERE frame < 100 GROUP BY ALL)
SELECT a.subject_id, round(a.v, 6) AS adl_std, round(f.v, 6) AS fall_std, round(f.v / a.v, 6) AS ratio
FROM sd a JOIN sd f ON a.subject_id = f.subject_id AND a.label = 'adl' AND f.label = 'fall'""",
)
def settling_check(spark, sf_dir):
    trials = catalog(spark, sf_dir).withColumn("path", F.col("trial_id"))
    found = review.settling_check(samples(spark, sf_dir), trials)
    return found.select("subject_id", *[F.round(c, 6).alias(c) for c in ("adl_std", "fall_std", "ratio")])


_PEAKS = ", ".join(
    f"(max_by(frame, {{abs: abs({a}), f: -frame}}))::BIGINT AS {a}_peak_frame, "
    f"(max_by(frame - fall_impact_frame, {{abs: abs({a}), f: -frame}}))::BIGINT AS {a}_peak_offset, "
    f"round(max_by({a}, {{abs: abs({a}), f: -frame}}), 6) AS {a}_peak_value"
    for a in ACCEL
)


@query(
    "impact_peaks",
    f"""WITH {SAMPLES_SQL}, {CATALOG_SQL},
z AS (
  SELECT s.*, fall_onset_frame, fall_impact_frame, sqrt(acc_x*acc_x + acc_y*acc_y + acc_z*acc_z) AS mag
  FROM s JOIN c USING (trial)
  WHERE label = 'fall' AND fall_impact_frame IS NOT NULL AND frame >= fall_impact_frame - 50 AND frame < fall_impact_frame + 50)
SELECT trial, fall_onset_frame::BIGINT AS fall_onset_frame, fall_impact_frame::BIGINT AS fall_impact_frame,
       (max_by(frame, {{abs: mag, f: -frame}}))::BIGINT AS magnitude_peak_frame,
       (max_by(frame - fall_impact_frame, {{abs: mag, f: -frame}}))::BIGINT AS magnitude_peak_offset, {_PEAKS}
FROM z GROUP BY trial, fall_onset_frame, fall_impact_frame""",
)
def impact_peaks(spark, sf_dir):
    found = review.impact_peaks(samples(spark, sf_dir), catalog(spark, sf_dir), ["trial"])
    values = [f"{a}_peak_value" for a in ACCEL]
    return found.select(
        "trial", *longs(*[c for c in found.columns if c != "trial" and c not in values]), *[F.round(v, 6).alias(v) for v in values]
    )


@query(
    "qa_trials",
    f"""WITH {CATALOG_SQL},
k AS (SELECT dataset, subject_id, label, trial_id, row_number() OVER (PARTITION BY dataset, subject_id, label ORDER BY trial_id) AS nth FROM c),
o AS (
  SELECT *, row_number() OVER (PARTITION BY dataset, subject_id
    ORDER BY CASE WHEN nth > 1 THEN 2 WHEN label = 'adl' THEN 0 ELSE 1 END, trial_id) AS pick FROM k)
SELECT dataset, subject_id, label, trial_id, pick FROM o WHERE pick <= 3""",
)
def qa_trials(spark, sf_dir):
    trials = catalog(spark, sf_dir).select("dataset", "subject_id", "label", "trial_id")
    found = review.pick_qa_trials(trials, 3, ["dataset", "subject_id"], "trial_id")
    return found.withColumn("pick", F.col("pick").cast("long"))


# State changes of a series that is in the tables as such: event types along each user.
@query(
    "event_changes",
    """WITH e AS (
  SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step FROM events),
l AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY step) AS previous FROM e)
SELECT user_id, step, previous, event_type FROM l WHERE event_type IS DISTINCT FROM previous""",
)
def event_changes(spark, sf_dir):
    from kinelake.operators.blocks import number_rows

    events = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    steps = number_rows(events, ["user_id"], ["ts", "event_id"], F.date_trunc("hour", "ts"), "step")
    changed = review.state_changes(steps, ["user_id"], "step", "event_type")
    return changed.select("user_id", "step", "previous", "event_type")
