"""Units, resampling, stillness, gravity alignment, filtering, validation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from kinelake.functions import filters, units
from kinelake.functions.channels import ACCEL, CHANNELS, GYRO
from kinelake.operators import filtering, rotation, stationary, validate
from kinelake.operators.rotation import GRAVITY, ROTATION, CalibrationConfig
from kinelake.queries.registry import query
from kinelake.queries.standins import CATALOG_SQL, SAMPLES_SQL, catalog, samples, series, table

_RAW = {
    "raw_adxl_acc_x": "l_partkey % 4096 - 2048",
    "raw_adxl_acc_y": "l_orderkey % 4096 - 2048",
    "raw_adxl_acc_z": "l_orderkey % 3001 - 1500",
    "raw_gyro_x": "l_partkey % 1237 - 600",
    "raw_gyro_y": "l_orderkey % 2111 - 1000",
    "raw_gyro_z": "l_linenumber * 37 - 100",
    "raw_mma_acc_x": "l_partkey % 8000 - 4000",
    "raw_mma_acc_y": "l_orderkey % 7001 - 3500",
    "raw_mma_acc_z": "l_linenumber * 211 - 700",
}


@query(
    "unit_conversion",
    f"""SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'SisFall' ELSE 'kfall' END AS dataset, l_orderkey, l_partkey, l_linenumber,
  {", ".join(
      f"CASE WHEN l_suppkey % 2 = 0 THEN ({_RAW[r]}) * {scale!r}::DOUBLE ELSE {own} END AS {c}"
      for c, r, scale, own in [
          *zip(ACCEL, units.RAW_ACCEL, [32 / 8192] * 3, ["l_quantity / 23", "l_discount * 10", "l_tax * 10"]),
          *zip(GYRO, units.RAW_GYRO, [4000 / 65536] * 3, ["l_quantity - 25", "l_discount * 50", "l_tax * 100"]),
      ])},
  {", ".join(f"({_RAW[r]}) * {16 / 16384!r}::DOUBLE AS {c}" for c, r in zip(units.MMA_ACCEL, units.RAW_MMA))}
FROM lineitem""",
)
def unit_conversion(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    own = ["l_quantity / 23", "l_discount * 10", "l_tax * 10", "l_quantity - 25", "l_discount * 50", "l_tax * 100"]
    mixed = lines.select(
        F.expr("CASE WHEN l_suppkey % 2 = 0 THEN 'SisFall' ELSE 'kfall' END AS dataset"),
        "l_orderkey", "l_partkey", "l_linenumber",
        *[F.expr(e).alias(c) for c, e in zip(CHANNELS, own)],
        *[F.expr(e).alias(c) for c, e in _RAW.items()],
    )
    return units.convert_units(mixed)


_TAPS = ", ".join(f"({k}, {h!r}::DOUBLE)" for k, h in enumerate(filters.resample_taps(1, 2).tolist()))


@query(
    "resample_half",
    f"""WITH {SAMPLES_SQL}, taps(k, h) AS (VALUES {_TAPS}),
o AS (SELECT trial, unnest(generate_series(0, round_even(n_frames / 2, 0)::BIGINT - 1)) AS m FROM n)
SELECT o.trial, m::BIGINT AS frame, m / 100.0::DOUBLE AS time_s, {", ".join(f"round(sum(h * {c}), 6) + 0.0 AS {c}" for c in CHANNELS)}
FROM o CROSS JOIN taps JOIN s ON s.trial = o.trial AND s.frame = m * 2 + 20 - k
GROUP BY o.trial, m""",
)
def resample_half(spark, sf_dir):
    timed = filtering.shift_time(samples(spark, sf_dir), 200.0)
    half = filtering.resample(timed, ["trial"], CHANNELS, 200.0, 100.0)
    values = [(F.round(c, 6) + 0.0).alias(c) for c in CHANNELS]
    return half.select("trial", "frame", F.round("time_s", 6).alias("time_s"), *values)


STILL_N, STILL_VAR, STILL_GYRO = 20, 0.75, 25.0
_QUIET = f"""
g AS (SELECT *, sqrt(gyro_x*gyro_x + gyro_y*gyro_y + gyro_z*gyro_z) AS gyro FROM s),
f AS (
  SELECT trial, frame, count(*) OVER q >= {STILL_N}
         AND var_pop(acc_x) OVER q + var_pop(acc_y) OVER q + var_pop(acc_z) OVER q < {STILL_VAR}
         AND avg(gyro) OVER q < {STILL_GYRO} AS still
  FROM g WINDOW q AS (PARTITION BY trial ORDER BY frame ROWS BETWEEN {STILL_N - 1} PRECEDING AND CURRENT ROW)),
quiet AS (
  SELECT trial, frame FROM (
    SELECT trial, frame, bool_or(still) OVER (PARTITION BY trial ORDER BY frame
      ROWS BETWEEN CURRENT ROW AND {STILL_N - 1} FOLLOWING) AS quiet FROM f) WHERE quiet),
runs AS (
  SELECT trial, min(frame) AS start_frame, max(frame) + 1 AS end_frame
  FROM (SELECT *, frame - row_number() OVER (PARTITION BY trial ORDER BY frame) AS island FROM quiet)
  GROUP BY trial, island),
seg AS (
  SELECT trial, start_frame, end_frame FROM (
    SELECT *, row_number() OVER (PARTITION BY trial ORDER BY end_frame - start_frame DESC, start_frame) AS k FROM runs)
  WHERE k = 1)"""


def _segments(spark, sf_dir):
    return stationary.stationary_segments(
        samples(spark, sf_dir), ["trial"], 100.0, STILL_N / 100, STILL_VAR, STILL_GYRO
    )


@query(
    "stationary_segments",
    f"""WITH {SAMPLES_SQL}, {_QUIET}
SELECT trial, start_frame::BIGINT AS start_frame, end_frame::BIGINT AS end_frame FROM seg""",
)
def stationary_segments(spark, sf_dir):
    return _segments(spark, sf_dir)


def _rotation_sql(source: str, keep: str, g=("g_x", "g_y", "g_z"), name: str = "rot") -> str:
    """CTE ``name``: rotation of the gravity columns of ``source``."""
    x, y, z = g
    cells = {
        "r11": "1 - k*a*a", "r12": "-k*a*b", "r13": "-a",
        "r21": "-k*a*b", "r22": "1 - k*b*b", "r23": "-b",
        "r31": "a", "r32": "b", "r33": "c",
    }
    same = {"r11": 1, "r22": 1, "r33": 1}
    turned = {"r11": -1, "r22": 1, "r33": -1}
    columns = ", ".join(
        f"CASE WHEN aligned AND c > 0 THEN {same.get(n, 0)} WHEN aligned THEN {turned.get(n, 0)} ELSE {e} END AS {n}"
        for n, e in cells.items()
    )
    return f"""
{name}_unit AS (
  SELECT *, {x} / len AS a, {y} / len AS b, {z} / len AS c
  FROM (SELECT *, sqrt({x}*{x} + {y}*{y} + {z}*{z}) AS len FROM {source})),
{name}_side AS (SELECT *, sqrt(a*a + b*b) < 1e-8 AS aligned, (1 - c) / (a*a + b*b) AS k FROM {name}_unit),
{name} AS (SELECT {keep}, {columns} FROM {name}_side)"""


@query(
    "gravity_rotation",
    f"""WITH v AS (
  SELECT p_partkey, CASE WHEN p_partkey % 10 < 2 THEN 0.0 ELSE p_size - 25 END::DOUBLE AS x,
         CASE WHEN p_partkey % 10 < 2 THEN 0.0 ELSE p_retailprice - 1000.55 END::DOUBLE AS y,
         CASE p_partkey % 10 WHEN 0 THEN 1.0 WHEN 1 THEN -2.0 ELSE p_partkey % 7 - 2.5 END::DOUBLE AS z
  FROM part), {_rotation_sql("v", "p_partkey", ("x", "y", "z"))}
SELECT p_partkey, {", ".join(f"round({r}, 6) + 0.0 AS {r}" for r in ROTATION)} FROM rot""",
)
def gravity_rotation(spark, sf_dir):
    axis = F.col("p_partkey") % 10 < 2
    vectors = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(axis, 0.0).otherwise(F.col("p_size") - 25).alias("x"),
        F.when(axis, 0.0).otherwise(F.col("p_retailprice") - 1000.55).alias("y"),
        F.when(F.col("p_partkey") % 10 == 0, 1.0)
        .when(F.col("p_partkey") % 10 == 1, -2.0)
        .otherwise(F.col("p_partkey") % 7 - 2.5)
        .alias("z"),
    )
    found = rotation.gravity_rotation(vectors, "x", "y", "z")
    return found.select("p_partkey", *[(F.round(r, 6) + 0.0).alias(r) for r in ROTATION])


# Calibration on the stand-ins: subject = supplier's nation, tasks from the supplier key.
_CONFIG = CalibrationConfig(frozenset({2, 3}), primary_task=1, min_coverage=0.05)
_TRIALS_SQL = f"""
t AS (
  SELECT s_suppkey AS trial, 'kfall' AS dataset,
         s_nationkey AS subject, s_suppkey % 7 AS task_id, printf('R%03d', s_suppkey % 5) AS trial_id,
         printf('%09d', s_suppkey) AS path, n_frames
  FROM supplier JOIN n ON s_suppkey = trial WHERE s_nationkey % 6 <> 0 OR s_suppkey % 7 > 3),
j AS (SELECT t.*, start_frame, end_frame FROM t LEFT JOIN seg USING (trial)),
prim AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset, subject ORDER BY path) AS k FROM j WHERE task_id = 1)
  WHERE k = 1 AND (end_frame - start_frame) / n_frames >= 0.05),
auto AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset, subject ORDER BY task_id, trial_id, path) AS k
                 FROM j WHERE task_id IN (2, 3) AND start_frame IS NOT NULL)
  WHERE k = 1),
pick AS (
  SELECT u.dataset, u.subject, coalesce(prim.trial, auto.trial) AS trial,
         coalesce(prim.start_frame, auto.start_frame) AS start_frame, coalesce(prim.end_frame, auto.end_frame) AS end_frame,
         CASE WHEN prim.trial IS NOT NULL THEN 'T01' WHEN auto.trial IS NOT NULL THEN 'auto_detected' END AS source
  FROM (SELECT DISTINCT dataset, subject FROM t) u
  LEFT JOIN prim USING (dataset, subject) LEFT JOIN auto USING (dataset, subject)),
grav AS (
  SELECT pick.dataset, pick.subject, any_value(source) AS source, avg(acc_x) AS g_x, avg(acc_y) AS g_y, avg(acc_z) AS g_z
  FROM pick LEFT JOIN s ON s.trial = pick.trial AND s.frame >= start_frame AND s.frame < end_frame
  GROUP BY pick.dataset, pick.subject)"""
_CALIBRATED_SQL = f"WITH {SAMPLES_SQL}, {_QUIET}, {_TRIALS_SQL}, {_rotation_sql('grav', 'dataset, subject, source, g_x, g_y, g_z')}"
_SUBJECT, _TRIAL = ["dataset", "subject"], ["trial"]


def _calibration_trials(spark, sf_dir):
    key = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").filter((F.col("s_nationkey") % 6 != 0) | (key % 7 > 3))
    rows = rows.select(
        key.alias("trial"),
        F.lit("kfall").alias("dataset"),
        F.col("s_nationkey").alias("subject"),
        (key % 7).alias("task_id"),
        F.format_string("R%03d", key % 5).alias("trial_id"),
        F.format_string("%09d", key).alias("path"),
    )
    return rows.join(series(spark, sf_dir), "trial")


def _calibrations(spark, sf_dir):
    return rotation.calibrate(
        samples(spark, sf_dir), _segments(spark, sf_dir), _calibration_trials(spark, sf_dir), _SUBJECT, _TRIAL, _CONFIG
    )


_CAL_COLUMNS = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in GRAVITY + ROTATION)


def _cal_columns(df):
    return df.select(
        "dataset", F.col("subject").cast("long").alias("subject"), "source",
        *[(F.round(c, 6) + 0.0).alias(c) for c in GRAVITY + ROTATION],
    )


@query(
    "calibrate_subjects",
    f"{_CALIBRATED_SQL}\nSELECT dataset, subject::BIGINT AS subject, source, {_CAL_COLUMNS} FROM rot",
)
def calibrate_subjects(spark, sf_dir):
    return _cal_columns(_calibrations(spark, sf_dir))


_FALLBACK_SQL = f"""{_CALIBRATED_SQL},
mean AS (
  SELECT dataset, avg(g_x / len) AS m_x, avg(g_y / len) AS m_y, avg(g_z / len) AS m_z
  FROM (SELECT *, sqrt(g_x*g_x + g_y*g_y + g_z*g_z) AS len FROM rot WHERE source IS NOT NULL) GROUP BY dataset),
{_rotation_sql("mean", "dataset, m_x, m_y, m_z", ("m_x", "m_y", "m_z"), "mrot")},
cal AS (
  SELECT rot.dataset, subject, coalesce(source, 'group_fallback') AS source,
         {", ".join(f"CASE WHEN source IS NULL THEN mrot.{m} ELSE rot.{g} END AS {g}" for g, m in zip(GRAVITY, ["m_x", "m_y", "m_z"]))},
         {", ".join(f"CASE WHEN source IS NULL THEN mrot.{r} ELSE rot.{r} END AS {r}" for r in ROTATION)}
  FROM rot JOIN mrot USING (dataset))"""


def _resolved(spark, sf_dir):
    return rotation.group_fallback(_calibrations(spark, sf_dir), ["dataset"])


@query(
    "group_fallback",
    f"{_FALLBACK_SQL}\nSELECT dataset, subject::BIGINT AS subject, source, {_CAL_COLUMNS} FROM cal",
)
def group_fallback(spark, sf_dir):
    return _cal_columns(_resolved(spark, sf_dir))


@query(
    "calibration_counts",
    f"{_FALLBACK_SQL}\nSELECT dataset, source, count(*) AS n_subjects FROM cal GROUP BY dataset, source",
)
def calibration_counts(spark, sf_dir):
    return rotation.calibration_counts(_resolved(spark, sf_dir), ["dataset"])


def _turned_sql(i: int, axes) -> str:
    return " + ".join(f"r{i}{j} * {axis}" for j, axis in enumerate(axes, 1))


@query(
    "rotate_samples",
    f"""WITH {SAMPLES_SQL},
grav AS (SELECT trial, avg(acc_x) AS g_x, avg(acc_y) AS g_y, avg(acc_z) AS g_z FROM s GROUP BY trial),
{_rotation_sql("grav", "trial")}
SELECT trial, frame::BIGINT AS frame,
  {", ".join(f"round({_turned_sql(i, axes)}, 6) + 0.0 AS {out}" for axes in (ACCEL, GYRO) for i, out in enumerate(axes, 1))}
FROM s JOIN rot USING (trial)""",
)
def rotate_samples(spark, sf_dir):
    """Every trial turned by its own mean acceleration."""
    trials = samples(spark, sf_dir)
    mean = trials.groupBy("trial").agg(*[F.avg(a).alias(g) for a, g in zip(ACCEL, GRAVITY)])
    turned = rotation.rotate(trials, rotation.gravity_rotation(mean, *GRAVITY), ["trial"])
    return turned.select("trial", "frame", *[(F.round(c, 6) + 0.0).alias(c) for c in CHANNELS])


def _recursion_sql(source: str, name: str, b, a) -> str:
    """CTE ``name(trial, i, y)``: the difference equation run along ``source(trial, i, x)``."""
    order = len(a) - 1
    zi = filters.steady_state(np.array(b), np.array(a)).tolist()
    first_y = f"{b[0]!r} * x + {zi[0]!r} * x"
    first_z = [
        (f"{zi[k + 1]!r} * x + " if k + 1 < order else "") + f"{b[k + 1]!r} * x - {a[k + 1]!r} * ({first_y})"
        for k in range(order)
    ]
    y = f"({b[0]!r} * e.x + p.z0)"
    z = [
        (f"p.z{k + 1} + " if k + 1 < order else "") + f"{b[k + 1]!r} * e.x - {a[k + 1]!r} * {y}" for k in range(order)
    ]
    names = ", ".join(f"z{k}" for k in range(order))
    return f"""
{name}(trial, i, y, {names}) AS (
  SELECT trial, i, {first_y}, {", ".join(first_z)} FROM {source} WHERE i = 0
  UNION ALL
  SELECT p.trial, e.i, {y}, {", ".join(z)} FROM {name} p JOIN {source} e ON e.trial = p.trial AND e.i = p.i + 1)"""


def _zero_phase_sql(channel: str, source: str = "s", counts: str = "n") -> str:
    """CTEs up to ``bwd``: ``channel`` of ``source`` extended, filtered forwards and backwards."""
    b, a = (v.astype(float).tolist() for v in filters.butter_bandpass(4, 0.5, 20.0, 100.0))
    return f"""
ends AS (
  SELECT n.trial, n_frames AS n, f.{channel} AS x0, l.{channel} AS x1
  FROM {counts} n JOIN {source} f ON f.trial = n.trial AND f.frame = 0 JOIN {source} l ON l.trial = n.trial AND l.frame = n_frames - 1),
ext AS (
  SELECT trial, frame + 27 AS i, {channel} AS x FROM {source}
  UNION ALL
  SELECT trial, 27 - frame, 2 * x0 - {channel} FROM {source} JOIN ends USING (trial) WHERE frame BETWEEN 1 AND 27
  UNION ALL
  SELECT trial, 27 + n + (n - 2 - frame), 2 * x1 - {channel} FROM {source} JOIN ends USING (trial) WHERE frame BETWEEN n - 28 AND n - 2),
{_recursion_sql("ext", "fwd", b, a)},
rev AS (SELECT fwd.trial, n + 53 - i AS i, y AS x FROM fwd JOIN ends USING (trial)),
{_recursion_sql("rev", "bwd", b, a)}"""


def _filtered_select(channel: str) -> str:
    return f"""SELECT bwd.trial, (n + 53 - i - 27)::BIGINT AS frame, round(y, 3) + 0.0 AS {channel}
FROM bwd JOIN ends USING (trial) WHERE n + 53 - i BETWEEN 27 AND 26 + n"""


@query("bandpass", f"WITH RECURSIVE {SAMPLES_SQL}, {_zero_phase_sql('acc_z')}\n{_filtered_select('acc_z')}")
def bandpass(spark, sf_dir):
    """Zero-phase band-pass of the vertical channel of every trial."""
    trials = samples(spark, sf_dir).select("trial", "frame", "acc_z")
    filtered = filtering.bandpass(trials, ["trial"], ["acc_z"], 100.0)
    return filtered.select("trial", "frame", (F.round("acc_z", 3) + 0.0).alias("acc_z"))


_COUNTS_SQL = f"""
c AS (
  SELECT trial, frame, {", ".join(f"raw_{c} * {k!r}::DOUBLE AS {c}" for c, k in zip(CHANNELS, [32 / 8192] * 3 + [4000 / 65536] * 3))}
  FROM (SELECT l_suppkey AS trial, row_number() OVER (PARTITION BY l_suppkey
               ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS frame,
               {", ".join(f"{_RAW[r]} AS raw_{c}" for c, r in zip(CHANNELS, units.RAW_ACCEL + units.RAW_GYRO))} FROM lineitem)),
m AS (SELECT l_suppkey AS trial, round_even(count(*) / 2, 0)::BIGINT AS n_frames FROM lineitem GROUP BY 1),
taps(k, h) AS (VALUES {_TAPS}),
o AS (SELECT trial, unnest(generate_series(0, n_frames - 1)) AS i FROM m),
half AS (
  SELECT o.trial, i AS frame, {", ".join(f"sum(h * {a}) AS {a}" for a in ACCEL)}
  FROM o CROSS JOIN taps JOIN c ON c.trial = o.trial AND c.frame = i * 2 + 20 - k GROUP BY o.trial, i),
grav AS (SELECT trial, avg(acc_x) AS g_x, avg(acc_y) AS g_y, avg(acc_z) AS g_z FROM c GROUP BY trial),
{_rotation_sql("grav", "trial")},
turned AS (SELECT trial, frame, r31 * acc_x + r32 * acc_y + r33 * acc_z AS acc_z FROM half JOIN rot USING (trial))"""


@query(
    "harmonize",
    f"WITH RECURSIVE {_COUNTS_SQL}, {_zero_phase_sql('acc_z', 'turned', 'm')}\n{_filtered_select('acc_z')}",
)
def harmonize(spark, sf_dir):
    """Sensor counts at 200 Hz converted, resampled to 100 Hz, turned upright and filtered; vertical channel shown."""
    from kinelake.operators.blocks import number_rows
    from kinelake.plans.harmonize import harmonize as run
    from kinelake.queries.standins import SAMPLE_ORDER

    lines = table(spark, sf_dir, "lineitem")
    raw = lines.select(
        F.col("l_suppkey").alias("trial"), F.lit("sisfall").alias("dataset"), *SAMPLE_ORDER,
        *[F.expr(_RAW[c]).alias(c) for c in units.RAW_COLUMNS],
    )
    slices = F.struct(F.col("l_shipdate"), F.floor(F.col("l_orderkey") / 1_000_000))
    raw = filtering.shift_time(number_rows(raw, ["trial"], SAMPLE_ORDER, slices).drop(*SAMPLE_ORDER), 200.0)
    mean = units.convert_units(raw).groupBy("trial").agg(*[F.avg(a).alias(g) for a, g in zip(ACCEL, GRAVITY)])
    upright = run(raw, rotation.gravity_rotation(mean, *GRAVITY), 200.0, keys=["trial"], subject=["trial"])
    return upright.select("trial", "frame", (F.round("acc_z", 3) + 0.0).alias("acc_z"))


# Samples with faults put in by trial, to be found by the checks.
_FAULTY_SQL = f"""
timed AS (SELECT *, frame / 100.0::DOUBLE + CASE WHEN trial % 5 = 0 AND frame >= 50 THEN 0.004 ELSE 0 END AS time_s FROM s),
faulty AS (
  SELECT trial, frame, time_s,
         CASE WHEN trial % 7 = 0 AND frame = 10 THEN 'NaN'::DOUBLE ELSE acc_x END AS acc_x,
         CASE WHEN trial % 11 = 0 THEN 0.5 ELSE acc_y END AS acc_y,
         CASE WHEN trial % 13 = 0 AND frame % 100 = 0 THEN acc_z * 40 ELSE acc_z END AS acc_z,
         CASE WHEN trial % 17 = 0 AND frame = 20 THEN 'Infinity'::DOUBLE ELSE gyro_x END AS gyro_x, gyro_y, gyro_z
  FROM timed)"""


def _faulty(spark, sf_dir):
    trial, frame = F.col("trial"), F.col("frame")
    late = F.when((trial % 5 == 0) & (frame >= 50), 0.004).otherwise(0.0)
    return samples(spark, sf_dir).select(
        "trial",
        "frame",
        (frame / 100.0 + late).alias("time_s"),
        F.when((trial % 7 == 0) & (frame == 10), float("nan")).otherwise(F.col("acc_x")).alias("acc_x"),
        F.when(trial % 11 == 0, 0.5).otherwise(F.col("acc_y")).alias("acc_y"),
        F.when((trial % 13 == 0) & (frame % 100 == 0), F.col("acc_z") * 40).otherwise(F.col("acc_z")).alias("acc_z"),
        F.when((trial % 17 == 0) & (frame == 20), float("inf")).otherwise(F.col("gyro_x")).alias("gyro_x"),
        "gyro_y",
        "gyro_z",
    )


@query(
    "signal_checks",
    f"""WITH {SAMPLES_SQL}, {_FAULTY_SQL},
st AS (SELECT *, time_s - lag(time_s) OVER (PARTITION BY trial ORDER BY frame) AS step FROM faulty)
SELECT trial, count(*) AS n_frames, coalesce(bool_or(abs(step - 0.01) > 0.0010001), false) AS bad_step,
       round(min(step), 6) AS min_step, round(max(step), 6) AS max_step,
       bool_or(isnan(acc_x)) AS nan_acc_x, bool_or(isinf(gyro_x)) AS has_inf,
       round(max(abs(acc_z)), 6) AS max_acc_z, round(stddev_pop(acc_y), 6) AS std_acc_y
FROM st GROUP BY trial""",
)
def signal_checks(spark, sf_dir):
    stats = validate.signal_statistics(_faulty(spark, sf_dir), ["trial"], 100.0)
    return stats.select(
        "trial", "n_frames", "bad_step", "nan_acc_x", "has_inf",
        *[F.round(c, 6).alias(c) for c in ("min_step", "max_step", "max_acc_z", "std_acc_y")],
    )


_LABELLED = "CASE WHEN trial % 19 = 0 THEN 100 ELSE fall_onset_frame END"
_LABELLED_IMPACT = "CASE WHEN trial % 23 = 0 THEN NULL WHEN trial % 29 = 0 THEN 90 WHEN trial % 31 = 0 THEN 5000 ELSE fall_impact_frame END"


@query(
    "validate_trials",
    f"""WITH {SAMPLES_SQL}, {_FAULTY_SQL}, {CATALOG_SQL},
st AS (SELECT *, time_s - lag(time_s) OVER (PARTITION BY trial ORDER BY frame) AS step FROM faulty),
q AS (
  SELECT trial, count(*) AS n_frames, coalesce(bool_or(abs(step - 0.01) > 0.0010001), false) AS bad_step,
         bool_or(isnan(acc_x)) AS nan_x, bool_or(isinf(gyro_x)) AS has_inf,
         max(abs(acc_x)) AS max_x, max(abs(acc_z)) AS max_z,
         CASE WHEN trial % 11 = 0 THEN 0 ELSE stddev_pop(acc_y) END AS std_y
  FROM st GROUP BY trial),
grav AS (SELECT trial, avg(acc_x) AS g_x, avg(acc_y) AS g_y, avg(acc_z) AS g_z FROM s GROUP BY trial),
len AS (SELECT trial, sqrt(g_x*g_x + g_y*g_y + g_z*g_z) AS v FROM grav),
k AS (
  SELECT q.*, c.label, {_LABELLED.replace("trial", "c.trial")} AS o, {_LABELLED_IMPACT.replace("trial", "c.trial")} AS i, v,
         CASE WHEN c.activity_code IN ('T01', 'T02') THEN 6.0 END AS max_s
  FROM q JOIN c ON c.trial = q.trial JOIN len ON len.trial = q.trial)
SELECT trial, n_frames, concat_ws(',',
    CASE WHEN nan_x THEN 'nan' END, CASE WHEN has_inf THEN 'inf' END, CASE WHEN bad_step THEN 'timing' END,
    CASE WHEN NOT nan_x AND max_x > 20 THEN 'range_acc_x' END, CASE WHEN std_y < 1e-6 THEN 'flat_acc_y' END,
    CASE WHEN max_z > 20 THEN 'range_acc_z' END,
    CASE WHEN v < 0.8 OR v > 1.2 THEN 'gravity_vertical' END,
    CASE WHEN n_frames / 100 > max_s THEN 'duration' END,
    CASE WHEN label = 'adl' AND (o IS NOT NULL OR i IS NOT NULL) THEN 'adl_frames' END,
    CASE WHEN label <> 'adl' AND (o IS NULL) <> (i IS NULL) THEN 'one_frame' END,
    CASE WHEN label <> 'adl' AND o >= i THEN 'frame_order' END,
    CASE WHEN label <> 'adl' AND o IS NOT NULL AND i > n_frames THEN 'impact_late' END) AS codes
FROM k""",
)
def validate_trials(spark, sf_dir):
    trials = catalog(spark, sf_dir).drop("accepted")
    trials = trials.withColumns(
        {
            "fall_onset_frame": F.expr(_LABELLED).cast("int"),
            "fall_impact_frame": F.expr(_LABELLED_IMPACT).cast("int"),
        }
    )
    mean = samples(spark, sf_dir).groupBy("trial").agg(*[F.avg(a).alias(g) for a, g in zip(ACCEL, GRAVITY)])
    calibrations = rotation.gravity_rotation(mean, *GRAVITY)
    ranges = trials.filter(F.col("activity_code").isin("T01", "T02")).select(
        "activity_code", F.lit(0.0).alias("min_s"), F.lit(6.0).alias("max_s")
    )
    found = validate.validate(
        _faulty(spark, sf_dir), trials, calibrations, ["trial"], ["trial"], 100.0, ranges.distinct()
    )
    return found.select("trial", "n_frames", F.array_join("issue_codes", ",").alias("codes"))

