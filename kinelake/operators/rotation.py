"""Gravity alignment: rotation onto the vertical, calibration per subject, group fallback."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.functions.channels import ACCEL, GYRO
from kinelake.operators.blocks import join_spans

ROTATION = [f"r{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)]
GRAVITY = ["g_x", "g_y", "g_z"]


@dataclass(frozen=True)
class CalibrationConfig:
    """Which trials can calibrate a subject."""

    standing_tasks: frozenset[int]
    primary_task: int | None = None
    primary_source: str = "T01"
    min_coverage: float = 0.5
    min_seconds: float = 2.0
    daily_only: bool = False


# Calibration tasks per dataset.
CALIBRATION = {
    "kfall": CalibrationConfig(frozenset({2, 6, 7, 8, 9, 20, 21}), primary_task=1),
    "sisfall": CalibrationConfig(frozenset({7, 8, 9, 10, 15, 16, 17})),
}


def gravity_rotation(df: DataFrame, gx: str, gy: str, gz: str) -> DataFrame:
    """Add r11..r33, the rotation taking (gx, gy, gz) onto the vertical axis (0, 0, 1)."""
    norm = F.sqrt(F.col(gx) ** 2 + F.col(gy) ** 2 + F.col(gz) ** 2)
    no_direction = F.raise_error(F.lit("mean acceleration is about zero: no gravity direction")).cast("double")
    length = F.when(norm < 1e-8, no_direction).otherwise(norm)
    unit = df.withColumns({"_a": F.col(gx) / length, "_b": F.col(gy) / length, "_c": F.col(gz) / length})
    a, b, c = F.col("_a"), F.col("_b"), F.col("_c")
    side2 = a * a + b * b
    k = (1 - c) / side2
    aligned = F.sqrt(side2) < 1e-8
    # Opposite to the vertical: half a turn about a horizontal axis at right angles to the vector.
    flip2 = b * b + c * c
    general = [1 - k * a * a, -k * a * b, -a, -k * a * b, 1 - k * b * b, -b, a, b, 1 - k * side2]
    same = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    turned = [
        F.lit(-1.0), F.lit(0.0), F.lit(0.0),
        F.lit(0.0), 2 * c * c / flip2 - 1, -2 * b * c / flip2,
        F.lit(0.0), -2 * b * c / flip2, 2 * b * b / flip2 - 1,
    ]
    cells = {
        name: F.when(aligned & (c > 0), F.lit(s)).when(aligned, t).otherwise(g)
        for name, g, s, t in zip(ROTATION, general, same, turned)
    }
    return unit.withColumns(cells).drop("_a", "_b", "_c")


def _turn(axes: Sequence[str]) -> dict[str, Column]:
    return {
        out: sum((F.col(f"r{i}{j}") * F.col(axis) for j, axis in enumerate(axes, 1)), F.lit(0.0))
        for i, out in enumerate(axes, 1)
    }


def apply_rotation(samples: DataFrame) -> DataFrame:
    """Rotate acceleration and, if present, angular rate by the r11..r33 of the row."""
    turned: dict[str, Column] = {}
    for axes in (ACCEL, GYRO):
        if all(a in samples.columns for a in axes):
            turned |= _turn(axes)
    return samples.withColumns(turned)


def rotate(samples: DataFrame, calibrations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rotate each sample by its subject's calibration.

    There is one calibration row per subject; samples of a subject without one keep their place, with
    channels missing, so that validation can name them. Spark broadcasts it when its size allows and
    otherwise splits large subjects in the sort-merge join (adaptive skew join).
    """
    joined = samples.join(calibrations.select(*keys, *ROTATION), list(keys), "left")
    return apply_rotation(joined).select(*samples.columns)


def rotated_gravity(calibrations: DataFrame) -> DataFrame:
    """Add v_x, v_y, v_z: each calibration applied to its own gravity vector."""
    cells = {
        f"v_{axis}": sum((F.col(f"r{i}{j}") * F.col(g) for j, g in enumerate(GRAVITY, 1)), F.lit(0.0))
        for i, axis in enumerate("xyz", 1)
    }
    return calibrations.withColumns(cells)


def choose_segments(
    segments: DataFrame, trials: DataFrame, subject: Sequence[str], trial: Sequence[str], config: CalibrationConfig
) -> DataFrame:
    """The stillness segment that calibrates each subject; null where there is none.

    First choice is the subject's first primary trial if it is still for long enough, then the
    first standing trial, by task and trial id, with any still segment. ``trials`` needs
    ``task_id``, ``trial_id``, ``path`` and ``n_frames``; ``segments`` has start and end frames.
    """
    subject, trial = list(subject), list(trial)
    found = trials.join(segments.select(*trial, "start_frame", "end_frame"), trial, "left")
    ids = list(dict.fromkeys(trial))
    pick = F.struct(*ids, "start_frame", "end_frame")
    covered = (F.col("end_frame") - F.col("start_frame")) / F.col("n_frames") >= config.min_coverage
    is_primary = F.lit(False) if config.primary_task is None else F.col("task_id") == config.primary_task
    standing = F.col("task_id").isin(sorted(config.standing_tasks)) & F.col("start_frame").isNotNull()
    if config.daily_only:
        standing = standing & (F.col("label") == "adl")
    # Minimum of (order, choice) per subject: folds on the map side, no per-subject sort.
    first = F.min(F.when(is_primary, F.struct(F.col("path"), F.coalesce(covered, F.lit(False)).alias("ok"), pick.alias("pick"))))
    second = F.min(F.when(standing, F.struct("task_id", "trial_id", "path", pick.alias("pick"))))
    best = found.groupBy(*subject).agg(first.alias("_first"), second.alias("_second"))
    use_first = F.coalesce(F.col("_first.ok"), F.lit(False))
    chosen = best.select(
        *subject,
        F.when(use_first, F.col("_first.pick")).otherwise(F.col("_second.pick")).alias("_pick"),
        F.when(use_first, F.lit(config.primary_source))
        .when(F.col("_second").isNotNull(), F.lit("auto_detected"))
        .alias("source"),
    )
    picked = [F.col(f"_pick.{c}").alias(c) for c in [*ids, "start_frame", "end_frame"] if c not in subject]
    return chosen.select(*subject, *picked, "source")


def segment_gravity(samples: DataFrame, chosen: DataFrame, trial: Sequence[str], subject: Sequence[str], frame: str = "frame") -> DataFrame:
    """Mean acceleration over each chosen segment."""
    spans = chosen.filter(F.col("source").isNotNull())
    names = list(dict.fromkeys([*subject, *trial]))
    spans = spans.select(*names, "source", "start_frame", "end_frame")
    inside = join_spans(samples.select(*trial, frame, *ACCEL), spans, trial, "start_frame", "end_frame", frame)
    return inside.groupBy(*subject, "source").agg(*[F.avg(a).alias(g) for a, g in zip(ACCEL, GRAVITY)])


def calibrate(
    samples: DataFrame,
    segments: DataFrame,
    trials: DataFrame,
    subject: Sequence[str],
    trial: Sequence[str],
    config: CalibrationConfig,
    frame: str = "frame",
) -> DataFrame:
    """Gravity vector, rotation and source per subject; nulls where no trial calibrates."""
    chosen = choose_segments(segments, trials, subject, trial, config)
    gravity = gravity_rotation(segment_gravity(samples, chosen, trial, subject, frame), *GRAVITY)
    return chosen.select(*subject).join(gravity, list(subject), "left")


def group_fallback(calibrations: DataFrame, batch: Sequence[str]) -> DataFrame:
    """Give uncalibrated subjects the rotation of the mean gravity direction of their batch."""
    norm = F.sqrt(sum((F.col(g) ** 2 for g in GRAVITY), F.lit(0.0)))
    valid = calibrations.filter(F.col("source").isNotNull())
    mean = valid.groupBy(*batch).agg(*[F.avg(F.col(g) / norm).alias(f"_{g}") for g in GRAVITY])
    mean = gravity_rotation(mean, *[f"_{g}" for g in GRAVITY])
    mean = mean.select(*batch, *[f"_{g}" for g in GRAVITY], *[F.col(r).alias(f"_{r}") for r in ROTATION])
    joined = calibrations.join(mean, list(batch), "left")
    missing = F.col("source").isNull()
    none_valid = F.raise_error(F.lit("no calibrated subject in this batch to average from")).cast("string")
    source = (
        F.when(missing & F.col("_g_x").isNull(), none_valid)
        .when(missing, F.lit("group_fallback"))
        .otherwise(F.col("source"))
    )
    filled = {c: F.when(missing, F.col(f"_{c}")).otherwise(F.col(c)) for c in [*GRAVITY, *ROTATION]}
    return joined.withColumns({**filled, "source": source}).select(*calibrations.columns)


def calibration_counts(calibrations: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return calibrations.groupBy(*by, "source").agg(F.count("*").alias("n_subjects"))
