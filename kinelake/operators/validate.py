"""Checks on harmonized series. Each failed check adds an issue; a series without any is accepted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinelake.functions.channels import ACCEL, HARMONIZED_COLUMNS
from kinelake.operators.blocks import BLOCK_FRAMES, with_blocks
from kinelake.operators.rotation import rotated_gravity

# Bounds of the checks.
MAX_ACCEL_G = 20.0
FLATLINE_STD = 1e-6
STEP_TOLERANCE = 0.1
RELATIVE_TOLERANCE = 1e-5
VERTICAL_RANGE = (0.8, 1.2)
MAX_HORIZONTAL = 0.2


def _issue(code: str, when: Column, *message: str | Column) -> Column:
    text = F.concat(*[m if isinstance(m, Column) else F.lit(m) for m in message])
    return F.when(when, F.struct(F.lit(code).alias("code"), text.alias("message")))


def _number(column: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", column)


def signal_statistics(
    samples: DataFrame,
    keys: Sequence[str],
    rate_hz: float,
    frame: str = "frame",
    size: int = BLOCK_FRAMES,
) -> DataFrame:
    """What the signal checks need, one row per series."""
    step = 1.0 / rate_hz
    signal = [c for c in HARMONIZED_COLUMNS if c in samples.columns]
    blocked = with_blocks(samples.select(*keys, frame, *signal), frame, before=1, size=size)
    ordered = W.partitionBy(*keys, "block").orderBy(frame)
    stepped = blocked.withColumn("_step", F.col("time_s") - F.lag("time_s").over(ordered))
    stepped = stepped.withColumn("_stepped", F.lag(frame).over(ordered).isNotNull()).filter("core")
    allowed = step * STEP_TOLERANCE + RELATIVE_TOLERANCE * step
    close = F.coalesce(~F.isnan("_step") & (F.abs(F.col("_step") - step) <= allowed), F.lit(False))

    def broken(c: str) -> Column:
        return F.col(c).isNull() | F.isnan(c)

    infinite = F.lit(False)
    for c in signal:
        infinite = infinite | F.coalesce(F.abs(c) == float("inf"), F.lit(False))
    stats = [
        F.count("*").alias("n_frames"),
        F.bool_or(F.col("_stepped") & ~close).alias("bad_step"),
        F.min("_step").alias("min_step"),
        F.max("_step").alias("max_step"),
        F.bool_or(infinite).alias("has_inf"),
        *[F.bool_or(broken(c)).alias(f"nan_{c}") for c in signal],
        *[F.max(F.abs(c)).alias(f"max_{c}") for c in ACCEL if c in signal],
        *[F.stddev_pop(c).alias(f"std_{c}") for c in ACCEL if c in signal],
    ]
    return stepped.groupBy(*keys).agg(*stats)


def signal_issues(columns: Sequence[str], rate_hz: float, beside: Sequence[str] = ()) -> list[Column]:
    """Schema, missing or infinite values, timing, plausibility and flatline checks, in order.

    The schema is exact: all columns but those ``beside`` the signal (keys, frame), in their order.
    """
    signal = [c for c in HARMONIZED_COLUMNS if c in columns]
    found = [c for c in columns if c not in beside]
    issues = []
    if found != HARMONIZED_COLUMNS:
        issues.append(_issue("schema", F.lit(True), f"columns should be {HARMONIZED_COLUMNS}, got {found}"))
    bad = F.array_compact(F.array(*[F.when(F.col(f"nan_{c}"), F.lit(c)) for c in signal]))
    issues.append(_issue("nan", F.size(bad) > 0, "NaN values in column(s): ", F.array_join(bad, ", ")))
    issues.append(_issue("inf", F.col("has_inf"), "infinite values in signal"))
    issues.append(
        _issue(
            "timing",
            F.col("bad_step"),
            f"uneven time steps: expected about {1.0 / rate_hz:.5f}s, found ",
            F.coalesce(_number(F.col("min_step"), 5), F.lit("null")),
            " to ",
            F.coalesce(_number(F.col("max_step"), 5), F.lit("null")),
        )
    )
    for c in [a for a in ACCEL if a in signal]:
        # A series with NaN fails neither bound: NaN would compare as the largest value.
        clean = ~F.col(f"nan_{c}")
        peak, spread = F.col(f"max_{c}"), F.col(f"std_{c}")
        issues.append(
            _issue(f"range_{c}", clean & (peak > MAX_ACCEL_G), f"{c}: ", _number(peak, 1), f"g exceeds {MAX_ACCEL_G}g")
        )
        issues.append(
            _issue(f"flat_{c}", clean & (spread < FLATLINE_STD), f"{c}: flatline, likely sensor dropout")
        )
    return issues


def calibration_issues() -> list[Column]:
    """Rotated gravity must be about 1 g and vertical. Needs v_x, v_y, v_z."""
    low, high = VERTICAL_RANGE
    v = F.col("v_z")
    return [
        _issue(
            "gravity_vertical",
            ~v.between(low, high) | F.isnan(v),
            "rotated gravity has vertical part ", _number(v, 3), f" outside [{low}, {high}]",
        ),
        _issue(
            "gravity_horizontal",
            (F.abs("v_x") > MAX_HORIZONTAL) | (F.abs("v_y") > MAX_HORIZONTAL),
            "rotated gravity has horizontal parts ", _number(F.col("v_x"), 3), ", ", _number(F.col("v_y"), 3),
        ),
    ]


def duration_issue(n: Column, rate_hz: float, low: str, high: str) -> Column:
    """Duration within the optional range of the activity; no range, no check."""
    seconds = n / F.lit(float(rate_hz))
    return _issue(
        "duration",
        F.col(low).isNotNull() & F.col(high).isNotNull() & ~seconds.between(F.col(low), F.col(high)),
        "duration ", _number(seconds, 2), "s outside the range of this activity",
    )


def label_issues(n: Column, label: str = "label", onset: str = "fall_onset_frame", impact: str = "fall_impact_frame") -> list[Column]:
    """Onset and impact must fit the label, each other and the series."""
    o, i = F.col(onset), F.col(impact)
    adl = F.coalesce(F.col(label) == "adl", F.lit(False))
    both = ~adl & o.isNotNull() & i.isNotNull()
    shown = [
        "(onset=", F.coalesce(o.cast("string"), F.lit("none")),
        ", impact=", F.coalesce(i.cast("string"), F.lit("none")), ")",
    ]
    return [
        _issue("adl_frames", adl & (o.isNotNull() | i.isNotNull()), "daily activity has fall frames ", *shown),
        _issue("one_frame", ~adl & (o.isNull() != i.isNull()), "fall has only one of onset and impact ", *shown),
        _issue("frame_order", both & (o >= i), "onset is not before impact ", *shown),
        _issue("impact_late", both & (i > n), "impact is past the end of the signal ", *shown),
    ]


def validate(
    samples: DataFrame,
    trials: DataFrame,
    calibrations: DataFrame,
    keys: Sequence[str],
    subject: Sequence[str],
    rate_hz: float,
    duration_ranges: DataFrame | None = None,
    frame: str = "frame",
    size: int = BLOCK_FRAMES,
) -> DataFrame:
    """Trials with ``issues`` (messages), ``issue_codes``, ``accepted`` and ``n_frames``, also those without samples
    or without a calibration of their subject.

    ``duration_ranges`` optionally gives ``activity_code``, ``min_s``, ``max_s``.
    """
    stats = signal_statistics(samples, keys, rate_hz, frame, size)
    checked = trials.drop("n_frames").join(stats, list(keys), "left")
    gravity = rotated_gravity(calibrations).select(*subject, "v_x", "v_y", "v_z")
    checked = checked.join(gravity, list(subject), "left")
    if duration_ranges is None:
        checked = checked.withColumns({"min_s": F.lit(None).cast("double"), "max_s": F.lit(None).cast("double")})
    else:
        checked = checked.join(duration_ranges, ["activity_code"], "left")
    n = F.col("n_frames")
    absent = [
        _issue("no_samples", n.isNull(), "the trial has no samples"),
        _issue("no_calibration", F.col("v_x").isNull() | F.col("v_y").isNull() | F.col("v_z").isNull(), "the subject has no calibration"),
    ]
    issues = absent + signal_issues(samples.columns, rate_hz, {*keys, *subject, frame}) + calibration_issues()
    issues += [duration_issue(n, rate_hz, "min_s", "max_s")] + label_issues(n)
    checked = checked.withColumn("_issues", F.array_compact(F.array(*issues)))
    return checked.select(
        *trials.drop("n_frames").columns,
        F.coalesce("n_frames", F.lit(0)).alias("n_frames"),
        F.col("_issues.message").alias("issues"),
        F.col("_issues.code").alias("issue_codes"),
        (F.size("_issues") == 0).alias("accepted"),
    )
