"""Analysis of window predictions: lead time, errors by distance, traces, demo and QA picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinelake.functions.channels import ACCEL, accel_magnitude
from kinelake.operators.blocks import BLOCK_FRAMES, join_spans, number_rows, with_blocks

# Bin edges in frames from onset.
DISTANCE_EDGES = [-400, -300, -200, -100, -50, -20, 0, 20, 50, 100, 200, 300, 400]


def lead_time(
    preds: DataFrame,
    keys: Sequence[str],
    rate_hz: float = 100.0,
    predicted: str = "predicted_label",
    start: str = "start_frame",
    impact: str = "fall_impact_frame",
) -> DataFrame:
    """Milliseconds from the first pre-impact prediction to impact per fall trial; null if none came before."""
    falls = preds.filter(F.col(impact).isNotNull())
    flagged = F.when((F.col(predicted) == "pre_impact") & (F.col(start) < F.col(impact)), F.col(start))
    first = falls.groupBy(*keys).agg(F.min(flagged).alias("_first"), F.max(impact).alias("_impact"))
    lead = (F.col("_impact") - F.col("_first")) / F.lit(float(rate_hz)) * 1000.0
    return first.select(*keys, lead.alias("lead_time_ms"))


def lead_time_summary(lead_times: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Trials, flagged trials, detection rate, mean and median lead time of the flagged.

    Lead times are whole frames, so they fold to counts before the median is taken.
    """
    by = list(by)
    counts = lead_times.groupBy(*by, "lead_time_ms").agg(F.count("*").alias("_n"))
    lead, n = F.col("lead_time_ms"), F.col("_n")
    flagged = F.coalesce(F.sum(F.when(lead.isNotNull(), n)), F.lit(0))
    empty = F.raise_error(F.lit("no trials to summarise")).cast("long")
    total = F.sum(n)
    checked = total if by else F.when(total.isNull(), empty).otherwise(total)
    return counts.groupBy(*by).agg(
        checked.alias("n_trials"),
        flagged.alias("n_flagged"),
        (flagged / total).alias("detection_rate"),
        (F.sum(lead * n) / F.sum(F.when(lead.isNotNull(), n))).alias("mean_lead_ms"),
        F.percentile(lead, 0.5, n).alias("median_lead_ms"),
    )


def distance_bin(distance: Column, edges: Sequence[int] = DISTANCE_EDGES) -> Column:
    """Number of the right-closed bin (low, high] holding the distance; null outside all of them."""
    chain = None
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        test = (distance > low) & (distance <= high)
        chain = F.when(test, F.lit(i)) if chain is None else chain.when(test, F.lit(i))
    return chain


def errors_by_distance(preds: DataFrame, edges: Sequence[int] = DISTANCE_EDGES, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy and false pre-impact rate of fall windows by distance of their start from onset."""
    falls = preds.filter(F.col("fall_onset_frame").isNotNull())
    number = distance_bin(F.col("start_frame") - F.col("fall_onset_frame"), edges)
    binned = falls.withColumn("bin", number).filter(F.col("bin").isNotNull())
    correct = F.col("predicted_label") == F.col("label")
    false_alarm = (F.col("predicted_label") == "pre_impact") & (F.col("label") != "pre_impact")
    found = binned.groupBy(*by, "bin").agg(
        F.count("*").alias("n"),
        F.avg(correct.cast("int")).alias("accuracy"),
        F.avg(false_alarm.cast("int")).alias("false_pre_impact_rate"),
    )
    lows = F.array(*[F.lit(e) for e in edges])
    return found.select(
        *by,
        F.element_at(lows, F.col("bin") + 1).alias("low"),
        F.element_at(lows, F.col("bin") + 2).alias("high"),
        "n",
        "accuracy",
        "false_pre_impact_rate",
    )


def adl_false_positives(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Windows, accuracy and pre-impact rate of trials without onset."""
    daily = preds.filter(F.col("fall_onset_frame").isNull())
    return daily.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg((F.col("predicted_label") == F.col("label")).cast("int")).alias("accuracy"),
        F.avg((F.col("predicted_label") == "pre_impact").cast("int")).alias("pre_impact_rate"),
    )


def trial_trace(preds: DataFrame, where: Column | None = None) -> DataFrame:
    """Windows with an onset or impact marker (impact wins) and a mismatch flag."""
    chosen = preds if where is None else preds.filter(where)

    def inside(frame: str) -> Column:
        return (F.col("start_frame") <= F.col(frame)) & (F.col(frame) < F.col("end_frame"))

    marker = F.when(inside("fall_impact_frame"), "impact").when(inside("fall_onset_frame"), "onset")
    return chosen.withColumns({"marker": marker, "mismatch": F.col("predicted_label") != F.col("label")})


def alert_timing(alerts: DataFrame, keys: Sequence[str], rate_hz: float = 100.0) -> DataFrame:
    """First escalation and first FALL of every fall trial, against onset and impact."""
    seconds = F.col("start_frame") / F.lit(float(rate_hz))
    falls = alerts.filter(F.col("fall_onset_frame").isNotNull())
    timing = falls.groupBy(*keys).agg(
        (F.max("fall_onset_frame") / F.lit(float(rate_hz))).alias("onset_s"),
        (F.max("fall_impact_frame") / F.lit(float(rate_hz))).alias("impact_s"),
        F.min(F.when(F.col("state") != "calm", seconds)).alias("first_escalation_s"),
        F.min(F.when(F.col("state") == "fall", seconds)).alias("first_fall_s"),
    )
    timing = timing.withColumns(
        {
            "lead_s": F.col("onset_s") - F.col("first_escalation_s"),
            "fall_lag_s": F.col("first_fall_s") - F.col("impact_s"),
            "reached_fall": F.col("first_fall_s").isNotNull(),
        }
    )
    safe = (F.col("lead_s") <= 0.3) & F.col("reached_fall") & (F.col("fall_lag_s") <= 1.0)
    return timing.withColumn("safe_for_demo", F.coalesce(safe, F.lit(False)))


def demo_candidates(alerts: DataFrame, keys: Sequence[str], rate_hz: float = 100.0, k: int = 5) -> DataFrame:
    """The ``k`` safe trials with the cleanest timing; offsets equal to a microsecond tie, by key."""
    safe = alert_timing(alerts, keys, rate_hz).filter("safe_for_demo")
    offset = F.round(F.abs("lead_s") + F.abs("fall_lag_s"), 6)
    return safe.withColumn("offset_s", offset).orderBy("offset_s", *keys).limit(k)


def state_changes(
    alerts: DataFrame, keys: Sequence[str], order: str = "window_index", state: str = "state", size: int = BLOCK_FRAMES
) -> DataFrame:
    """Rows at which the state differs from the one before; the first row of a series counts.

    ``order`` numbers the rows of a series from 0 without gaps.
    """
    blocked = with_blocks(alerts, order, before=1, size=size)
    before = F.lag(state).over(W.partitionBy(*keys, "block").orderBy(order))
    changed = blocked.withColumn("previous", before).filter("core")
    return changed.filter(~F.col(state).eqNullSafe(F.col("previous"))).drop("core", "block")


def settling_check(
    samples: DataFrame,
    trials: DataFrame,
    n_subjects: int = 8,
    frames: int = 100,
    subject: str = "subject_id",
    trial: Sequence[str] = ("trial",),
    frame: str = "frame",
) -> DataFrame:
    """Spread of acceleration in the first second of a fall and of a daily activity of some subjects.

    Subjects are taken at even steps in name order, up to ``n_subjects``; the trials are the first
    of each kind in ``path`` order. Subjects lacking either kind are left out.
    """
    trial = list(trial)
    subjects = trials.select(subject).distinct()
    ranked = number_rows(subjects, [], [subject], F.substring(subject, 1, 10), "_rank")
    total = subjects.agg(F.count("*").alias("_n")).withColumn("_one", F.lit(1))
    ranked = ranked.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one")  # one row
    step = F.greatest(F.lit(1).cast("long"), F.floor(F.col("_n") / n_subjects))
    taken = ranked.filter((F.col("_rank") % step == 0) & (F.col("_rank") / step < n_subjects)).select(subject)
    first = F.min(F.struct("path", *trial)).alias("_first")
    picked = trials.join(F.broadcast(taken), subject).groupBy(subject, "label").agg(first)  # n_subjects rows
    picked = picked.select(subject, "label", *[F.col(f"_first.{c}").alias(c) for c in trial])
    head = samples.filter(F.col(frame) < frames).select(*trial, frame, accel_magnitude().alias("_mag"))
    spread = head.join(F.broadcast(picked), trial).groupBy(subject, "label").agg(F.stddev_samp("_mag").alias("_std"))  # <= 2 rows a subject
    wide = spread.groupBy(subject).pivot("label", ["adl", "fall"]).agg(F.first("_std"))
    both = wide.filter(F.col("adl").isNotNull() & F.col("fall").isNotNull())
    ratio = F.when(F.col("adl") > 0, F.col("fall") / F.col("adl")).otherwise(float("inf"))
    return both.select(subject, F.col("adl").alias("adl_std"), F.col("fall").alias("fall_std"), ratio.alias("ratio"))


def impact_peaks(
    samples: DataFrame, trials: DataFrame, keys: Sequence[str], half_window: int = 50, frame: str = "frame"
) -> DataFrame:
    """Where magnitude and each axis peak around the labelled impact, against the label.

    Searches [impact - half_window, impact + half_window); the first of equal peaks counts.
    """
    labelled = trials.filter((F.col("label") == "fall") & F.col("fall_impact_frame").isNotNull())
    spans = labelled.select(
        *keys,
        "fall_onset_frame",
        "fall_impact_frame",
        (F.col("fall_impact_frame") - half_window).alias("_from"),
        (F.col("fall_impact_frame") + half_window).alias("_to"),
    )
    near = join_spans(samples.select(*keys, frame, *ACCEL), spans, keys, "_from", "_to", frame, 2 * half_window)
    near = near.withColumn("_mag", accel_magnitude())

    def peak(value: Column, *carry: str) -> Column:
        return F.max(F.struct(value.alias("v"), (-F.col(frame)).alias("f"), *carry))

    found = near.groupBy(*keys, "fall_onset_frame", "fall_impact_frame").agg(
        peak(F.col("_mag")).alias("_m"), *[peak(F.abs(a), a).alias(f"_{a}") for a in ACCEL]
    )
    impact = F.col("fall_impact_frame")
    columns = [(-F.col("_m.f")).alias("magnitude_peak_frame"), (-F.col("_m.f") - impact).alias("magnitude_peak_offset")]
    for a in ACCEL:
        columns += [
            (-F.col(f"_{a}.f")).alias(f"{a}_peak_frame"),
            (-F.col(f"_{a}.f") - impact).alias(f"{a}_peak_offset"),
            F.col(f"_{a}.{a}").alias(f"{a}_peak_value"),
        ]
    return found.select(*keys, "fall_onset_frame", "fall_impact_frame", *columns)


def pick_qa_trials(trials: DataFrame, k: int = 3, subject: Sequence[str] = ("subject_id",), order: str = "path") -> DataFrame:
    """Up to ``k`` trials per subject: its first daily activity, its first fall, then others in order.

    The ranking filter keeps at most ``k`` rows per subject and label on the map side.
    """
    subject = list(subject)
    in_label = F.row_number().over(W.partitionBy(*subject, "label").orderBy(order))
    leaders = trials.withColumn("_nth", in_label).filter(F.col("_nth") <= k)
    place = F.when(F.col("_nth") > 1, 2).when(F.col("label") == "adl", 0).otherwise(1)
    leaders = leaders.withColumn("_place", place)
    ranked = F.row_number().over(W.partitionBy(*subject).orderBy("_place", order))
    return leaders.withColumn("pick", ranked).filter(F.col("pick") <= k).drop("_nth", "_place")
