"""Sliding windows over numbered series: boundaries, labels and samples."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.functions.channels import half_even
from kinelake.operators.blocks import BLOCK_FRAMES, join_spans

# Class names and ids.
LABEL_IDS = {"non_fall": 0, "pre_impact": 1, "fall": 2}


@dataclass(frozen=True)
class WindowConfig:
    """Window length and stride in seconds at a sample rate."""

    window_s: float = 2.0
    stride_s: float = 1.0
    rate_hz: float = 100.0

    @property
    def length(self) -> int:
        return round(self.window_s * self.rate_hz)

    @property
    def stride(self) -> int:
        return round(self.stride_s * self.rate_hz)


DETECTION_WINDOWS = WindowConfig(2.0, 1.0)
PREDICTION_WINDOWS = WindowConfig(1.0, 0.1)


def full_windows(n: Column, length: int, stride: int) -> Column:
    """Number of windows on the stride grid; a series no longer than a window has one."""
    return F.when(n > length, F.floor((n - length) / stride) + 1).otherwise(F.lit(1).cast("long"))


def last_full_end(n: Column, length: int, stride: int) -> Column:
    return (full_windows(n, length, stride) - 1) * stride + length


def window_specs(
    series: DataFrame, n_col: str, length: int, stride: int, per_task: int = BLOCK_FRAMES
) -> DataFrame:
    """One row per window: index, start, end (exclusive), real and padded sample counts.

    A remainder after the last full window becomes one more, padded window starting where that
    one ended and running to the end of the series (with a stride beyond the window length it may
    hold more than a window; its samples past the length go unused, and its padding is negative).
    Series without samples have no windows. Windows are generated in runs of
    ``per_task``, spread over the cluster before they are expanded.
    """
    n = F.col(n_col).cast("long")
    full = full_windows(n, length, stride)
    extra = F.when((n > length) & (last_full_end(n, length, stride) < n), 1).otherwise(0)
    total = full + extra
    runs = series.filter(n > 0).withColumn(
        "_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((total - 1) / per_task)))
    )
    # A fixed number of partitions: run rows are few and small, what they expand to is not.
    partitions = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = runs.repartition(partitions, *runs.columns)
    low = F.col("_run") * per_task
    high = F.least(low + per_task, total) - 1
    windows = runs.withColumn("window_index", F.explode(F.sequence(low, high)))
    index = F.col("window_index")
    start = F.when(index < full, index * stride).otherwise(last_full_end(n, length, stride))
    windows = windows.withColumn("start_frame", start)
    end = F.when(index < full, F.least(F.col("start_frame") + length, n)).otherwise(n)
    windows = windows.withColumn("end_frame", end)
    real = F.col("end_frame") - F.col("start_frame")
    return windows.withColumns({"n_real_samples": real, "n_pad_samples": F.lit(length) - real}).drop("_run")


def onset_impact_label(start: Column, end: Column, onset: Column, impact: Column) -> Column:
    """Class of a window from the onset and impact frames of its trial (``end`` is exclusive)."""
    disorder = F.raise_error(
        F.concat(F.lit("onset frame must precede impact frame: "), onset, F.lit(" >= "), impact)
    ).cast("string")
    return (
        F.when(onset.isNull() | impact.isNull(), F.lit("non_fall"))
        .when(onset >= impact, disorder)
        .when(end > impact, F.lit("fall"))
        .when(end > onset, F.lit("pre_impact"))
        .otherwise(F.lit("non_fall"))
    )


def label_id(label: Column) -> Column:
    chain = None
    for name, number in LABEL_IDS.items():
        test = label == name
        chain = F.when(test, F.lit(number)) if chain is None else chain.when(test, F.lit(number))
    return chain


def trial_samples(duration_s: Column, rate_hz: Column | float) -> Column:
    """Samples in a trial from its duration."""
    return half_even(duration_s * rate_hz)


def global_subject(dataset: str = "dataset", subject: str = "subject_id") -> Column:
    """Subject ids repeat across datasets; this one does not."""
    return F.concat_ws("_", F.col(dataset), F.col(subject))


DETECTION_COLUMNS = [
    "dataset", "subject_id", "global_subject_id", "activity_code", "trial_id", "label",
    "window_index", "start_frame", "end_frame", "n_real_samples", "n_pad_samples", "harmonized_path",
]
PREDICTION_COLUMNS = [
    "dataset", "subject_id", "global_subject_id", "activity_code", "trial_id", "label", "label_id",
    "window_index", "start_frame", "end_frame", "n_real_samples", "n_pad_samples",
    "fall_onset_frame", "fall_impact_frame", "harmonized_path",
]


def detection_windows(trials: DataFrame, config: WindowConfig = DETECTION_WINDOWS) -> DataFrame:
    """Windows of the given catalogue rows, labelled 1 throughout a fall trial."""
    rows = trials.withColumn("_n", trial_samples(F.col("duration_s"), config.rate_hz))
    rows = rows.withColumns(
        {"global_subject_id": global_subject(), "label": (F.col("label") == "fall").cast("int")}
    )
    windows = window_specs(rows, "_n", config.length, config.stride)
    return windows.select(*[c for c in DETECTION_COLUMNS if c in windows.columns])


def prediction_windows(trials: DataFrame, config: WindowConfig = PREDICTION_WINDOWS) -> DataFrame:
    """Dense windows of the given catalogue rows, labelled from onset and impact."""
    rows = trials.withColumn("_n", trial_samples(F.col("duration_s"), config.rate_hz))
    rows = rows.withColumn("global_subject_id", global_subject()).drop("label")
    windows = window_specs(rows, "_n", config.length, config.stride)
    label = onset_impact_label(
        F.col("start_frame"), F.col("end_frame"), F.col("fall_onset_frame"), F.col("fall_impact_frame")
    )
    windows = windows.withColumn("label", label)
    windows = windows.withColumn("label_id", label_id(F.col("label")))
    return windows.select(*[c for c in PREDICTION_COLUMNS if c in windows.columns])


def assign_windows(samples: DataFrame, n_col: str, length: int, stride: int, frame: str = "frame") -> DataFrame:
    """Send every sample to the windows it lies in, without a join.

    Adds ``window_index``, ``offset`` within the window and ``is_pad``. The last sample is
    repeated to fill a short window. ``samples`` carries the series length in ``n_col``.
    """
    f, n = F.col(frame), F.col(n_col)
    full = full_windows(n, length, stride)
    end = last_full_end(n, length, stride)
    low = F.greatest(F.lit(0).cast("long"), F.floor((f - length + stride) / stride))
    high = F.least(full - 1, F.floor(f / stride))
    nothing = F.array().cast("array<bigint>")
    on_grid = F.when(low <= high, F.sequence(low, high)).otherwise(nothing)
    tail = (n > length) & (f >= end) & (f < end + length)
    is_last = f == n - 1
    pads = (
        F.when(is_last & (n < length), F.array_repeat(F.lit(0).cast("long"), (F.lit(length) - n).cast("int")))
        .when(
            is_last & (n > length) & (end < n),
            F.array_repeat(full, F.greatest(F.lit(length) - (n - end), F.lit(0)).cast("int")),
        )
        .otherwise(nothing)
    )
    real = F.concat(on_grid, F.when(tail, F.array(full)).otherwise(nothing))
    rows = samples.select("*", F.size(real).alias("_real"), F.posexplode(F.concat(real, pads)).alias("_pos", "window_index"))
    start = F.when(F.col("window_index") < full, F.col("window_index") * stride).otherwise(end)
    pad_number = F.greatest(F.col("_pos") - F.col("_real") + 1, F.lit(0))
    return rows.withColumns(
        {"offset": f - start + pad_number, "is_pad": pad_number > 0}
    ).drop("_pos", "_real")


def real_windows(windows: DataFrame) -> DataFrame:
    """The windows; one that has no real samples is an error."""
    empty = F.raise_error(F.lit("window without real samples")).cast("boolean")
    return windows.filter(F.when(F.col("end_frame") <= F.col("start_frame"), empty).otherwise(F.lit(True)))


def materialize_windows(
    windows: DataFrame, samples: DataFrame, keys: Sequence[str], length: int, frame: str = "frame"
) -> DataFrame:
    """Samples of the given windows, ``length`` rows each, the last real one repeated as padding.

    Works for any set of windows. Both sides meet on (keys, cell of ``length`` frames): a window
    touches at most two cells, so the range condition never runs over a whole series.
    """
    spans = real_windows(windows).withColumn("_used", F.least(F.col("end_frame"), F.col("start_frame") + length))
    joined = join_spans(samples, spans, keys, "start_frame", "_used", frame, length).drop("_used")
    copies = F.when(F.col(frame) == F.col("end_frame") - 1, F.lit(length) - (F.col("end_frame") - F.col("start_frame")) + 1)
    copies = F.greatest(F.coalesce(copies, F.lit(1)), F.lit(1)).cast("int")
    # A real sample makes one row; the last one makes a row per padded position as well.
    rows = joined.select("*", F.posexplode(F.array_repeat(F.lit(0), copies)).alias("_copy", "_zero"))
    return rows.withColumns(
        {"offset": F.col(frame) - F.col("start_frame") + F.col("_copy"), "is_pad": F.col("_copy") > 0}
    ).drop("_copy", "_zero")
