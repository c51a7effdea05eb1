"""Window features and per-sample auxiliary channels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinelake.functions.channels import (
    ACCEL,
    AUX_CHANNELS,
    CHANNELS,
    accel_magnitude,
    gyro_magnitude,
    tilt_degrees,
)
from kinelake.functions.spectrum import power_spectrum, spectral_columns
from kinelake.functions.statistics import window_values
from kinelake.operators.blocks import BLOCK_FRAMES, join_series, with_blocks
from kinelake.operators.windows import assign_windows, full_windows, last_full_end, real_windows

# Frames packed into one array when windows are cut from blocks.
SLICE_FRAMES = 4096

# Statistics per channel and feature names, in output order.
CHANNEL_STATS = ["mean", "std", "min", "max", "range", "rms"]
FEATURE_NAMES = (
    [f"{c}_{s}" for c in CHANNELS for s in CHANNEL_STATS]
    + [f"accel_mag_{s}" for s in CHANNEL_STATS]
    + ["gyro_mag_mean", "gyro_mag_std", "gyro_mag_max"]
    + ["jerk_mean_abs", "jerk_max_abs"]
    + ["tilt_mean", "tilt_std", "tilt_range"]
    + ["sma"]
    + ["dominant_freq_hz", "spectral_energy", "spectral_entropy"]
)


def channel_stats(column: str) -> dict[str, Column]:
    x = F.col(column)
    return {
        f"{column}_mean": F.avg(x),
        f"{column}_std": F.stddev_pop(x),
        f"{column}_min": F.min(x),
        f"{column}_max": F.max(x),
        f"{column}_range": F.max(x) - F.min(x),
        f"{column}_rms": F.sqrt(F.avg(x * x)),
    }


def _windowed(
    samples: DataFrame,
    series: DataFrame,
    keys: Sequence[str],
    length: int,
    stride: int,
    frame: str,
    n_frames: str,
    size: int,
) -> DataFrame:
    """Samples with derived channels and difference to the previous sample, sent to windows.

    The difference is taken once per series; whether a window uses it depends only on the
    sample's place in that window, so no window needs its rows in order.
    """
    derived = samples.withColumns({"accel_mag": accel_magnitude(), "gyro_mag": gyro_magnitude()})
    derived = derived.withColumn("tilt", tilt_degrees(F.col("accel_mag")))
    blocked = with_blocks(derived, frame, before=1, size=size)
    ordered = W.partitionBy(*keys, "block").orderBy(frame)
    stepped = blocked.withColumn("_step", F.col("accel_mag") - F.lag("accel_mag").over(ordered))
    core = stepped.filter("core").drop("core")
    core = join_series(core, series.select(*keys, n_frames), keys, n_frames, size)
    return assign_windows(core, n_frames, length, stride, frame)


def time_features(
    samples: DataFrame,
    series: DataFrame,
    keys: Sequence[str],
    length: int,
    stride: int,
    rate_hz: float = 100.0,
    frame: str = "frame",
    n_frames: str = "n_frames",
    size: int = BLOCK_FRAMES,
) -> DataFrame:
    """The 51 time-domain features of every window.

    ``series`` has one row per series with its number of samples. Blocks arrive sorted by frame,
    so the map side already folds each window's samples into a few rows before the shuffle.
    """
    rows = _windowed(samples, series, keys, length, stride, frame, n_frames, size)
    return _time_aggregates(rows, keys, length, rate_hz)


def _time_aggregates(
    rows: DataFrame, keys: Sequence[str], length: int, rate_hz: float, window: Sequence[str] = ("window_index",)
) -> DataFrame:
    counted = F.when(~F.col("is_pad") & (F.col("offset") > 0), F.abs("_step") * rate_hz)
    jerk = F.coalesce(counted, F.lit(0.0))
    stats: dict[str, Column] = {}
    for channel in CHANNELS + ["accel_mag"]:
        stats |= channel_stats(channel)
    gyro = channel_stats("gyro_mag")
    stats |= {k: gyro[k] for k in ("gyro_mag_mean", "gyro_mag_std", "gyro_mag_max")}
    stats["jerk_mean_abs"] = F.sum(jerk) / max(length - 1, 1)
    stats["jerk_max_abs"] = F.max(jerk)
    tilt = channel_stats("tilt")
    stats |= {k: tilt[k] for k in ("tilt_mean", "tilt_std", "tilt_range")}
    stats["sma"] = F.avg(sum((F.abs(c) for c in ACCEL), F.lit(0.0)))
    return rows.groupBy(*keys, *window).agg(*[c.alias(name) for name, c in stats.items()])


def window_arrays(rows: DataFrame, keys: Sequence[str], values: Sequence[str], order: str = "offset") -> DataFrame:
    """One row per window with each value column as an array in sample order."""
    packed = F.array_sort(F.collect_list(F.struct(order, *values)))
    grouped = rows.groupBy(*keys).agg(packed.alias("_samples"))
    return grouped.select(*keys, *[F.col(f"_samples.{v}").alias(v) for v in values])


def block_windows(n: Column, block: Column, length: int, stride: int, size: int) -> tuple[Column, Column]:
    """Numbers of the windows that start in a block, and the place there of the one in ``window_index``."""
    full, end = full_windows(n, length, stride), last_full_end(n, length, stride)
    low = F.ceil(block * size / stride)
    high = F.least(full - 1, F.floor(((block + 1) * size - 1) / stride))
    nothing = F.array().cast("array<bigint>")
    on_grid = F.when(low <= high, F.sequence(low, high)).otherwise(nothing)
    tail = (n > length) & (end < n) & (F.floor(end / size) == block)
    numbered = F.concat(on_grid, F.when(tail, F.array(full)).otherwise(nothing))
    index = F.col("window_index")
    return numbered, (F.when(index < full, index * stride).otherwise(end) - block * size).cast("int")


def slice_windows(
    blocked: DataFrame,
    series: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    length: int,
    stride: int,
    frame: str = "frame",
    n_frames: str = "n_frames",
    size: int = SLICE_FRAMES,
    single: Mapping[str, int] | None = None,
) -> DataFrame:
    """One row per window with the real samples of each value column as an array.

    ``single`` names columns of which only the sample at one offset is wanted.

    Each block is packed into arrays once and every window that starts in it is cut from them, so
    overlapping windows cost no extra shuffle. ``blocked`` needs ``length - 1`` frames of context
    after each block; context before it is left out.
    """
    keys = list(keys)
    inside = blocked.filter(F.col(frame) >= F.col("block") * size)
    single = single or {}
    every = [*values, *single]
    packed = F.array_sort(F.collect_list(F.struct(frame, *every))).alias("_samples")
    arrays = inside.groupBy(*keys, "block").agg(packed)
    joined = join_series(arrays, series.select(*keys, n_frames), keys, n_frames, size)
    numbered, first = block_windows(F.col(n_frames), F.col("block"), length, stride, size)
    windows = joined.withColumn("window_index", F.explode(numbered))
    # Columns are taken from what is cut: taken before, generated code takes them from the whole block per window.
    cut = F.slice("_samples", first + 1, F.lit(length)).alias("_cut")
    ends = {v: F.get("_samples", first + offset)[v] for v, offset in single.items()}
    windows = windows.select(*keys, "window_index", cut, *[c.alias(v) for v, c in ends.items()])
    return windows.select(*keys, "window_index", *[F.col(f"_cut.{v}").alias(v) for v in values], *single)


def padded(column: str, length: int, fill: Column | None = None) -> Column:
    """An array filled up to ``length`` with its last element (or ``fill``)."""
    value = F.col(column)
    last = F.element_at(value, -1) if fill is None else fill
    filled = F.concat(value, F.array_repeat(last, F.lit(length) - F.size(value)))
    return F.when(F.size(value) == length, value).otherwise(filled)


def spectral_features(
    windows: DataFrame, keys: Sequence[str], value: str, rate_hz: float = 100.0
) -> DataFrame:
    """Spectral features of windows given as arrays."""
    spectra = windows.select(
        *keys, F.size(value).alias("_n"), power_spectrum(F.col(value)).alias("_power")
    )
    return spectra.select(
        *keys, *[c.alias(n) for n, c in spectral_columns("_power", F.col("_n"), rate_hz).items()]
    )


def spectrum_bins(windows: DataFrame, keys: Sequence[str], value: str, rate_hz: float = 100.0) -> DataFrame:
    """The power spectrum as rows: bin, frequency, power."""
    spectra = windows.select(
        *keys, F.size(value).alias("_n"), power_spectrum(F.col(value)).alias("_power")
    )
    rows = spectra.select(*keys, "_n", F.posexplode("_power").alias("bin", "power"))
    return rows.withColumn("freq_hz", F.col("bin") * F.lit(float(rate_hz)) / F.col("_n")).drop("_n")


def window_features(
    samples: DataFrame,
    series: DataFrame,
    keys: Sequence[str],
    length: int,
    stride: int,
    rate_hz: float = 100.0,
    frame: str = "frame",
    n_frames: str = "n_frames",
    size: int = BLOCK_FRAMES,
) -> DataFrame:
    """All 54 features of every window of every series.

    Each window is cut from the block of samples it starts in and its features are found there, so samples are numbered
    and sent once, for time features and spectra alike.
    """
    keys, slices = list(keys), min(size, SLICE_FRAMES)
    blocked = with_blocks(samples.select(*keys, frame, *CHANNELS), frame, after=length - 1, size=slices)
    inside = blocked.filter(F.col(frame) >= F.col("block") * slices)
    joined = join_series(packed_blocks(inside, [*keys, "block"], frame), series.select(*keys, n_frames), keys, n_frames, slices)
    numbered, first = block_windows(F.col(n_frames), F.col("block"), length, stride, slices)
    windows = joined.withColumn("window_index", F.explode(numbered)).withColumn("_first", first)
    cut = F.slice("_samples", F.col("_first") + 1, F.lit(length))
    start = F.col("block") * slices + F.col("_first")
    return _cut_features(windows, [*keys, "window_index"], cut, start, F.lit(length), F.lit(None), length, rate_hz)


def packed_blocks(blocked: DataFrame, part: Sequence[str], frame: str) -> DataFrame:
    """One row per block with its samples as an array in the order of their frames."""
    each = F.struct(F.col(frame).alias("_frame"), *CHANNELS)
    sent = blocked.select(*part, each.alias("_each")).repartition(*[F.col(c) for c in part])
    return sent.groupBy(*part).agg(F.array_sort(F.collect_list("_each")).alias("_samples"))


def _cut_features(windows: DataFrame, ids: Sequence[str], cut: Column, start: Column, total: Column, before: Column, length: int, rate_hz: float) -> DataFrame:
    """Features of windows cut from the blocks beside them; windows without samples are left out."""
    one = F.struct(cut.alias("_cut"), start.cast("long").alias("_start"), before.cast("double").alias("_before"))
    # What is exploded is worked out there; as a plain column it would be cut again, from the block, by all that use it.
    rows = windows.select(*ids, F.explode(F.array(one)).alias("_one")).select(*ids, "_one.*", total.cast("int").alias("_total"))
    rows = rows.filter(F.size("_cut") > 0)
    values = window_values(FEATURE_NAMES, length, rate_hz)
    found = rows.select(*ids, values("_cut", "_start", "_total", "_before").alias("_values"))
    return found.select(*ids, "_values.*")


def features_batch(
    windows: DataFrame,
    samples: DataFrame,
    trial_keys: Sequence[str],
    length: int,
    rate_hz: float = 100.0,
    frame: str = "frame",
) -> DataFrame:
    """Features for the windows of a windows manifest, with label and ids carried along.

    Samples are packed into arrays by (trial, block of ``SLICE_FRAMES``), with one window of context; each window is cut
    from the block it starts in and its features are found there, so samples go through one shuffle and windows through one.
    """
    keys, size = list(trial_keys), SLICE_FRAMES
    part = [*keys, "block"]
    wanted = [c for c in ("label", "dataset", "subject_id", "global_subject_id", "activity_code", "trial_id") if c in windows.columns]
    carried = [c for c in wanted if c not in keys]
    blocked = with_blocks(samples.select(*keys, frame, *CHANNELS), frame, before=1, after=length - 1, size=size)
    packed = packed_blocks(blocked, part, frame)
    start, end = F.col("start_frame"), F.col("end_frame")
    slim = real_windows(windows).select(*keys, "window_index", start, end, *carried)
    slim = slim.withColumn("block", F.floor(F.greatest(start, F.lit(0)) / size))
    cut = cut_frames("_samples", start, F.least(end, start + length))
    ids = [*part, "window_index", *carried]
    last = F.try_element_at("_cut", F.lit(-1))
    pads = F.when(last["_frame"] == F.col("_end") - 1, F.greatest(F.lit(length) - (F.col("_end") - F.col("_start")), F.lit(0))).otherwise(0)
    rows = packed.join(slim, part).withColumn("_end", end)
    found = _cut_features(rows, [*ids, "_end"], cut, start, F.size("_cut") + pads, magnitude_before("_samples", start), length, rate_hz)
    return found.select(*FEATURE_NAMES, *dict.fromkeys([*wanted, *keys, "window_index"]))


def without_gaps(rows: Column) -> Column:
    """Whether the frames of an array of samples, in order, follow each other."""
    return F.element_at(rows, -1)["_frame"] - rows[0]["_frame"] + 1 == F.size(rows)


def magnitude_before(packed: str, start: Column) -> Column:
    """Magnitude of acceleration of the last sample before ``start``. Without gaps it is null: no window has a use for it."""
    rows = F.col(packed)
    last = F.try_element_at(F.filter(rows, lambda s: s["_frame"] < start), F.lit(-1))
    return F.when(~without_gaps(rows), F.sqrt(sum((last[c] * last[c] for c in ACCEL[1:]), last[ACCEL[0]] * last[ACCEL[0]])))


def cut_frames(packed: str, start: Column, end: Column) -> Column:
    """Those elements of an array, ordered by their field ``_frame``, with frames in [start, end)."""
    rows = F.col(packed)
    first, last = rows[0]["_frame"], F.element_at(rows, -1)["_frame"]
    low = F.greatest(start, first)
    count = F.greatest(F.least(end, last + 1) - low, F.lit(0))
    whole = F.slice(rows, F.least(low - first, F.size(rows)).cast("int") + 1, count.cast("int"))
    some = F.filter(rows, lambda s: (s["_frame"] >= start) & (s["_frame"] < end))
    return F.when(without_gaps(rows), whole).otherwise(some)  # frames without gaps need no search


def array_features(windows: DataFrame, keys: Sequence[str], length: int, rate_hz: float = 100.0) -> DataFrame:
    """All 54 features of windows given as rows of six channel arrays, e.g. one live window or a stored tensor.

    Arrays of a row have one size, 1 to ``length`` samples; shorter ones are filled up with their last sample.
    ``keys`` name a window. Its samples lie in one row until they fold, so one row of each goes to the shuffle.
    """
    ids = list(keys)
    size = F.size(CHANNELS[0])
    even = F.lit(True)
    for c in CHANNELS:
        even = even & (F.size(c) == size)
    wrong = F.raise_error(F.lit(f"a window needs six arrays of one size, 1 to {length} samples"))
    checked = F.when(even & size.between(1, length), F.col(CHANNELS[0])).otherwise(wrong.cast("array<double>"))
    filled = windows.select(*ids, checked.alias(CHANNELS[0]), *CHANNELS[1:])
    filled = filled.select(*ids, *[padded(c, length).alias(c) for c in CHANNELS])
    squares = F.arrays_zip(*ACCEL)
    mags = F.transform(squares, lambda s: F.sqrt(sum((s[a] * s[a] for a in ACCEL), F.lit(0.0))))
    filled = filled.withColumn("accel_mag", mags)
    spectral = spectral_columns("_power", F.lit(length), rate_hz)
    filled = filled.withColumn("_power", power_spectrum(F.col("accel_mag"))).withColumns(spectral)
    before = F.concat(F.slice("accel_mag", 1, 1), F.slice("accel_mag", 1, length - 1))
    zipped = F.arrays_zip(*CHANNELS, "accel_mag", before.alias("_before"))
    rows = filled.select(*ids, *spectral, F.posexplode(zipped).alias("offset", "_s")).select(*ids, *spectral, "offset", "_s.*")
    rows = rows.withColumns(
        {
            "gyro_mag": gyro_magnitude(),
            "tilt": tilt_degrees(F.col("accel_mag")),
            "_step": F.col("accel_mag") - F.col("_before"),
            "is_pad": F.lit(False),
        }
    )
    return _time_aggregates(rows, ids, length, rate_hz, list(spectral)).select(*ids, *FEATURE_NAMES)


def auxiliary_channels(
    rows: DataFrame, keys: Sequence[str], length: int, rate_hz: float = 100.0
) -> DataFrame:
    """Magnitude, jerk and tilt of every sample of materialised windows, same length as the window.

    Jerk is the central difference inside the window and one-sided at its two ends.
    """
    if length < 2:
        raise ValueError("a derivative needs windows of at least 2 samples")
    magnitude = rows.withColumn("accel_mag", accel_magnitude())
    ordered = W.partitionBy(*keys).orderBy("offset")
    m, before, after = F.col("accel_mag"), F.lag("accel_mag").over(ordered), F.lead("accel_mag").over(ordered)
    slope = (
        F.when(F.col("offset") == 0, after - m)
        .when(F.col("offset") == length - 1, m - before)
        .otherwise((after - before) / 2)
    )
    return magnitude.withColumns(
        {"jerk": slope * rate_hz, "tilt_deviation_deg": tilt_degrees(F.col("accel_mag"))}
    )


def augmented_windows(
    samples: DataFrame,
    series: DataFrame,
    keys: Sequence[str],
    length: int,
    stride: int,
    rate_hz: float = 100.0,
    frame: str = "frame",
    n_frames: str = "n_frames",
    size: int = SLICE_FRAMES,
) -> DataFrame:
    """One row per window with nine channel arrays, padded to ``length``.

    Magnitude, tilt and the steps to both neighbours are found once per sample of the series.
    Only the two ends of a window differ from that, so windows that overlap heavily are cut from
    the packed blocks and patched there.
    """
    if length < 2:
        raise ValueError("a derivative needs windows of at least 2 samples")
    derived = samples.select(*keys, frame, *CHANNELS, accel_magnitude().alias("accel_mag"))
    derived = derived.withColumn("tilt_deviation_deg", tilt_degrees(F.col("accel_mag")))
    blocked = with_blocks(derived, frame, before=1, after=length, size=size)
    ordered = W.partitionBy(*keys, "block").orderBy(frame)
    m = F.col("accel_mag")
    stepped = blocked.withColumns(
        {
            "_back": F.coalesce(m - F.lag("accel_mag").over(ordered), F.lit(0.0)) * rate_hz,
            "_ahead": F.coalesce(F.lead("accel_mag").over(ordered) - m, F.lit(0.0)) * rate_hz,
        }
    )
    stepped = stepped.filter(F.col(frame) < (F.col("block") + 1) * size + length - 1)
    stepped = stepped.withColumn("_middle", (F.col("_back") + F.col("_ahead")) / 2)
    plain = [*CHANNELS, "accel_mag", "tilt_deviation_deg"]
    ends = {"_ahead": 0, "_back": length - 1}
    cut = slice_windows(stepped, series, keys, [*plain, "_middle"], length, stride, frame, n_frames, size, ends)
    real = F.size("accel_mag")
    # Padding repeats the last sample: no slope on it, and none ahead of the last real one.
    head = F.array("_ahead")
    whole = F.concat(head, F.slice("_middle", 2, length - 2), F.array("_back"))
    short = F.concat(head, F.slice("_middle", F.lit(2), real - 1), F.array_repeat(F.lit(0.0), F.lit(length) - real))
    cut = cut.withColumn("jerk", F.when(real == length, whole).otherwise(short))
    filled = {c: padded(c, length) for c in plain}
    columns = [filled[c].alias(c) if c in filled else F.col(c) for c in [*CHANNELS, *AUX_CHANNELS]]
    return cut.select(*keys, "window_index", *columns)
