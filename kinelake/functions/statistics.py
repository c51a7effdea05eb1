"""Features of windows held as arrays of samples, many windows at a time."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinelake.functions.channels import ACCEL, CHANNELS, GYRO
from kinelake.functions.spectrum import powers

#: Windows that are worked on at once.
WINDOWS_AT_ONCE = 512


def _stats(x: np.ndarray, ok: np.ndarray) -> dict[str, np.ndarray]:
    """Statistics per row of the values that are there. As in Spark, NaN is the largest number."""
    n = ok.sum(axis=1)
    with np.errstate(all="ignore"):
        kept = np.where(ok, x, 0.0)
        mean = kept.sum(axis=1) / n
        apart = np.where(ok, x - mean[:, None], 0.0)
        low = np.where(ok & ~np.isnan(x), x, np.inf).min(axis=1)
        low = np.where((ok & ~np.isnan(x)).any(axis=1), low, np.nan)
        high = np.where(ok, x, -np.inf).max(axis=1)
        spread, rms = np.sqrt((apart * apart).sum(axis=1) / n), np.sqrt((kept * kept).sum(axis=1) / n)
        return {"mean": mean, "std": spread, "min": low, "max": high, "range": high - low, "rms": rms}


def _spectral(x: np.ndarray, rate_hz: float) -> list[np.ndarray]:
    """Dominant frequency, energy and entropy of windows of one size; see ``spectrum.spectral_columns``."""
    bins = powers(x)[:, 1:]
    if not bins.shape[1]:
        return [np.zeros(len(x))] * 3
    total = bins.sum(axis=1)
    some = total > 0
    peak = (bins >= bins.max(axis=1, keepdims=True) * (1 - 1e-9)).argmax(axis=1) + 1
    share = bins / np.where(some, total, 1.0)[:, None]
    entropy = -(share * np.log2(share + 1e-12)).sum(axis=1)
    return [np.where(some, peak * rate_hz / x.shape[1], 0.0), total, np.where(some, entropy, 0.0)]


def _features(frame: np.ndarray, values: dict, there: dict, start, size, total, before, length: int, rate_hz: float) -> tuple[dict, dict]:
    """Values of each feature, and where there are any; a row of ``frame`` and of each channel is a window."""
    place = np.arange(frame.shape[1])
    kept = place < total[:, None]
    found, known = {}, {}

    def add(name: str, x: np.ndarray, ok: np.ndarray, which: Sequence[str]) -> None:
        stats, some = _stats(x, ok), ok.any(axis=1)
        found.update({f"{name}_{k}": stats[k] for k in which})
        known.update({f"{name}_{k}": some for k in which})

    every = ["mean", "std", "min", "max", "range", "rms"]
    for c in CHANNELS:
        add(c, values[c], there[c] & kept, every)
    (x, y, z), (u, v, w) = ([values[c] for c in group] for group in (ACCEL, GYRO))
    whole = kept & there[ACCEL[0]] & there[ACCEL[1]] & there[ACCEL[2]]
    mag = np.sqrt(x * x + y * y + z * z)
    add("accel_mag", mag, whole, every)
    add("gyro_mag", np.sqrt(u * u + v * v + w * w), kept & there[GYRO[0]] & there[GYRO[1]] & there[GYRO[2]], ["mean", "std", "max"])
    step = np.empty_like(mag)
    step[:, 0], step[:, 1:] = mag[:, 0] - before, mag[:, 1:] - mag[:, :-1]
    both = whole.copy()
    both[:, 0] &= ~np.isnan(before)
    both[:, 1:] &= whole[:, :-1]
    jerk = np.where(both & (place < size[:, None]) & (frame > start[:, None]), np.abs(step) * rate_hz, 0.0)
    found["jerk_mean_abs"], found["jerk_max_abs"] = jerk.sum(axis=1) / max(length - 1, 1), jerk.max(axis=1)
    cosine = z / np.where(mag == 0, 1e-8, mag)
    with np.errstate(invalid="ignore"):
        tilt = np.degrees(np.arccos(np.where(np.isnan(cosine), 1.0, np.clip(cosine, -1.0, 1.0))))
    add("tilt", tilt, kept, ["mean", "std", "range"])  # a sample without a value lies level, as for ``tilt_degrees``
    found["sma"] = np.where(whole, np.abs(x) + np.abs(y) + np.abs(z), 0.0).sum(axis=1) / np.maximum(whole.sum(axis=1), 1)
    known["sma"] = whole.any(axis=1)
    spectral = np.zeros((3, len(mag)))
    for n in np.unique(total):
        at = total == n
        spectral[:, at] = _spectral(np.where(whole, mag, np.nan)[at, :n], rate_hz)
    found.update(zip(["dominant_freq_hz", "spectral_energy", "spectral_entropy"], spectral))
    return found, known


def window_values(names: Sequence[str], length: int, rate_hz: float):
    """A function of columns (samples, start, total, before) to a struct of the features ``names``.

    ``samples`` is an array, not empty, of structs of ``_frame`` and the channels, in order; the last one counts as often as it
    takes to have ``total``. ``before`` is the magnitude of the sample before the first one, for a window that does
    not begin at its frame ``start``. A missing value is left out of what is made from it.
    """

    @F.arrow_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in names]))
    def found(samples: pa.Array, start: pa.Array, total: pa.Array, before: pa.Array) -> pa.Array:
        flat = samples.flatten()
        frames = flat.field("_frame").to_numpy(zero_copy_only=False)
        channels = {c: flat.field(c).cast(pa.float64()) for c in CHANNELS}
        there = {c: v.is_valid().to_numpy(zero_copy_only=False) for c, v in channels.items()}
        values = {c: v.to_numpy(zero_copy_only=False) for c, v in channels.items()}
        size = samples.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(size) - size
        start, total = (a.to_numpy(zero_copy_only=False).astype(np.int64) for a in (start, total))
        before = before.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)
        parts = []
        for i in range(0, len(size), WINDOWS_AT_ONCE):
            lot = slice(i, i + WINDOWS_AT_ONCE)
            place = np.minimum(np.arange(total[lot].max()), size[lot, None] - 1)
            at = first[lot, None] + place
            got, known = _features(
                frames[at], {c: v[at] for c, v in values.items()}, {c: v[at] for c, v in there.items()},
                start[lot], size[lot], total[lot], before[lot], length, rate_hz,
            )
            columns = [pa.array(got[n], pa.float64(), mask=~known[n] if n in known else None) for n in names]
            parts.append(pa.StructArray.from_arrays(columns, names=list(names)))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([(n, pa.float64()) for n in names]))

    return found
