"""Power spectrum of equal-length windows held as arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def powers(x: np.ndarray) -> np.ndarray:
    """Squared magnitude of the real Fourier transform of each mean-removed row."""
    power = np.abs(np.fft.rfft(x - x.mean(axis=1, keepdims=True), axis=1)) ** 2
    # Rounding noise of a constant window is not power.
    noise = 8 * x.shape[1] * np.finfo(float).eps * np.abs(x).max(axis=1, keepdims=True)
    return np.where(power > noise**2, power, 0.0)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def power_spectrum(values: pd.Series) -> pd.Series:
    """Squared magnitude of the real Fourier transform of each mean-removed array."""
    lengths = values.map(len)
    out = pd.Series([None] * len(values), index=values.index, dtype=object)
    for n, group in values.groupby(lengths):
        if n < 2:
            spectra = [[] for _ in range(len(group))]
        else:
            spectra = list(powers(np.stack(group.to_list()).astype(float)))
        out.loc[group.index] = pd.Series(spectra, index=group.index, dtype=object)
    return out


def spectral_columns(power: str, n_samples: Column, rate_hz: float) -> dict[str, Column]:
    """Dominant frequency, energy and entropy from a power array (element 0 is the mean, skipped)."""
    bins = F.slice(F.col(power), 2, F.greatest(F.size(power) - 1, F.lit(0)))
    total = F.aggregate(bins, F.lit(0.0), lambda a, p: a + p)
    # A lambda works out again, for each element, whatever it takes from outside; so the sum and the top enter as
    # variables of a lambda of their own. The first of the highest bins: those that differ by rounding alone are equal.
    top = F.array_max(bins) * (1 - 1e-9)
    peak = F.transform(F.array(top), lambda t: F.array_position(F.transform(bins, lambda p: p >= t), True))[0]
    entropy = F.transform(
        F.array(total),
        lambda t: F.aggregate(bins, F.lit(0.0), lambda a, p: a - (p / t) * F.log2(p / t + F.lit(1e-12))),
    )[0]
    return {
        "dominant_freq_hz": F.when(total > 0, peak * F.lit(float(rate_hz)) / n_samples).otherwise(0.0),
        "spectral_energy": total,
        "spectral_entropy": F.when(total > 0, entropy).otherwise(0.0),
    }
