"""Filter design and application to one chunk of samples, in numpy."""

from __future__ import annotations

from fractions import Fraction

import numpy as np


def butter_bandpass(order: int, low_hz: float, high_hz: float, rate_hz: float) -> tuple[np.ndarray, np.ndarray]:
    """Digital Butterworth band-pass: numerator and denominator of length 2*order+1."""
    if high_hz >= rate_hz / 2:
        raise ValueError(f"high_hz={high_hz} must be below half the sample rate {rate_hz}")
    # Analogue band edges matched to the digital ones, in units of 2*rate.
    lo, hi = np.tan(np.pi * low_hz / rate_hz), np.tan(np.pi * high_hz / rate_hz)
    width, centre2 = hi - lo, lo * hi
    angles = np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order)
    half = np.exp(1j * angles) * width / 2
    root = np.sqrt(half**2 - centre2)
    poles = np.concatenate([half + root, half - root])
    digital = (1 + poles) / (1 - poles)
    a = np.real(np.poly(digital))
    b = np.real(np.poly(np.r_[np.ones(order), -np.ones(order)]))
    centre = np.exp(2j * np.arctan(np.sqrt(centre2)))
    gain = np.abs(np.polyval(a, centre) / np.polyval(b, centre))
    return b * gain, a


def settling_length(order: int, low_hz: float, high_hz: float, rate_hz: float) -> int:
    """Samples after which the filter has forgotten its past to double precision."""
    _, a = butter_bandpass(order, low_hz, high_hz, rate_hz)
    radius = np.abs(np.roots(a)).max()
    # Poles come in close groups, which decay slower than one pole alone: allow half as much again.
    return int(np.ceil(1.5 * np.log(1e-18) / np.log(radius)))


def steady_state(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Filter state at which a constant input of 1 gives a constant output."""
    n = len(a) - 1
    companion = np.zeros((n, n))
    companion[0] = -a[1:] / a[0]
    companion[1:, :-1] = np.eye(n - 1)
    return np.linalg.solve(np.eye(n) - companion.T, b[1:] - a[1:] * b[0])


def responses(order: int, low_hz: float, high_hz: float, rate_hz: float) -> tuple[np.ndarray, np.ndarray]:
    """Response to an impulse from rest, and to silence from the steady state, until settled."""
    b, a = butter_bandpass(order, low_hz, high_hz, rate_hz)
    n = settling_length(order, low_hz, high_hz, rate_hz)
    states = np.stack([np.zeros(len(a) - 1), steady_state(b, a)])
    drive = np.zeros((n, 2))
    drive[0, 0] = 1.0
    out = np.empty((n, 2))
    for i in range(n):
        y = b[0] * drive[i] + states[:, 0]
        shifted = np.hstack([states[:, 1:], np.zeros((2, 1))])
        states = shifted + np.outer(drive[i], b[1:]) - np.outer(y, a[1:])
        out[i] = y
    return out[:, 0], out[:, 1]


def _one_way(x: np.ndarray, impulse: np.ndarray, settle: np.ndarray) -> np.ndarray:
    """Filter along axis 0, starting from the steady state of the first sample."""
    n = len(x)
    size = 1 << int(np.ceil(np.log2(n + len(impulse))))
    spectrum = np.fft.rfft(x, size, axis=0) * np.fft.rfft(impulse, size)[:, None]
    y = np.fft.irfft(spectrum, size, axis=0)[:n]
    m = min(n, len(settle))
    y[:m] += settle[:m, None] * x[0]
    return y


def edge_length(order: int) -> int:
    """Samples mirrored at either end of a series."""
    return 3 * (2 * order + 1)


def zero_phase(x: np.ndarray, impulse: np.ndarray, settle: np.ndarray, pad: int) -> np.ndarray:
    """Filter forwards and backwards along axis 0, with odd extension by ``pad`` at both ends."""
    if len(x) <= pad:
        raise ValueError(f"a series needs more than {pad} samples to be filtered, got {len(x)}")
    extended = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    forward = _one_way(extended, impulse, settle)
    backward = _one_way(forward[::-1], impulse, settle)[::-1]
    return backward[pad:-pad]


def resample_ratio(native_hz: float, target_hz: float) -> tuple[int, int]:
    """Up and down factors; only going down is allowed."""
    if target_hz > native_hz:
        raise ValueError(f"can only resample downwards, not from {native_hz} to {target_hz} Hz")
    ratio = Fraction(target_hz / native_hz).limit_denominator(1000)
    return ratio.numerator, ratio.denominator


def resample_taps(up: int, down: int) -> np.ndarray:
    """Anti-alias low-pass: windowed sinc, Kaiser beta 5, ten zero crossings a side, gain ``up``."""
    widest = max(up, down)
    half = 10 * widest
    k = np.arange(-half, half + 1)
    taps = np.sinc(k / widest) / widest * np.kaiser(2 * half + 1, 5.0)
    return up * taps / taps.sum()


def resample_at(
    x: np.ndarray, first: int, outputs: np.ndarray, up: int, down: int, taps: np.ndarray
) -> np.ndarray:
    """Resampled values at positions ``outputs``, from samples ``first``, ``first+1``, ... in rows.

    Samples outside the given ones count as zero.
    """
    half = (len(taps) - 1) // 2
    reach = half // up + 1
    padded = np.pad(x, ((reach, reach + 1), (0, 0)))
    offsets = np.arange(-reach, reach + 1)
    centre = outputs * down // up
    phase = outputs[:, None] * down - (centre[:, None] + offsets) * up
    inside = np.abs(phase) <= half
    weights = np.where(inside, taps[np.clip(phase + half, 0, len(taps) - 1)], 0.0)
    rows = np.clip(centre[:, None] + offsets - first + reach, 0, len(padded) - 1)
    out = np.empty((len(outputs), x.shape[1]))
    for low in range(0, len(outputs), 4096):
        part = slice(low, low + 4096)
        out[part] = np.einsum("mk,mkc->mc", weights[part], padded[rows[part]])
    return out
