"""Resampling and zero-phase filtering of series, block by block.

Both need neighbouring samples, so a block is sent with context: the filter's reach for
resampling, its settling time for the band-pass. Beyond that the past has no effect in double
precision, so a long series filtered in blocks equals the same series filtered whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinelake.functions import filters
from kinelake.functions.groups import whole_groups
from kinelake.operators.blocks import BLOCK_FRAMES, with_blocks


def _schema(df: DataFrame, keys: Sequence[str], frame: str, doubles: Sequence[str]) -> T.StructType:
    fields = [df.schema[k] for k in keys] + [T.StructField(frame, T.LongType())]
    return T.StructType(fields + [T.StructField(c, T.DoubleType()) for c in doubles])


def resample(
    samples: DataFrame,
    keys: Sequence[str],
    channels: Sequence[str],
    native_hz: float,
    target_hz: float,
    time: str = "time_s",
    frame: str = "frame",
    size: int = BLOCK_FRAMES,
) -> DataFrame:
    """Resample every series down to ``target_hz`` with anti-aliasing.

    The output has round-half-even(n * target / native) frames and times t0 + i / target.
    Equal rates return the samples as they are.
    """
    keys, channels = list(keys), list(channels)
    if native_hz == target_hz:
        return samples
    up, down = filters.resample_ratio(native_hz, target_hz)
    reach = 10 * max(up, down) // up + 2
    taps = filters.resample_taps(up, down)
    columns = [*channels, time]
    schema = _schema(samples, keys, frame, columns)

    def some_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, groups in whole_groups(batches, [*keys, "block"]):
            frames, times = pdf[frame].to_numpy(), pdf[time].to_numpy(float)
            block, core, signal = pdf["block"].to_numpy(), pdf["core"].to_numpy(), pdf[channels].to_numpy(float)
            numbers, values, clock, origin = [], [], [], []
            for i, j in groups:
                if not core[i:j].any():
                    continue  # context past the end of the series
                low = int(block[i]) * size
                high = low + size
                last = int(frames[j - 1])
                # Within reach of its end, the length of the series is known.
                ends_here = last < high + reach - 1
                stop = round((last + 1) * up / down) if ends_here else -(-high * up // down)
                outputs = np.arange(-(-low * up // down), min(-(-high * up // down), stop))
                numbers.append(outputs)
                values.append(filters.resample_at(signal[i:j], int(frames[i]), outputs, up, down, taps))
                clock.append(times[i] - frames[i] / native_hz + outputs / target_hz)
                origin.append(np.full(len(outputs), i))
            if numbers:
                out = pdf[keys].iloc[np.concatenate(origin)].reset_index(drop=True)
                out[frame] = np.concatenate(numbers)
                out[channels] = np.concatenate(values)
                out[time] = np.concatenate(clock)
                yield out[schema.names]

    blocked = with_blocks(samples.select(*keys, frame, *columns), frame, reach, reach, size)
    return _in_order(blocked, keys, frame).mapInPandas(some_blocks, schema)


def bandpass(
    samples: DataFrame,
    keys: Sequence[str],
    channels: Sequence[str],
    rate_hz: float,
    low: float = 0.5,
    high: float = 20.0,
    order: int = 4,
    frame: str = "frame",
    size: int = BLOCK_FRAMES,
) -> DataFrame:
    """Zero-phase Butterworth band-pass of ``channels``; other columns pass through.

    A series too short to be mirrored at its ends (27 samples at order 4) gets missing channels, so that
    validation quarantines it and the others go on.
    """
    impulse, settle = filters.responses(order, low, high, rate_hz)
    pad = filters.edge_length(order)
    keys, channels = list(keys), list(channels)
    context = len(impulse) + pad
    floats = [T.StructField(c, T.DoubleType()) if c in channels else samples.schema[c] for c in samples.columns]
    schema = T.StructType(floats)

    def some_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, groups in whole_groups(batches, [*keys, "block"]):
            core, signal = pdf["core"].to_numpy(), pdf[channels].to_numpy(float)
            for i, j in groups:
                if j - i <= pad:
                    signal[i:j] = np.nan
                elif core[i:j].any():  # else context past the end of the series
                    signal[i:j] = filters.zero_phase(signal[i:j], impulse, settle, pad)
            out = pdf.loc[core, schema.names]
            yield out.assign(**{c: signal[core, k] for k, c in enumerate(channels)})

    return _in_order(with_blocks(samples, frame, context, context, size), keys, frame).mapInPandas(some_blocks, schema)


def _in_order(blocked: DataFrame, keys: Sequence[str], frame: str) -> DataFrame:
    """Blocks whole in one partition each and in order: many short series share a task and its batches."""
    return blocked.repartition(*keys, "block").sortWithinPartitions(*keys, "block", frame)


def shift_time(df: DataFrame, rate_hz: float, frame: str = "frame", time: str = "time_s") -> DataFrame:
    """A time axis from the frame number."""
    return df.withColumn(time, F.col(frame) / F.lit(float(rate_hz)))
