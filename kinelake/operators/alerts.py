"""Alert states from window probabilities: smoothing, hysteresis and a latch after a fall.

The state after a row depends on all rows before it. Within a block the rows are folded in order.
A series longer than one block is folded in two rounds: each block first reports, for every state
it could start in, the state it ends in; these short tables are chained along the series; then
every block is folded from its true start. The moving average needs no chaining, since a few
hundred rows of context determine it to double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinelake.operators.blocks import BLOCK_FRAMES, with_blocks

# Names of the alert states.
STATES = ["calm", "pre_impact", "fall"]
CALM, PRE_IMPACT, FALL = range(3)


@dataclass(frozen=True)
class SmootherConfig:
    ema_alpha: float = 0.3
    pre_impact_enter: float = 0.55
    pre_impact_exit: float = 0.35
    fall_enter: float = 0.50
    fall_exit: float = 0.30
    fall_latch: int = 20

    @property
    def n_codes(self) -> int:
        return 3 + self.fall_latch


def next_code(code: int, pre: float, fall: float, c: SmootherConfig) -> int:
    """State after one row. Codes: calm, pre-impact, fall, then fall with 1, 2, ... latched rows to go."""
    if code > FALL:
        return code - 1
    if fall >= c.fall_enter:
        return FALL + c.fall_latch
    if code == FALL and fall >= c.fall_exit:
        return FALL
    if code == CALM:
        return PRE_IMPACT if pre >= c.pre_impact_enter else CALM
    return PRE_IMPACT if pre >= c.pre_impact_exit else CALM


def _folder(by: Sequence[str], columns: Sequence[str], out: Sequence[str], c: SmootherConfig):
    """Batches of rows in order to the same rows with averages and state; a new group starts afresh."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, average, code = None, None, CALM
        for pdf in batches:
            averages, states = [], []
            rows = zip(zip(*[pdf[k] for k in by]), pdf["_start"].tolist(), pdf["core"].tolist(), *[pdf[p].tolist() for p in columns])
            for key, start, core, *probs in rows:
                if key != group:
                    group, average, code = key, probs, start
                else:
                    average = [c.ema_alpha * p + (1 - c.ema_alpha) * a for p, a in zip(probs, average)]
                if core:
                    code = next_code(code, average[1], average[2], c)
                averages.append(average)
                states.append(STATES[min(code, FALL)])
            smoothed = pd.DataFrame(averages, columns=out[-len(columns) - 1 : -1], index=pdf.index, dtype=float)
            full = pdf.assign(**smoothed, state=pd.Series(states, index=pdf.index, dtype=object))
            yield full.loc[pdf["core"].to_numpy(), list(out)]

    return fold


def _reporter(by: Sequence[str], columns: Sequence[str], c: SmootherConfig):
    """Batches of rows in order to one row per group: its end state for every start state."""

    def report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, average, ends = None, None, []
        for pdf in batches:
            done = []
            rows = zip(zip(*[pdf[k] for k in by]), pdf["core"].tolist(), *[pdf[p].tolist() for p in columns])
            for key, core, *probs in rows:
                if key != group:
                    if group is not None:
                        done.append((*group, ends))
                    group, average, ends = key, probs, list(range(c.n_codes))
                else:
                    average = [c.ema_alpha * p + (1 - c.ema_alpha) * a for p, a in zip(probs, average)]
                if core:
                    step = {code: next_code(code, average[1], average[2], c) for code in set(ends)}
                    ends = [step[e] for e in ends]
            if done:
                yield pd.DataFrame(done, columns=[*by, "ends"])
        if group is not None:
            yield pd.DataFrame([(*group, ends)], columns=[*by, "ends"])

    return report


def _in_order(blocked: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Blocks whole in one partition each and in order: many short series share a task and its batches."""
    return blocked.repartition(*by).sortWithinPartitions(*by, order)


def smooth_alerts(
    probs: DataFrame,
    keys: Sequence[str],
    order: str = "window_index",
    columns: Sequence[str] = ("p_non_fall", "p_pre_impact", "p_fall"),
    config: SmootherConfig | None = None,
    size: int = BLOCK_FRAMES,
) -> DataFrame:
    """Add smoothed probabilities (s_...) and the alert ``state`` to every row.

    ``order`` numbers the rows of a series from 0 without gaps.
    """
    c = config or SmootherConfig()
    keys, columns = list(keys), list(columns)
    by = [*keys, "block"]
    smoothed = [T.StructField(f"s_{p.removeprefix('p_')}", T.DoubleType()) for p in columns]
    schema = T.StructType([*probs.schema.fields, *smoothed, T.StructField("state", T.StringType())])
    context = math.ceil(math.log(1e-18) / math.log(1 - c.ema_alpha)) if c.ema_alpha < 1 else 1
    blocked = with_blocks(probs, order, before=context, size=size)

    longest = probs.agg(F.max(order)).first()[0]
    if longest is None or longest < size:
        started = blocked.withColumn("_start", F.lit(CALM))
    else:
        started = _with_starts(blocked, probs, keys, order, columns, c, size)
    return _in_order(started, by, order).mapInPandas(_folder(by, columns, schema.names, c), schema)


def _with_starts(
    blocked: DataFrame, probs: DataFrame, keys: list[str], order: str, columns: list[str], c: SmootherConfig, size: int
) -> DataFrame:
    """Rows with the state their block starts in, for series longer than one block."""
    by = [*keys, "block"]
    key_fields = [*[probs.schema[k] for k in keys], T.StructField("block", T.LongType())]
    ends_schema = T.StructType([*key_fields, T.StructField("ends", T.ArrayType(T.IntegerType()))])
    starts_schema = T.StructType([*key_fields, T.StructField("_start", T.IntegerType())])
    long = probs.filter(F.col(order) >= size).select(*keys).distinct()
    rows = blocked.join(long, keys, "left_semi").select(*by, order, "core", *columns)
    ends = _in_order(rows, by, order).mapInPandas(_reporter(by, columns, c), ends_schema)

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        starts, code = [], CALM
        for block_ends in pdf["ends"]:
            starts.append(code)
            code = int(block_ends[code])
        return pdf[by].assign(_start=starts)

    # One short row per block of the long series only.
    starts = ends.groupBy(*keys).applyInPandas(chain, starts_schema)
    return blocked.join(starts, by, "left").withColumn("_start", F.coalesce("_start", F.lit(CALM)))


def latest_states(alerts: DataFrame, keys: Iterable[str], order: str) -> DataFrame:
    """The last row per key."""
    keys = list(keys)
    rest = [c for c in alerts.columns if c not in keys]
    latest = alerts.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row"))
    return latest.select(*keys, "_row.*")
