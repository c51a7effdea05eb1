"""Ordered work on long series without putting a whole series in one task.

Most series are short, but one series may hold a large share of all rows. Everything here that
needs an order splits such a series into bounded slices:

* ``prefix`` / ``number_rows`` run totals and ranks per key. Keys above ``hot_rows`` rows are worked
  slice by slice and joined to the totals of the slices before.
* ``with_blocks`` groups numbered frames into fixed-size blocks, copying the few frames a block
  needs from its neighbours, so that window functions and grouped maps can use (key, block).
* ``join_series`` brings per-series attributes to blocked rows on (key, block).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK_FRAMES = 65_536
HOT_ROWS = 2_000_000


def prefix(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence,
    split: Column,
    out: str,
    value: Column | None = None,
    how: str = "sum",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the sum, min or max of ``value`` over the rows before this one within ``keys``.

    Without ``value``, the number of rows before. Sums start at 0, min and max at null.
    ``split`` must rise with ``order`` (for example its leading column, coarsened). It cuts the
    keys with more than ``hot_rows`` rows into slices; with no ``keys`` all rows are sliced.
    ``order`` must be total up to rows that are alike.
    """
    keys = list(keys)
    if keys:
        # At most (all rows / hot_rows) keys pass the filter, so the broadcast stays small.
        hot = df.groupBy(*keys).count().filter(F.col("count") > hot_rows)
        hot = hot.select(*keys, F.lit(True).alias("_hot"))
        sliced = df.join(F.broadcast(hot), keys, "left").withColumn("_slice", F.when(F.col("_hot"), split))
        sliced = sliced.drop("_hot")
    else:
        sliced = df.withColumn("_slice", split)
    part = keys + ["_slice"]
    ordered = W.partitionBy(*part).orderBy(*order)
    fold = {"sum": F.sum, "min": F.min, "max": F.max}[how]
    if value is None:
        local = (F.row_number().over(ordered) - 1).cast("long")
        value = F.lit(1)
    else:
        local = fold(value).over(ordered.rowsBetween(W.unboundedPreceding, -1))
    ranked = sliced.withColumn("_local", local)
    sizes = sliced.filter(F.col("_slice").isNotNull()).groupBy(*part).agg(fold(value).alias("_size"))
    upto = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    base = sizes.select(*part, fold("_size").over(upto).alias("_base"))
    joined = ranked.join(base, part, "left")
    if how == "sum":
        total = F.coalesce(F.col("_local"), F.lit(0)) + F.coalesce(F.col("_base"), F.lit(0))
    else:
        total = (F.least if how == "min" else F.greatest)(F.col("_local"), F.col("_base"))
    return joined.withColumn(out, total).drop("_slice", "_local", "_base")


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence,
    split: Column,
    out: str = "frame",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Number rows from 0 within ``keys`` in ``order``."""
    return prefix(df, keys, order, split, out, hot_rows=hot_rows)


def fill_forward(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence,
    columns: Sequence[str],
    split: Column,
) -> DataFrame:
    """Carry the last non-null value of each column down, slice by slice (``split`` as above)."""
    part = list(keys) + ["_slice"]
    sliced = df.withColumn("_slice", split)
    upto = W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    position = F.struct(*[c if isinstance(c, Column) else F.col(c) for c in order])
    ends = sliced.groupBy(*part).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), position)).alias(f"_end_{c}") for c in columns]
    )
    earlier = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carry = ends.select(
        *part, *[F.last(f"_end_{c}", ignorenulls=True).over(earlier).alias(f"_carry_{c}") for c in columns]
    )
    filled = sliced.withColumns({c: F.last(c, ignorenulls=True).over(upto) for c in columns})
    filled = filled.join(carry, part, "left")
    filled = filled.withColumns({c: F.coalesce(F.col(c), F.col(f"_carry_{c}")) for c in columns})
    return filled.select(*df.columns)


def with_blocks(
    df: DataFrame,
    frame: str = "frame",
    before: int = 0,
    after: int = 0,
    size: int = BLOCK_FRAMES,
) -> DataFrame:
    """Add ``block`` and ``core``; copy up to ``before``/``after`` neighbouring frames into a block.

    ``core`` is true for the one copy that belongs to the block; the others are context only.
    """
    f = F.col(frame)
    if before == 0 and after == 0:
        return df.withColumns({"block": F.floor(f / size), "core": F.lit(True)})
    first = F.greatest(F.lit(0).cast("long"), F.floor((f - after) / size))
    last = F.floor((f + before) / size)
    blocks = df.withColumn("block", F.explode(F.sequence(first, last)))
    return blocks.withColumn("core", F.floor(f / size) == F.col("block"))


def join_series(
    blocked: DataFrame,
    series: DataFrame,
    keys: Sequence[str],
    n_frames: str,
    size: int = BLOCK_FRAMES,
) -> DataFrame:
    """Join one-row-per-series attributes to blocked rows on (keys, block).

    The series side is repeated once per block, so a long series is not one join key.
    """
    last = F.floor((F.col(n_frames) - 1) / size)
    spread = series.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return blocked.join(spread, list(keys) + ["block"])


def join_spans(
    samples: DataFrame,
    spans: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    frame: str = "frame",
    cell: int = BLOCK_FRAMES,
) -> DataFrame:
    """Samples with frames in [start, end) of the spans of their series.

    The two meet on (keys, cell of frames), so a long series is not one join key. Choose ``cell``
    near the length of a span: each span is repeated once per cell it touches.
    """
    cells = F.sequence(F.floor(F.greatest(F.col(start), F.lit(0)) / cell), F.floor((F.col(end) - 1) / cell))
    spread = spans.filter((F.col(end) > 0) & (F.col(start) < F.col(end))).withColumn("_cell", F.explode(cells))
    located = samples.withColumn("_cell", F.floor(F.col(frame) / cell))
    joined = located.join(spread, [*keys, "_cell"])
    return joined.filter((F.col(frame) >= F.col(start)) & (F.col(frame) < F.col(end))).drop("_cell")
