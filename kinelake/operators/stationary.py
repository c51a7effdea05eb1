"""Longest still segment of each series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinelake.functions.channels import ACCEL, gyro_magnitude
from kinelake.operators.blocks import BLOCK_FRAMES, with_blocks


def quiet_frames(
    samples: DataFrame,
    keys: Sequence[str],
    n: int,
    var_below: float,
    gyro_below: float,
    frame: str = "frame",
    size: int = BLOCK_FRAMES,
) -> DataFrame:
    """Frames covered by some window of ``n`` samples that is still.

    Running sums over a block give each window's variance and mean by subtraction, so the cost
    does not depend on ``n``. A block carries ``n`` frames of context on either side.
    """
    blocked = with_blocks(samples.select(*keys, frame, *ACCEL, gyro_magnitude().alias("_gyro")), frame, n, n, size)
    group = W.partitionBy(*keys, "block")
    ordered = group.orderBy(frame)
    upto = ordered.rowsBetween(W.unboundedPreceding, W.currentRow)
    # A window with a missing or infinite value is not still; such values must not spoil later sums.
    bad = F.lit(False)
    for c in [*ACCEL, "_gyro"]:
        bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    blocked = blocked.withColumn("_bad", bad.cast("int"))
    fine = {c: F.when(F.col("_bad") == 0, F.col(c)) for c in [*ACCEL, "_gyro"]}
    # Values relative to the block's first good sample keep the sums small.
    centred = blocked.withColumns(
        {f"_{a}": F.coalesce(fine[a] - F.first(fine[a], ignorenulls=True).over(ordered), F.lit(0.0)) for a in ACCEL}
    )
    centred = centred.withColumn("_gyro", F.coalesce(fine["_gyro"], F.lit(0.0)))
    squares = sum((F.col(f"_{a}") ** 2 for a in ACCEL), F.lit(0.0))
    sums = [f"_{a}" for a in ACCEL] + ["_square", "_gyro", "_bad"]
    running = centred.withColumn("_square", squares).withColumns(
        {**{f"_sum{c}": F.sum(c).over(upto) for c in sums}, "_seen": F.row_number().over(ordered)}
    )
    window = {f"_win{c}": F.col(f"_sum{c}") - F.coalesce(F.lag(f"_sum{c}", n).over(ordered), F.lit(0)) for c in sums}
    windowed = running.withColumns(window)
    variance = (
        F.col("_win_square") - sum((F.col(f"_win_{a}") ** 2 for a in ACCEL), F.lit(0.0)) / n
    ) / n
    whole = (F.col("_seen") >= n) & (F.col("_win_bad") == 0)
    still = whole & (variance < var_below) & (F.col("_win_gyro") / n < gyro_below)
    flagged = windowed.withColumn("_still", F.when(still, 1).otherwise(0))
    # A frame is quiet if a still window ends at it or at one of the n-1 frames after it.
    counted = flagged.withColumns(
        {"_before": F.sum("_still").over(upto) - F.col("_still"), "_upto": F.sum("_still").over(upto)}
    )
    ahead = F.coalesce(F.lead("_upto", n - 1).over(ordered), F.sum("_still").over(group))
    quiet = counted.withColumn("_quiet", ahead - F.col("_before") > 0)
    return quiet.filter(F.col("core") & F.col("_quiet")).select(*keys, "block", frame)


def stationary_segments(
    samples: DataFrame,
    keys: Sequence[str],
    rate_hz: float,
    min_s: float = 2.0,
    var_thr: float = 0.01,
    gyro_thr: float = 5.0,
    frame: str = "frame",
    size: int = BLOCK_FRAMES,
) -> DataFrame:
    """Longest run of quiet frames per series, the earliest on ties: start and end (exclusive).

    Series without one have no row. Runs are found within blocks; only runs that touch a block
    edge (at most two per block) are put in order per series to be joined up.
    """
    keys = list(keys)
    n = round(min_s * rate_hz)
    quiet = quiet_frames(samples, keys, n, var_thr, gyro_thr, frame, size)
    ordered = W.partitionBy(*keys, "block").orderBy(frame)
    islands = quiet.withColumn("_island", F.col(frame) - F.row_number().over(ordered))
    runs = islands.groupBy(*keys, "block", "_island").agg(
        F.min(frame).alias("start_frame"), (F.max(frame) + 1).alias("end_frame")
    )
    at_edge = (F.col("start_frame") % size == 0) | (F.col("end_frame") % size == 0)
    along = W.partitionBy(*keys).orderBy("start_frame")
    edge = runs.filter(at_edge)
    fresh = F.coalesce((F.col("start_frame") != F.lag("end_frame").over(along)).cast("int"), F.lit(1))
    chained = edge.withColumn("_new", fresh)
    chained = chained.withColumn("_chain", F.sum("_new").over(along))
    joined = chained.groupBy(*keys, "_chain").agg(
        F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame")
    )
    everything = runs.filter(~at_edge).select(*keys, "start_frame", "end_frame")
    everything = everything.unionByName(joined.select(*keys, "start_frame", "end_frame"))
    length = F.col("end_frame") - F.col("start_frame")
    longest = everything.filter(length >= n).groupBy(*keys).agg(
        F.max(F.struct(length.alias("length"), (-F.col("start_frame")).alias("minus_start"))).alias("_best")
    )
    start = -F.col("_best.minus_start")
    return longest.select(
        *keys, start.alias("start_frame"), (start + F.col("_best.length")).alias("end_frame")
    )
