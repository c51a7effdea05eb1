"""Channel names and per-sample expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Channel order of harmonized data.
ACCEL = ["acc_x", "acc_y", "acc_z"]
GYRO = ["gyro_x", "gyro_y", "gyro_z"]
CHANNELS = ACCEL + GYRO
HARMONIZED_COLUMNS = ["time_s"] + CHANNELS
AUX_CHANNELS = ["accel_mag", "jerk", "tilt_deviation_deg"]


def norm3(x: str, y: str, z: str) -> Column:
    return F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y) + F.col(z) * F.col(z))


def accel_magnitude() -> Column:
    return norm3(*ACCEL)


def gyro_magnitude() -> Column:
    return norm3(*GYRO)


def tilt_degrees(magnitude: Column, vertical: str = "acc_z") -> Column:
    """Angle between the acceleration vector and the vertical axis."""
    safe = F.when(magnitude == 0, F.lit(1e-8)).otherwise(magnitude)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(vertical) / safe))
    return F.degrees(F.acos(cosine))


def half_even(value: Column) -> Column:
    """Round to the nearest integer, ties to even."""
    return F.rint(value).cast("long")
