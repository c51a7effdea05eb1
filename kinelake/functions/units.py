"""Raw counts to physical units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.functions.channels import ACCEL, CHANNELS, GYRO

# Raw column names and full-scale range over resolution per sensor (g, deg/s, g).
RAW_ACCEL = ["raw_adxl_acc_x", "raw_adxl_acc_y", "raw_adxl_acc_z"]
RAW_GYRO = ["raw_gyro_x", "raw_gyro_y", "raw_gyro_z"]
RAW_MMA = ["raw_mma_acc_x", "raw_mma_acc_y", "raw_mma_acc_z"]
RAW_COLUMNS = RAW_ACCEL + RAW_GYRO + RAW_MMA
MMA_ACCEL = ["mma_acc_x", "mma_acc_y", "mma_acc_z"]
ACCEL_SCALE = 32 / 8192
GYRO_SCALE = 4000 / 65536
MMA_SCALE = 16 / 16384
KNOWN_DATASETS = ["kfall", "sisfall"]


def convert_units(samples: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Physical channels per dataset: one is already in g and deg/s, the other in sensor counts.

    Works on one dataset or on a union of both; an unknown dataset is an error.
    """
    name = F.lower(F.col(dataset))
    known = ", ".join(KNOWN_DATASETS)
    unknown = F.raise_error(
        F.concat(F.lit("no unit conversion for dataset "), F.coalesce(name, F.lit("null")), F.lit(f"; known: {known}"))
    ).cast("double")

    def pick(physical: str, raw: str, scale: float) -> Column:
        plain = F.col(physical) if physical in samples.columns else F.lit(None).cast("double")
        scaled = F.col(raw) * F.lit(scale) if raw in samples.columns else F.lit(None).cast("double")
        return F.when(name == "kfall", plain).when(name == "sisfall", scaled).otherwise(unknown)

    converted = {c: pick(c, r, ACCEL_SCALE) for c, r in zip(ACCEL, RAW_ACCEL)}
    converted |= {c: pick(c, r, GYRO_SCALE) for c, r in zip(GYRO, RAW_GYRO)}
    if all(c in samples.columns for c in RAW_MMA):
        converted |= {c: F.col(r) * F.lit(MMA_SCALE) for c, r in zip(MMA_ACCEL, RAW_MMA)}
    return samples.withColumns(converted).drop(*RAW_COLUMNS)


def restrict_channels(samples: DataFrame, *keep: str) -> DataFrame:
    """Only time and the six channels, besides ``keep``."""
    return samples.select(*keep, "time_s", *CHANNELS)
