"""Raw recordings to the harmonized store."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.functions.channels import CHANNELS, HARMONIZED_COLUMNS
from kinelake.functions.units import convert_units
from kinelake.operators import filtering, rotation, stationary
from kinelake.operators.catalog import MANIFEST_COLUMNS
from kinelake.operators.rotation import CALIBRATION, CalibrationConfig
from kinelake.operators.validate import validate
from kinelake.session import shared_path
from kinelake.sources import tables
from kinelake.sources.naming import KFALL_RATE_HZ, SISFALL_RATE_HZ
from kinelake.sources.sensors import TRIAL_KEYS, load_trials

SUBJECT_KEYS = ["dataset", "subject_id"]
NATIVE_RATE = {"kfall": KFALL_RATE_HZ, "sisfall": SISFALL_RATE_HZ}


@dataclass(frozen=True)
class HarmonizeConfig:
    target_rate_hz: float = 100.0
    filter_low_hz: float = 0.5
    filter_high_hz: float = 20.0
    filter_order: int = 4


def resolve_calibrations(
    converted: DataFrame, trials: DataFrame, native_hz: float, config: CalibrationConfig
) -> DataFrame:
    """Calibration of every subject of a dataset, on converted samples at their own rate."""
    signal = converted.select(*TRIAL_KEYS, "frame", *CHANNELS)
    segments = stationary.stationary_segments(signal, TRIAL_KEYS, native_hz, config.min_seconds)
    paths = trials.withColumn("path", F.col("source_path"))
    own = rotation.calibrate(signal, segments, paths, SUBJECT_KEYS, TRIAL_KEYS, config)
    return rotation.group_fallback(own, ["dataset"])


def harmonize(
    samples: DataFrame,
    calibrations: DataFrame,
    native_hz: float,
    config: HarmonizeConfig | None = None,
    keys: Sequence[str] = TRIAL_KEYS,
    subject: Sequence[str] = SUBJECT_KEYS,
) -> DataFrame:
    """Convert, resample, rotate, filter, keep time and six channels, in this order.

    Samples of one dataset, all at ``native_hz``. Rotation and conversion stay in the JVM; only
    resampling (where rates differ) and filtering go through Python, a block at a time.
    """
    c = config or HarmonizeConfig()
    signal = convert_units(samples).select(*dict.fromkeys([*keys, *subject]), "frame", *HARMONIZED_COLUMNS)
    signal = filtering.resample(signal, keys, CHANNELS, native_hz, c.target_rate_hz)
    signal = rotation.rotate(signal, calibrations, subject)
    signal = filtering.bandpass(
        signal, keys, CHANNELS, c.target_rate_hz, c.filter_low_hz, c.filter_high_hz, c.filter_order
    )
    return signal.select(*keys, "frame", *HARMONIZED_COLUMNS)


def run_harmonization(
    spark: SparkSession,
    dataset: str,
    sensor_root: str,
    store: str,
    labels: DataFrame | None = None,
    manifest_path: str | None = None,
    config: HarmonizeConfig | None = None,
    calibration: CalibrationConfig | None = None,
) -> DataFrame:
    """Harmonize a dataset into ``store`` and the catalogue; returns the summary as one row.

    The harmonized samples are written once to the shared folder, so that validation and the
    final, routed write read them instead of computing them again.
    """
    c = config or HarmonizeConfig()
    samples, trials = load_trials(spark, dataset, sensor_root, labels)
    native = NATIVE_RATE[dataset]
    calibrations = resolve_calibrations(convert_units(samples), trials, native, calibration or CALIBRATION[dataset])
    calibrations = _settle(calibrations, "calibrations")
    harmonized = _settle(harmonize(samples, calibrations, native, c), "harmonized")
    verdicts = validate(harmonized, trials, calibrations, TRIAL_KEYS, SUBJECT_KEYS, c.target_rate_hz)
    verdicts = _settle(verdicts, "verdicts")
    tables.write_harmonized(harmonized, verdicts, f"{store}/samples", dataset)
    records = tables.provenance(trials, calibrations, verdicts, asdict(c))
    tables.upsert(records, f"{store}/provenance")
    manifest = manifest_rows(verdicts, calibrations, store, c.target_rate_hz)
    if manifest_path is not None:
        tables.write_manifest(manifest, manifest_path)
    return summarize(verdicts, calibrations)


def _settle(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def manifest_rows(verdicts: DataFrame, calibrations: DataFrame, store: str, rate_hz: float) -> DataFrame:
    """Catalogue rows of validated trials."""
    rows = verdicts.join(calibrations.select(*SUBJECT_KEYS, F.col("source").alias("calibration_source")), SUBJECT_KEYS)
    # The folder that holds the trial, beside others; its rows are told by the trial's key.
    place = F.concat(F.lit(f"{store}/samples/dataset="), F.col("dataset"), F.lit("/bucket="), tables.bucket().cast("string"))
    return rows.withColumns(
        {
            "duration_s": F.col("n_frames") / F.lit(rate_hz),
            "sample_rate_hz": F.lit(rate_hz),
            "harmonized_path": place,
        }
    ).select(*MANIFEST_COLUMNS)


def summarize(verdicts: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Per dataset: trials, accepted, quarantined, and subjects by calibration source."""
    counts = verdicts.groupBy("dataset").agg(
        F.count("*").alias("n_trials_total"),
        F.sum(F.col("accepted").cast("long")).alias("n_written"),
        F.sum((~F.col("accepted")).cast("long")).alias("n_quarantined"),
    )
    sources = rotation.calibration_counts(calibrations, ["dataset"])
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n_subjects"))))  # a few sources
    return counts.join(sources.groupBy("dataset").agg(pairs.alias("calibration_source_counts")), "dataset", "left")
