"""Trial catalogue: selection, upsert, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Primary key and columns of the catalogue.
MANIFEST_KEY = ["dataset", "subject_id", "activity_code", "trial_id"]
MANIFEST_COLUMNS = MANIFEST_KEY + [
    "label", "duration_s", "sample_rate_hz", "accepted", "calibration_source", "harmonized_path",
    "fall_onset_frame", "fall_impact_frame",
]


def detection_trials(manifest: DataFrame, datasets: Sequence[str] | None = None, accepted_only: bool = True) -> DataFrame:
    """Trials usable for detection."""
    rows = manifest if datasets is None else manifest.filter(F.col("dataset").isin(list(datasets)))
    return rows.filter("accepted") if accepted_only else rows


def prediction_trials(manifest: DataFrame, accepted_only: bool = True) -> DataFrame:
    """Trials usable for pre-impact prediction: annotated falls and daily activities of one dataset."""
    rows = manifest.filter(
        (F.col("dataset") == "kfall") & (F.col("fall_onset_frame").isNotNull() | (F.col("label") == "adl"))
    )
    return rows.filter("accepted") if accepted_only else rows


def upsert_manifest(existing: DataFrame, new: DataFrame, keys: Sequence[str] = MANIFEST_KEY) -> DataFrame:
    """Existing rows replaced by new ones with the same key; new rows are taken as they come."""
    kept = existing.join(new.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(new)


def label_distribution(windows: DataFrame, label: str = "label", subject: str = "global_subject_id") -> DataFrame:
    """Windows and subjects per label; folds to (label, subject) first, so one label is no bottleneck."""
    per_subject = windows.groupBy(label, subject).count()
    return per_subject.groupBy(label).agg(
        F.sum("count").alias("n_windows"), F.count("*").alias("n_subjects")
    )
