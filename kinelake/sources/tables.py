"""Parquet tables of the store: harmonized samples, provenance, catalogue, features, runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.functions.channels import CHANNELS
from kinelake.operators.catalog import MANIFEST_COLUMNS, MANIFEST_KEY, upsert_manifest
from kinelake.session import shared_path
from kinelake.sources.sensors import TRIAL_KEYS
from kinelake.sources.versions import drop_versions, versions


#: Subjects of a dataset are spread over so many folders of the store.
BUCKETS = 64


def bucket(subject: str = "subject_id") -> Column:
    """The folder of a subject within its dataset."""
    return F.pmod(F.xxhash64(subject), F.lit(BUCKETS)).cast("int")


def upsert(rows: DataFrame, path: str, keys: Sequence[str] = TRIAL_KEYS, order: Sequence[str] = ()) -> None:
    """Writes trials beside those stored; what was stored of the same trials is replaced, all else stays.

    Only folders (dataset, bucket) that get rows are written again. The new rows are worked out once and staged in the
    shared folder, beside what those folders held of other trials; both together then take the folders' place.
    """
    spark, keys = rows.sparkSession, list(keys)
    placed = rows.withColumn("bucket", bucket())
    before = _existing(spark, path)
    if before is not None:
        stage = shared_path(spark, "upsert")
        placed.write.parquet(f"{stage}/new")
        placed = spark.read.schema(placed.schema).parquet(f"{stage}/new")
        new = placed.select(*keys, "bucket").distinct()
        touched = before.join(new.select("dataset", "bucket").distinct(), ["dataset", "bucket"], "left_semi")
        kept = touched.join(new.select(*keys), keys, "left_anti").select(*placed.columns)
        kept.write.parquet(f"{stage}/kept")
        placed = placed.unionByName(spark.read.schema(kept.schema).parquet(f"{stage}/kept"))
    parted = placed.hint("rebalance", F.col("dataset"), F.col("bucket"))  # a long subject may fill several files
    writer = parted.sortWithinPartitions("dataset", "bucket", *order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("dataset", "bucket").parquet(path)


def write_harmonized(
    samples: DataFrame, verdicts: DataFrame, root: str, dataset: str, keys: Sequence[str] = TRIAL_KEYS
) -> None:
    """Adds trials of one dataset to the store, accepted and quarantined ones told apart by ``accepted``.

    A trial stored before is replaced, so it is never in both states; other trials stay. Only trials with a
    verdict are written.
    """
    keys = list(keys)
    own = verdicts.filter(F.col("dataset") == dataset).select(*keys, "accepted")
    routed = samples.filter(F.col("dataset") == dataset).join(own, keys)
    upsert(routed, root, keys, ["accepted", *[k for k in keys if k != "dataset"], "frame"])


def read_harmonized(spark: SparkSession, root: str, accepted: bool = True, columns: Sequence[str] = CHANNELS) -> DataFrame:
    """Samples of accepted (or quarantined) trials, only the wanted channels."""
    rows = spark.read.parquet(root).filter(F.col("accepted") == accepted)
    return rows.select(*TRIAL_KEYS, "frame", *columns)


def provenance(
    trials: DataFrame,
    calibrations: DataFrame,
    verdicts: DataFrame,
    params: Mapping[str, float],
    keys: Sequence[str] = TRIAL_KEYS,
    subject: Sequence[str] = ("dataset", "subject_id"),
) -> DataFrame:
    """What was done to each trial, as columns and as one JSON record."""
    rows = trials.join(calibrations.select(*subject, F.col("source").alias("calibration_source")), list(subject), "left")
    rows = rows.join(verdicts.select(*keys, "issues"), list(keys))
    fields = [*keys, "label", "fall_onset_frame", "fall_impact_frame", "calibration_source", "issues"]
    rows = rows.select(*fields, (F.size("issues") == 0).alias("accepted"), *[F.lit(v).alias(k) for k, v in params.items()])
    return rows.withColumn("record", F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}))


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of the catalogue."""
    return spark.read.parquet(f"{path}/version={versions(spark, path, 'version')[-1]}")


def write_manifest(new: DataFrame, path: str, keys: Sequence[str] = MANIFEST_KEY) -> None:
    """Upsert rows by key. Each write makes a whole version, so readers never see half of one; two are kept."""
    spark = new.sparkSession
    held = versions(spark, path, "version")
    rows, version = new, 0
    if held:
        version = held[-1] + 1
        rows = upsert_manifest(load_manifest(spark, path), new.select(*MANIFEST_COLUMNS), keys)
    rows.select(*MANIFEST_COLUMNS).orderBy(*keys).write.mode("overwrite").parquet(f"{path}/version={version}")
    drop_versions(spark, path, "version", held[:-1])


def cache_features(features: DataFrame, path: str, recompute: bool = False) -> DataFrame:
    """Features of the given datasets from the table at ``path``, computed and added where it lacks them.

    With ``recompute`` the given datasets are replaced. The cache is partitioned by dataset, so
    choosing datasets is a partition filter.
    """
    spark = features.sparkSession
    held = None if recompute else _existing(spark, path)
    todo = features
    if held is not None:
        names = [r[0] for r in held.select("dataset").distinct().collect()]  # one row per dataset
        todo = features.filter(~F.col("dataset").isin(names))
    writer = todo.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("dataset").parquet(path)
    asked = [r[0] for r in features.select("dataset").distinct().collect()]  # one row per dataset
    return spark.read.schema(features.schema).parquet(path).filter(F.col("dataset").isin(asked))


def append_run(report: DataFrame, path: str, model: str, run_id: str) -> None:
    """Add a report to the runs table, under its model and run."""
    named = report.withColumns({"model": F.lit(model), "run_id": F.lit(run_id)})
    named.write.mode("append").partitionBy("model", "run_id").parquet(path)


def append_metrics(metrics: DataFrame, path: str, run_id: str) -> None:
    """Add metric rows (step, name, value) to the log of a run, with the time of writing."""
    stamped = metrics.withColumns({"logged_at": F.current_timestamp(), "run_id": F.lit(run_id)})
    stamped.write.mode("append").partitionBy("run_id").parquet(path)
