"""Raw sensor files as one table of samples, and the trials found in it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.functions.units import RAW_COLUMNS
from kinelake.operators.blocks import number_rows
from kinelake.sources import naming
from kinelake.sources.labels import attach_labels

# Columns of the CSV files and their names here.
KFALL_COLUMNS = {
    "TimeStamp(s)": "time_s",
    "FrameCounter": "frame_counter",
    "AccX": "acc_x", "AccY": "acc_y", "AccZ": "acc_z",
    "GyrX": "gyro_x", "GyrY": "gyro_y", "GyrZ": "gyro_z",
    "EulerX": "euler_x", "EulerY": "euler_y", "EulerZ": "euler_z",
}
# Nine whole numbers with commas between, semicolons at the end.
SISFALL_LINE = r"^[+-]?\d+\s*(,\s*[+-]?\d+\s*){8};*$"
WHITE_SPACE = " \t\r\n\f\v"
TRIAL_KEYS = ["dataset", "subject_id", "activity_code", "trial_id"]


def _located(df: DataFrame) -> DataFrame:
    """Path of the file, and the place of the row in it: start of its split, then order of reading."""
    return df.withColumns(
        {
            "source_path": F.col("_metadata.file_path"),
            "_block": F.col("_metadata.file_block_start"),
            "_row": F.monotonically_increasing_id(),
        }
    )


def number_lines(df: DataFrame, keys: Sequence[str] = ("source_path",)) -> DataFrame:
    """Frame numbers in file order, over all files of the keys in path order.

    A long series is numbered split by split: a split of a file is a slice of its own.
    """
    numbered = number_rows(df, list(keys), ["source_path", "_block", "_row"], F.struct("source_path", "_block"))
    return numbered.drop("_block", "_row")


def rename_sensor_columns(df: DataFrame) -> DataFrame:
    """Sensor columns under their names here; all of them are required."""
    missing = sorted(set(KFALL_COLUMNS) - set(df.columns))
    if missing:
        raise ValueError(f"missing sensor columns {missing}")
    kept = [c for c in df.columns if c not in KFALL_COLUMNS]
    named = [F.col(f"`{c}`").cast("double").alias(n) for c, n in KFALL_COLUMNS.items() if n != "frame_counter"]
    return df.select(*kept, *named)


def read_sensor_csv(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Rows of sensor CSV files with their place in the file; other columns of theirs are kept.

    The header comes from the first file; every other file is checked against it as it is read.
    """
    reader = spark.read.option("header", True).option("enforceSchema", False)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return rename_sensor_columns(_located(reader.csv(path)))


def read_kfall(spark: SparkSession, root: str) -> DataFrame:
    """Samples of all trial CSV files below ``root/SA*/``."""
    rows = read_sensor_csv(spark, f"{root.rstrip('/')}/SA*/", naming.KFALL_GLOB)
    trials = naming.trial_files(rows, "source_path", naming.KFALL_FILE)
    return naming.with_kfall_keys(number_lines(trials), "source_path")


def _lines(df: DataFrame, line: str) -> DataFrame:
    """Lines that are not blank, with ``_text`` stripped of white space at both ends."""
    return df.withColumn("_text", F.trim(F.col(line), F.lit(WHITE_SPACE))).filter(F.col("_text") != "")


def parse_sisfall_lines(df: DataFrame, line: str = "value", path: str = "source_path") -> DataFrame:
    """Nine integers per line; blank lines are dropped, anything else is an error with file and line."""
    bad = F.raise_error(
        F.concat(F.col(path), F.lit(f": expected {len(RAW_COLUMNS)} whole numbers, got: "), F.col(line))
    ).cast("string")
    text = F.when(F.col("_text").rlike(SISFALL_LINE), F.col("_text")).otherwise(bad)
    options = {"mode": "FAILFAST", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    schema = ", ".join(f"{c} int" for c in RAW_COLUMNS)
    parsed = _lines(df, line).withColumn("_numbers", F.from_csv(F.rtrim(text, F.lit(";")), schema, options))
    return parsed.select(*[c for c in df.columns if c != line], "_numbers.*")


def read_sisfall(spark: SparkSession, root: str) -> DataFrame:
    """Samples of all trial text files one folder below ``root``."""
    reader = spark.read.option("pathGlobFilter", naming.SISFALL_GLOB)
    located = _located(reader.text(f"{root.rstrip('/')}/*/"))
    lines = parse_sisfall_lines(naming.trial_files(located, "source_path", naming.SISFALL_FILE))
    numbered = number_lines(lines)
    timed = numbered.withColumn("time_s", F.col("frame") / naming.SISFALL_RATE_HZ)
    return naming.with_sisfall_keys(timed, "source_path")


def trial_metadata(samples: DataFrame) -> DataFrame:
    """One row per trial: ids, label, rate, source, samples and time span; frames start out null."""
    rows = samples.groupBy(*TRIAL_KEYS, "task_id", "source_path").agg(
        F.count("*").alias("n_frames"), F.min("time_s").alias("start_s"), F.max("time_s").alias("end_s")
    )
    return rows.withColumns(
        {
            "label": naming.trial_label(),
            "native_rate_hz": naming.native_rate(),
            "fall_onset_frame": F.lit(None).cast("int"),
            "fall_impact_frame": F.lit(None).cast("int"),
        }
    )


def load_trials(spark: SparkSession, dataset: str, root: str, labels: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Samples and trials of a dataset, with onset and impact where ``labels`` gives them."""
    readers = {"kfall": read_kfall, "sisfall": read_sisfall}
    if dataset not in readers:
        raise ValueError(f"no reader for dataset {dataset!r}; known: {sorted(readers)}")
    samples = readers[dataset](spark, root)
    trials = trial_metadata(samples)
    if labels is not None and dataset == "kfall":
        trials = attach_labels(trials, labels)
    return samples, trials


def reader_report(trials: DataFrame, expected: DataFrame | None = None, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Trials, subjects, labels and trial lengths found, and expected subjects (``subject_id``) not found."""
    by = list(by)
    per_subject = trials.groupBy(*by, "subject_id").agg(
        F.count("*").alias("_trials"),
        F.sum((F.col("label") == "fall").cast("long")).alias("_falls"),
        F.min("n_frames").alias("_min"),
        F.max("n_frames").alias("_max"),
        F.sum("n_frames").alias("_rows"),
    )
    report = per_subject.groupBy(*by).agg(
        F.sum("_trials").alias("n_trials"),
        F.count("*").alias("n_subjects"),
        F.sum("_falls").alias("n_fall"),
        (F.sum("_trials") - F.sum("_falls")).alias("n_adl"),
        F.min("_min").alias("min_rows"),
        F.max("_max").alias("max_rows"),
        (F.sum("_rows") / F.sum("_trials")).alias("mean_rows"),
    )
    if expected is None:
        return report
    missing = expected.select(*by, "subject_id").distinct().join(per_subject, [*by, "subject_id"], "left_anti")
    missing = missing.groupBy(*by).agg(F.array_sort(F.collect_list("subject_id")).alias("missing_subjects"))
    return report.join(missing, by, "left").withColumn(
        "missing_subjects", F.coalesce("missing_subjects", F.array().cast("array<string>"))
    )


def unreadable_lines(df: DataFrame, line: str = "value", path: str = "source_path") -> DataFrame:
    """Lines the reader would stop at, counted per file."""
    bad = _lines(df, line).filter(~F.col("_text").rlike(SISFALL_LINE))
    return bad.groupBy(path).agg(F.count("*").alias("n_bad"), F.min(line).alias("example"))
