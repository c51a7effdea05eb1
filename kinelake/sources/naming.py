"""Ids from file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of trial files, and globs no narrower than them.
KFALL_FILE = r"(?i)^S(A)?(\d+)T(\d+)R(\d+)\.csv$"
KFALL_GLOB = "[Ss]*[Tt]*[Rr]*.[Cc][Ss][Vv]"
SISFALL_FILE = r"(?i)^([DF])(\d+)_([A-Z]{2}\d+)_R(\d+)\.txt$"
SISFALL_GLOB = "[DdFf]*_*_[Rr]*.[Tt][Xx][Tt]"
KFALL_RATE_HZ, SISFALL_RATE_HZ = 100.0, 200.0
KFALL_FALL_TASKS = range(22, 37)


def file_name(path: str | Column) -> Column:
    return F.element_at(F.split(F.col(path) if isinstance(path, str) else path, "/"), -1)


def trial_files(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """Only rows whose file name is that of a trial."""
    return df.filter(file_name(path).rlike(pattern))


def _required(name: Column, pattern: str, value: Column, kind: str) -> Column:
    bad = F.raise_error(F.concat(F.lit("file name does not match the trial pattern: "), name)).cast(kind)
    return F.when(name.rlike(pattern), value).otherwise(bad)


def with_kfall_keys(df: DataFrame, path: str) -> DataFrame:
    """subject_id, activity_code, trial_id, task_id from names like SA06T20R01.csv or S06T20R01.csv."""
    name = file_name(path)

    def number(i: int) -> Column:
        return F.regexp_extract(name, KFALL_FILE, i)

    task = _required(name, KFALL_FILE, number(3).cast("int"), "int")
    return df.withColumns(
        {
            "dataset": F.lit("kfall"),
            "subject_id": _required(name, KFALL_FILE, F.format_string("SA%02d", number(2).cast("int")), "string"),
            "activity_code": _required(name, KFALL_FILE, F.format_string("T%02d", number(3).cast("int")), "string"),
            "trial_id": _required(name, KFALL_FILE, F.concat(F.lit("R"), number(4)), "string"),
            "task_id": task,
        }
    )


def with_sisfall_keys(df: DataFrame, path: str) -> DataFrame:
    """subject_id, activity_code, trial_id, task_id from names like D01_SA01_R01.txt."""
    name = file_name(path)

    def part(i: int) -> Column:
        return F.regexp_extract(name, SISFALL_FILE, i)

    code = F.format_string("%s%02d", F.upper(part(1)), part(2).cast("int"))
    return df.withColumns(
        {
            "dataset": F.lit("sisfall"),
            "subject_id": _required(name, SISFALL_FILE, F.upper(part(3)), "string"),
            "activity_code": _required(name, SISFALL_FILE, code, "string"),
            "trial_id": _required(name, SISFALL_FILE, F.concat(F.lit("R"), part(4)), "string"),
            "task_id": _required(name, SISFALL_FILE, part(2).cast("int"), "int"),
        }
    )


def trial_label() -> Column:
    """fall or adl from dataset and activity."""
    falls = [*KFALL_FALL_TASKS]
    is_fall = F.when(F.col("dataset") == "kfall", F.col("task_id").isin(falls)).otherwise(
        F.col("activity_code").startswith("F")
    )
    return F.when(is_fall, "fall").otherwise("adl")


def native_rate() -> Column:
    return F.when(F.col("dataset") == "kfall", KFALL_RATE_HZ).otherwise(SISFALL_RATE_HZ)
