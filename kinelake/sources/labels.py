"""Onset and impact labels: sheets as CSV, one per subject, with merged task cells left blank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.operators.blocks import fill_forward

# Task codes of the sheets and how fall numbers relate to tasks.
TASK_CODE = r"(?i)^T(\d+)$"
FALL_CODE = r"(?i)^F(\d+)\s*\((\d+)\)$"
FALL_TO_SHEET, SHEET_TO_TASK = 19, 2
LABEL_FILE = r"(?i)([^/]+)_label\.csv$"
SHEET_WORDS = ["task", "description", "trial", "onset", "impact"]
#: Lines after which a sheet's carried cells are joined in rather than found in one ordered run.
SHEET_LINES = 65_536
LABEL_SCHEMA = "subject_id string, task_id int, repetition int, onset int, impact int, row_no long"


def normal_name(column: str) -> str:
    return column.strip().lower().replace(" ", "_")


def task_code_problem(code: Column) -> Column:
    """What is wrong with a task code; null if nothing is."""
    text = F.trim(code)
    fall, sheet = (F.regexp_extract(text, FALL_CODE, i).cast("int") for i in (1, 2))
    return (
        F.when(text.rlike(TASK_CODE), F.lit(None))
        .when(text.rlike(FALL_CODE) & (fall + FALL_TO_SHEET != sheet), F.lit("fall number and sheet number disagree"))
        .when(text.rlike(FALL_CODE), F.lit(None))
        .otherwise(F.lit("unknown task code"))
    )


def try_task_id(code: Column) -> Column:
    """Task number of "T22" or "F01 (20)"; null for anything else."""
    text = F.trim(code)
    task = F.when(text.rlike(TASK_CODE), F.regexp_extract(text, TASK_CODE, 1).cast("int")).when(
        text.rlike(FALL_CODE), F.regexp_extract(text, FALL_CODE, 2).cast("int") + SHEET_TO_TASK
    )
    return F.when(task_code_problem(code).isNull(), task)


def resolve_task_id(code: Column) -> Column:
    """Task number of "T22" or "F01 (20)"; anything else is an error."""
    problem = F.raise_error(F.concat(task_code_problem(code), F.lit(": "), F.coalesce(code, F.lit("blank")))).cast("int")
    return F.coalesce(try_task_id(code), problem)


def _find(columns: Sequence[str], word: str) -> str | None:
    return next((c for c in columns if word in c), None)


def fill_labels(rows: DataFrame, file: Sequence[str], order: Sequence[str], split: Column) -> DataFrame:
    """Rows with task and description carried down and the task number resolved.

    Columns are found by the words task, trial, onset, impact in their names.
    """
    rows = rows.toDF(*[c if c.startswith("_") else normal_name(c) for c in rows.columns])
    task = _find(rows.columns, "task")
    if task is None:
        raise ValueError(f"no task column among {rows.columns}")
    carried = [task] + ([d] if (d := _find(rows.columns, "description")) else [])
    filled = fill_forward(rows, file, order, carried, split)
    return filled.withColumn("resolved_task_id", resolve_task_id(F.col(task)))


def standard_labels(filled: DataFrame, subject: str = "subject_id", order: str = "row_no") -> DataFrame:
    """subject_id, task_id, repetition, onset, impact, row_no from a filled sheet.

    A sheet without trial, onset or impact columns labels nothing.
    """
    trial, onset, impact = (_find(filled.columns, w) for w in ("trial", "onset", "impact"))
    if not (trial and onset and impact):
        return filled.sparkSession.createDataFrame([], LABEL_SCHEMA)

    def whole(c: str) -> Column:
        return F.col(c).try_cast("double").cast("int")

    number = F.col(trial).try_cast("double")
    return filled.select(
        F.col(subject).alias("subject_id"),
        F.col("resolved_task_id").alias("task_id"),
        F.when(number == F.floor(number), number.cast("int")).alias("repetition"),
        whole(onset).alias("onset"),
        whole(impact).alias("impact"),
        F.col(order).alias("row_no"),
    )


def parse_sheets(files: DataFrame) -> DataFrame:
    """Rows of label sheets from (subject_id, value), the text of one sheet each; columns are found sheet by sheet.

    Each sheet's first line names its columns, in any order and under any names that hold the words task, description,
    trial, onset and impact (the first such column counts). Returns subject_id, row_no (the line's number), task,
    description, trial, onset, impact as text, all null where a sheet lacks the column. Blank lines are left out.
    """
    lines = F.split(F.regexp_replace("value", "^\ufeff", ""), r"\r?\n")
    rows = files.select("subject_id", F.posexplode(lines).alias("row_no", "line"), F.get(lines, F.lit(0)).alias("head"))
    rows = rows.filter((F.col("row_no") > 0) & (F.trim("line") != ""))
    # Commas bound the number of fields, quoted ones included.
    most = (files.agg(F.max(F.size(F.split(F.get(lines, F.lit(0)), ",")))).first()[0] or 1) + 1
    schema = ", ".join(f"c{i} string" for i in range(most))

    def fields(line: str) -> Column:
        return F.array(*[F.from_csv(line, schema)[f"c{i}"] for i in range(most)])

    rows = rows.withColumns({"names": fields("head"), "fields": fields("line")})
    names = F.transform("names", lambda n: F.lower(F.regexp_replace(F.trim(n), " ", "_")))

    def column(word: str) -> Column:
        place = F.array_position(F.transform(names, lambda n: F.coalesce(n.contains(word), F.lit(False))), True)
        return F.when(place > 0, F.get("fields", (place - 1).cast("int"))).alias(word)

    return rows.select("subject_id", F.col("row_no").cast("long").alias("row_no"), *[column(w) for w in SHEET_WORDS], F.array_contains(
        F.transform(names, lambda n: F.coalesce(n.contains("task"), F.lit(False))), True).alias("_has_task"))


def sheet_labels(files: DataFrame) -> DataFrame:
    """Labels from the texts of sheets (subject_id, value): see ``parse_sheets`` and ``fill_labels``.

    A sheet without a task, trial, onset or impact column labels nothing.
    """
    rows = parse_sheets(files).filter("_has_task").drop("_has_task")
    filled = fill_labels(rows, ["subject_id"], ["row_no"], F.floor(F.col("row_no") / SHEET_LINES))
    found = standard_labels(filled)
    return found.filter("repetition IS NOT NULL OR onset IS NOT NULL OR impact IS NOT NULL")


def read_labels(spark: SparkSession, root: str) -> DataFrame:
    """Labels of all sheets ``<subject>_label.csv`` below ``root``, rows by their line. See ``sheet_labels``."""
    files = spark.read.option("pathGlobFilter", "*_label.csv").text(root, wholetext=True)
    return sheet_labels(files.select(F.regexp_extract(F.col("_metadata.file_path"), LABEL_FILE, 1).alias("subject_id"), "value"))


def repetition(trial_id: Column) -> Column:
    """Repetition number of ids like R01."""
    return F.regexp_extract(trial_id, r"(?i)^R?0*(\d+)", 1).try_cast("int")


def attach_labels(trials: DataFrame, labels: DataFrame) -> DataFrame:
    """Onset and impact of each trial from the first matching label row; null where none matches.

    ``labels``: subject_id, task_id, repetition, onset, impact, row_no.
    """
    first = labels.groupBy("subject_id", "task_id", "repetition").agg(
        F.min_by(F.struct("onset", "impact"), "row_no").alias("_label")
    )
    numbered = trials.drop("fall_onset_frame", "fall_impact_frame").withColumn("repetition", repetition(F.col("trial_id")))
    joined = numbered.join(first, ["subject_id", "task_id", "repetition"], "left")
    return joined.withColumns(
        {"fall_onset_frame": F.col("_label.onset").cast("int"), "fall_impact_frame": F.col("_label.impact").cast("int")}
    ).select(*[c for c in trials.columns if c not in ("fall_onset_frame", "fall_impact_frame")], "fall_onset_frame", "fall_impact_frame")
