"""Subject-wise splits, leave-one-subject-out folds, weights and batches.

Subjects are ordered by a hash of seed and name, which every engine can recompute. Splits and
folds are decided on the table of subjects; windows only look their subject up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.functions.channels import half_even
from kinelake.operators.blocks import BLOCK_FRAMES, number_rows, prefix
from kinelake.operators.windows import LABEL_IDS

SUBJECT = "global_subject_id"


def seeded_hash(seed: int, *columns: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def _error(message: str, *parts: Column) -> Column:
    return F.raise_error(F.concat(F.lit(message), *[p.cast("string") for p in parts])).cast("long")


def subject_splits(
    df: DataFrame,
    val: float = 0.15,
    test: float = 0.15,
    seed: int = 42,
    dataset: str = "dataset",
    subject: str = SUBJECT,
) -> DataFrame:
    """One row per subject with its split, drawn within each dataset."""
    subjects = df.select(dataset, subject).distinct().withColumn("_hash", seeded_hash(seed, subject))
    ranked = number_rows(subjects, [dataset], ["_hash", subject], F.substring("_hash", 1, 4), "_rank")
    sizes = subjects.groupBy(dataset).agg(F.count("*").alias("_n"))
    n = F.col("_n")
    sizes = sizes.withColumn(
        "_test", F.when(n < 3, _error("a split needs at least 3 subjects in dataset ", F.col(dataset))).otherwise(F.ceil(n * test))
    )
    sizes = sizes.withColumn("_val", F.ceil((n - F.col("_test")) * (val / (1.0 - test))))
    placed = ranked.join(F.broadcast(sizes), dataset)  # one row per dataset
    rank = F.col("_rank")
    split = (
        F.when(rank < F.col("_test"), "test")
        .when(rank < F.col("_test") + F.col("_val"), "val")
        .otherwise("train")
    )
    return placed.select(dataset, subject, split.alias("split"))


def split_by_subject(
    df: DataFrame,
    val: float = 0.15,
    test: float = 0.15,
    seed: int = 42,
    dataset: str = "dataset",
    subject: str = SUBJECT,
) -> DataFrame:
    """Rows with their subject's split. All rows of a subject share one."""
    return df.join(subject_splits(df, val, test, seed, dataset, subject), [dataset, subject])


def leaking_subjects(df: DataFrame, subject: str = SUBJECT, split: str = "split") -> DataFrame:
    """Subjects found in more than one split."""
    pairs = df.groupBy(subject, split).count()
    found = pairs.groupBy(subject).agg(F.count("*").alias("n_splits"))
    return found.filter(F.col("n_splits") > 1)


def assert_no_leakage(df: DataFrame, subject: str = SUBJECT, split: str = "split") -> None:
    """Raise if a subject is in more than one split."""
    example = leaking_subjects(df, subject, split).take(5)
    if example:
        raise ValueError(f"subjects in more than one split: {[r[subject] for r in example]}")


def loso_folds(df: DataFrame, subject: str = SUBJECT, split: Column | None = None) -> DataFrame:
    """One fold per subject in name order: fold_id and test_subject. Fewer than 2 subjects are an error."""
    subjects = df.select(F.col(subject).alias("test_subject")).distinct()
    slices = F.substring("test_subject", 1, 10) if split is None else split
    folds = number_rows(subjects, [], ["test_subject"], slices, "fold_id")
    count = subjects.agg(F.count("*").alias("_subjects"))  # one row
    few = F.when(F.col("_subjects") < 2, _error("leave-one-subject-out needs at least 2 subjects")).otherwise(F.col("fold_id"))
    return folds.join(F.broadcast(count)).select(few.alias("fold_id"), "test_subject")


def with_fold_role(df: DataFrame, test_subject: str, subject: str = SUBJECT) -> DataFrame:
    """Role of each row in one fold. Roles are compared, not stored per fold."""
    return df.withColumn("role", F.when(F.col(subject) == test_subject, "test").otherwise("train"))


def fold_sizes(df: DataFrame, folds: DataFrame, subject: str = SUBJECT) -> DataFrame:
    """Test and train rows of every fold: the rest is the total less the subject's own."""
    own = df.groupBy(F.col(subject).alias("test_subject")).agg(F.count("*").alias("n_test"))
    total = own.agg(F.sum("n_test").alias("_all"), F.count("*").alias("_subjects")).withColumn("_one", F.lit(1))
    sized = folds.join(own, "test_subject").withColumn("_one", F.lit(1))
    sized = sized.join(F.broadcast(total), "_one")  # one row
    enough = F.when(F.col("_subjects") < 2, _error("leave-one-subject-out needs at least 2 subjects")).otherwise(F.col("_all"))
    return sized.select("fold_id", "test_subject", "n_test", (enough - F.col("n_test")).alias("n_train"))


def ranked_subjects(df: DataFrame, seed: int = 42, subject: str = SUBJECT) -> DataFrame:
    """Subjects with their place in the seeded order."""
    subjects = df.select(subject).distinct().withColumn("_hash", seeded_hash(seed, subject))
    return number_rows(subjects, [], ["_hash", subject], F.substring("_hash", 1, 4), "rank").drop("_hash")


def inner_val_cuts(df: DataFrame, frac: float = 0.15, seed: int = 42, subject: str = SUBJECT) -> DataFrame:
    """Validation subjects of every fold, as a cut in the seeded order.

    In the fold of ``test_subject``, validation subjects are those with rank below ``cut``, other
    than the test subject: max(1, round-half-even(frac * n)) of the n training subjects, at most n - 1.
    """
    ranked = ranked_subjects(df, seed, subject)
    total = ranked.agg((F.count("*") - 1).alias("n_train")).withColumn("_one", F.lit(1))
    folds = ranked.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one")  # one row
    n = F.col("n_train")
    wanted = F.greatest(F.lit(1).cast("long"), half_even(n * frac))
    n_val = F.when(n < 2, _error("an inner split needs at least 2 training subjects")).otherwise(F.least(wanted, n - 1))
    folds = folds.withColumn("n_val", n_val)
    cut = F.col("n_val") + F.when(F.col("rank") < F.col("n_val"), 1).otherwise(0)
    return folds.select(F.col(subject).alias("test_subject"), "rank", "n_train", "n_val", cut.alias("cut"))


def inner_role(test_subject: str, cut: int, subject: str = SUBJECT, rank: str = "rank") -> Column:
    """Train, val or test in one fold, from the subject and its place in the seeded order."""
    return F.when(F.col(subject) == test_subject, "test").when(F.col(rank) < cut, "val").otherwise("train")


def with_inner_role(df: DataFrame, ranked: DataFrame, test_subject: str, cut: int, subject: str = SUBJECT) -> DataFrame:
    """Train, val or test for the rows of one fold."""
    joined = df.join(ranked.select(subject, "rank"), subject)
    return joined.withColumn("role", inner_role(test_subject, cut, subject)).drop("rank")


def _weights(counts: DataFrame, by: Sequence[str], label: str, boost: float) -> DataFrame:
    """Counts per (by, label) to weights: inverse frequency, boosted, summing to the number of classes."""
    wide = counts.groupBy(*by).agg(
        *[F.coalesce(F.sum(F.when(F.col(label) == name, F.col("_n"))), F.lit(0)).alias(f"n_{name}") for name in LABEL_IDS]
    )
    inverse = {
        name: F.when(F.col(f"n_{name}") > 0, 1.0 / F.col(f"n_{name}")).otherwise(
            F.raise_error(F.lit(f"no training rows of class {name}")).cast("double")
        )
        * (boost if name == "pre_impact" else 1.0)
        for name in LABEL_IDS
    }
    total = sum(inverse.values(), F.lit(0.0))
    return wide.select(
        *by, *[(inverse[name] * float(len(LABEL_IDS)) / total).alias(f"w_{name}") for name in LABEL_IDS]
    )


def class_weights(df: DataFrame, by: Sequence[str] = (), boost: float = 2.0, label: str = "label") -> DataFrame:
    """Class weights w_<class> over all rows or per group."""
    counts = df.groupBy(*by, label).agg(F.count("*").alias("_n"))
    return _weights(counts, by, label, boost)


def fold_class_weights(df: DataFrame, boost: float = 2.0, label: str = "label", subject: str = SUBJECT) -> DataFrame:
    """Class weights of every leave-one-subject-out fold, over all of its training subjects.

    Total counts less the test subject's own: no join of windows with folds.
    """
    own = df.groupBy(F.col(subject).alias("test_subject"), label).agg(F.count("*").alias("_own"))
    total = own.groupBy(label).agg(F.sum("_own").alias("_all"))
    # Every subject with every class, so that a class the subject lacks keeps its total.
    grid = own.select("test_subject").distinct()
    grid = grid.withColumn(label, F.explode(F.array(*[F.lit(name) for name in LABEL_IDS])))
    counts = grid.join(own, ["test_subject", label], "left").join(F.broadcast(total), label, "left")  # 3 rows
    counts = counts.withColumn("_n", F.coalesce(F.col("_all"), F.lit(0)) - F.coalesce(F.col("_own"), F.lit(0)))
    return _weights(counts, ["test_subject"], label, boost)


def scale_pos_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """Negatives per positive; 1 if there are no positives."""
    positive = F.sum(F.when(F.col(label) == 1, 1).otherwise(0))
    negative = F.sum(F.when(F.col(label) == 0, 1).otherwise(0))
    return df.agg(positive.alias("n_pos"), negative.alias("n_neg")).withColumn(
        "scale_pos_weight", F.when(F.col("n_pos") > 0, F.col("n_neg") / F.col("n_pos")).otherwise(1.0)
    )


def trial_grouped_batches(
    windows: DataFrame, trial: Sequence[str], batch_size: int, seed: int = 42, order: str = "window_index"
) -> DataFrame:
    """Batches over trials in seeded order, windows of a trial in their own order.

    Adds ``position`` and ``batch_id``; a batch may span two trials. The offset of each trial is
    found on the table of trials, then joined back.
    """
    trial = list(trial)
    numbered = number_rows(windows, trial, [order], F.floor(F.col(order) / BLOCK_FRAMES), "_in_trial")
    counts = windows.groupBy(*trial).agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_hash", seeded_hash(seed, *trial))
    offsets = prefix(counts, [], ["_hash", *trial], F.substring("_hash", 1, 4), "_offset", F.col("_n"))
    placed = numbered.join(offsets.select(*trial, "_offset"), trial)
    placed = placed.withColumn("position", F.col("_offset") + F.col("_in_trial"))
    return placed.withColumn("batch_id", F.floor(F.col("position") / batch_size)).drop("_offset", "_in_trial")
