"""Scores and losses of classifiers. Counts fold on the map side; nothing is ranked per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.operators.blocks import prefix
from kinelake.operators.windows import LABEL_IDS


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def _f1(precision: Column, recall: Column) -> Column:
    return _ratio(2 * precision * recall, precision + recall)


def roc_auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve, ties counted half; NaN when a class is missing.

    Rows fold to one per distinct score, which are then ranked in slices of the score range.
    """
    by = list(by)
    positive = F.sum(F.when(F.col(label) == 1, 1).otherwise(0))
    counts = df.groupBy(*by, score).agg(positive.alias("_pos"), (F.count("*") - positive).alias("_neg"))
    below = prefix(counts, by, [score], F.floor(F.col(score) * 4096), "_below", F.col("_neg"))
    area = F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2))
    pairs = F.sum("_pos") * F.sum("_neg")
    return below.groupBy(*by).agg(F.when(pairs > 0, area / pairs).otherwise(float("nan")).alias("roc_auc"))


def binary_metrics(df: DataFrame, label: str = "label", predicted: str = "predicted", by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts, accuracy, precision, recall and F1 (0 where undefined)."""

    def count(actual: int, guess: int) -> Column:
        return F.sum(F.when((F.col(label) == actual) & (F.col(predicted) == guess), 1).otherwise(0))

    cells = df.groupBy(*by).agg(
        count(0, 0).alias("tn"), count(0, 1).alias("fp"), count(1, 0).alias("fn"), count(1, 1).alias("tp")
    )
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    scored = cells.withColumns(
        {
            "n": tn + fp + fn + tp,
            "n_pos": fn + tp,
            "accuracy": _ratio(tp + tn, tn + fp + fn + tp),
            "precision": _ratio(tp, tp + fp),
            "recall": _ratio(tp, tp + fn),
        }
    )
    return scored.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def confusion(df: DataFrame, label: str = "label", predicted: str = "predicted_label", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, label, predicted).agg(F.count("*").alias("n"))


def class_report(
    df: DataFrame, label: str = "label", predicted: str = "predicted_label", by: Sequence[str] = ()
) -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy, macro and weighted averages."""
    by = list(by)
    cells = confusion(df, label, predicted, by)
    sums = []
    for name in LABEL_IDS:
        actual, guess = F.col(label) == name, F.col(predicted) == name
        sums += [
            F.coalesce(F.sum(F.when(actual & guess, F.col("n"))), F.lit(0)).alias(f"hit_{name}"),
            F.coalesce(F.sum(F.when(guess, F.col("n"))), F.lit(0)).alias(f"guess_{name}"),
            F.coalesce(F.sum(F.when(actual, F.col("n"))), F.lit(0)).alias(f"support_{name}"),
        ]
    wide = cells.groupBy(*by).agg(*sums, F.sum("n").alias("_all"))
    rows = []
    for name in LABEL_IDS:
        hit, guess, support = (F.col(f"{k}_{name}") for k in ("hit", "guess", "support"))
        precision, recall = _ratio(hit, guess), _ratio(hit, support)
        rows.append((name, precision, recall, _f1(precision, recall), support))

    accuracy = sum((F.col(f"hit_{name}") for name in LABEL_IDS), F.lit(0)) / F.col("_all")
    per_class = list(rows)
    supports = [r[4] for r in per_class]
    rows.append(("accuracy", accuracy, accuracy, accuracy, F.col("_all")))
    macro = [sum((r[k] for r in per_class), F.lit(0.0)) / len(per_class) for k in (1, 2, 3)]
    weighted = [
        sum((r[k] * w for r, w in zip(per_class, supports)), F.lit(0.0)) / F.col("_all") for k in (1, 2, 3)
    ]
    rows += [("macro avg", *macro, F.col("_all")), ("weighted avg", *weighted, F.col("_all"))]
    packed = F.array(
        *[
            F.struct(
                F.lit(name).alias("class"),
                p.alias("precision"),
                r.alias("recall"),
                f.alias("f1"),
                s.cast("long").alias("support"),
            )
            for name, p, r, f, s in rows
        ]
    )
    return wide.select(*by, F.inline(packed))


def softmax(logits: Sequence[Column]) -> list[Column]:
    """Class probabilities from logits, shifted by the largest."""
    top = F.greatest(*logits)
    powers = [F.exp(x - top) for x in logits]
    total = sum(powers[1:], powers[0])
    return [p / total for p in powers]


def softmax_argmax(df: DataFrame, logits: Sequence[str], names: Sequence[str] = tuple(LABEL_IDS)) -> DataFrame:
    """Add p_<class>, predicted_label_id and predicted_label (the first of equal highest)."""
    values = [F.col(c) for c in logits]
    df = df.withColumns({f"p_{n}": p for n, p in zip(names, softmax(values))})
    best = F.greatest(*values)
    chosen, label = None, None
    for i, (value, name) in enumerate(zip(values, names)):
        test = value == best
        chosen = F.when(test, F.lit(i)) if chosen is None else chosen.when(test, F.lit(i))
        label = F.when(test, F.lit(name)) if label is None else label.when(test, F.lit(name))
    return df.withColumns({"predicted_label_id": chosen, "predicted_label": label})


def focal_loss(
    logits: Sequence[Column], target: Column, alpha: Sequence[float | Column] | None = None, gamma: float = 2.0
) -> Column:
    """Focal loss of one row from logits and class id; gamma 0 is cross-entropy."""
    top = F.greatest(*logits)
    log_total = F.log(sum((F.exp(x - top) for x in logits), F.lit(0.0)))
    picked, weight = None, None
    for i, x in enumerate(logits):
        log_p = x - top - log_total
        picked = F.when(target == i, log_p) if picked is None else picked.when(target == i, log_p)
        if alpha is not None:
            a = alpha[i] if isinstance(alpha[i], Column) else F.lit(float(alpha[i]))
            weight = F.when(target == i, a) if weight is None else weight.when(target == i, a)
    loss = -F.pow(1.0 - F.exp(picked), F.lit(float(gamma))) * picked
    return loss if weight is None else loss * weight


def reduce_loss(df: DataFrame, loss: Column, reduction: str = "mean", by: Sequence[str] = ()) -> DataFrame:
    """Loss per row ("none"), or its sum or mean."""
    if reduction not in ("mean", "sum", "none"):
        raise ValueError(f"reduction must be mean, sum or none, not {reduction}")
    if reduction == "none":
        return df.withColumn("loss", loss)
    return df.groupBy(*by).agg((F.avg if reduction == "mean" else F.sum)(loss).alias("loss"))


def weighted_loss(batches: DataFrame, by: Sequence[str] = (), loss: str = "loss", n: str = "n") -> DataFrame:
    """Mean loss over samples from per-batch means."""
    return batches.groupBy(*by).agg((F.sum(F.col(loss) * F.col(n)) / F.sum(n)).alias("loss"))


def early_stop(
    history: DataFrame, by: Sequence[str], patience: int = 5, epoch: str = "epoch", loss: str = "val_loss"
) -> DataFrame:
    """Best epoch and loss, and epochs run, when training stops after ``patience`` epochs without a new minimum."""
    by = list(by)
    slices = F.floor(F.col(epoch) / 65_536)
    seen = prefix(history, by, [epoch], slices, "_least", F.col(loss), "min")
    better = F.col("_least").isNull() | (F.col(loss) < F.col("_least"))
    seen = seen.withColumn("_best_epoch", F.when(better, F.col(epoch)))
    seen = prefix(seen, by, [epoch], slices, "_before", F.col("_best_epoch"), "max")
    since = F.col(epoch) - F.coalesce(F.col("_best_epoch"), F.col("_before"))
    stops = seen.groupBy(*by).agg(
        F.min(F.when(since >= patience, F.col(epoch))).alias("_stop"), F.max(epoch).alias("_last")
    )
    stops = stops.withColumn("_end", F.coalesce("_stop", "_last"))
    upto = history.join(stops, by).filter(F.col(epoch) <= F.col("_end"))
    return upto.groupBy(*by).agg(
        F.min(F.struct(F.col(loss).alias("l"), F.col(epoch).alias("e"))).alias("_best"),
        F.count("*").alias("epochs_run"),
    ).select(*by, F.col("_best.e").alias("best_epoch"), F.col("_best.l").alias("best_loss"), "epochs_run")
