"""Splits, folds, weights, metrics and losses over predictions derived from the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinelake.operators import metrics, splits, windows
from kinelake.operators.catalog import prediction_trials
from kinelake.operators.windows import LABEL_IDS
from kinelake.queries.registry import query
from kinelake.queries.standins import CATALOG_SQL, catalog, table, windows_sql

LOGITS = ["l_non_fall", "l_pre_impact", "l_fall"]
_LOGIT_EXPR = {
    "l_non_fall": "(trial * 7 + window_index * 13) % 101 / 29",
    "l_pre_impact": "(trial * 11 + window_index * 5) % 97 / 31",
    "l_fall": "(trial * 3 + window_index * 29) % 103 / 37",
}

PREDICTIONS_SQL = f"""{CATALOG_SQL},
n AS (
  SELECT *, round_even(duration_s * 100, 0)::BIGINT AS n_frames FROM c
  WHERE accepted AND dataset = 'kfall' AND (fall_onset_frame IS NOT NULL OR label = 'adl')),
{windows_sql(100, 10)},
lab AS (
  SELECT w.trial, window_index, start_frame, end_frame, n.* EXCLUDE (trial, n_frames, label),
         dataset || '_' || subject_id AS global_subject_id,
         CASE WHEN fall_onset_frame IS NULL OR fall_impact_frame IS NULL THEN 'non_fall'
              WHEN end_frame > fall_impact_frame THEN 'fall'
              WHEN end_frame > fall_onset_frame THEN 'pre_impact' ELSE 'non_fall' END AS label
  FROM w JOIN n USING (trial)),
lg AS (
  SELECT *, {", ".join(f"{e} AS {n}" for n, e in _LOGIT_EXPR.items())},
         CASE label WHEN 'non_fall' THEN 0 WHEN 'pre_impact' THEN 1 ELSE 2 END AS label_id
  FROM lab),
pe AS (
  SELECT *, greatest(l_non_fall, l_pre_impact, l_fall) AS top,
         exp(l_non_fall - greatest(l_non_fall, l_pre_impact, l_fall)) AS e0,
         exp(l_pre_impact - greatest(l_non_fall, l_pre_impact, l_fall)) AS e1,
         exp(l_fall - greatest(l_non_fall, l_pre_impact, l_fall)) AS e2
  FROM lg),
pr AS (
  SELECT *, e0 / (e0 + e1 + e2) AS p_non_fall, e1 / (e0 + e1 + e2) AS p_pre_impact, e2 / (e0 + e1 + e2) AS p_fall,
         CASE WHEN l_non_fall = top THEN 0 WHEN l_pre_impact = top THEN 1 ELSE 2 END AS predicted_label_id,
         CASE WHEN l_non_fall = top THEN 'non_fall' WHEN l_pre_impact = top THEN 'pre_impact' ELSE 'fall' END AS predicted_label
  FROM pe)"""


def _windows(spark, sf_dir):
    """Dense labelled windows of the catalogue, with the supplier key of their trial."""
    found = windows.prediction_windows(prediction_trials(catalog(spark, sf_dir)))
    return found.withColumn("trial", F.substring("trial_id", 2, 12).cast("long"))


def predictions(spark, sf_dir):
    scored = _windows(spark, sf_dir).withColumns({n: F.expr(e) for n, e in _LOGIT_EXPR.items()})
    return metrics.softmax_argmax(scored, LOGITS)


_SUBJECTS_SQL = f"""{CATALOG_SQL},
sub AS (SELECT DISTINCT dataset, dataset || '_' || subject_id AS global_subject_id FROM c),
hs AS (
  SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY md5('42|' || global_subject_id), global_subject_id) - 1 AS k,
         count(*) OVER (PARTITION BY dataset) AS m FROM sub),
sp AS (
  SELECT dataset, global_subject_id,
         CASE WHEN k < ceil(m * 0.15::DOUBLE) THEN 'test'
              WHEN k < ceil(m * 0.15::DOUBLE) + ceil((m - ceil(m * 0.15::DOUBLE)) * {0.15 / (1.0 - 0.15)!r}::DOUBLE) THEN 'val'
              ELSE 'train' END AS split
  FROM hs)"""


def _subject_catalog(spark, sf_dir):
    return catalog(spark, sf_dir).withColumn("global_subject_id", windows.global_subject())


@query(
    "subject_split",
    f"""WITH {_SUBJECTS_SQL}
SELECT dataset, split, global_subject_id, count(*) AS n_trials
FROM c JOIN sp USING (dataset) WHERE sp.global_subject_id = c.dataset || '_' || subject_id
GROUP BY dataset, split, global_subject_id""",
)
def subject_split(spark, sf_dir):
    rows = splits.split_by_subject(_subject_catalog(spark, sf_dir))
    return rows.groupBy("dataset", "split", "global_subject_id").agg(F.count("*").alias("n_trials"))


@query(
    "split_leakage",
    f"""WITH {_SUBJECTS_SQL.replace("s_suppkey % 4 = 0", "s_suppkey % 3 = 0")},
bad AS (SELECT subject_id, split FROM c JOIN sp ON sp.global_subject_id = c.dataset || '_' || subject_id)
SELECT subject_id, count(DISTINCT split) AS n_splits FROM bad GROUP BY subject_id HAVING count(DISTINCT split) > 1""",
)
def split_leakage(spark, sf_dir):
    """Grouping by the bare subject id leaks, because ids repeat across datasets; this finds where.

    Trials are dealt to datasets such that a subject id has trials in both.
    """
    trials = catalog(spark, sf_dir).withColumn("dataset", F.when(F.col("trial") % 3 == 0, "sisfall").otherwise("kfall"))
    rows = splits.split_by_subject(trials.withColumn("global_subject_id", windows.global_subject()))
    return splits.leaking_subjects(rows, "subject_id")


@query(
    "loso_folds",
    f"""WITH {CATALOG_SQL}, sub AS (SELECT DISTINCT dataset || '_' || subject_id AS test_subject FROM c)
SELECT row_number() OVER (ORDER BY test_subject) - 1 AS fold_id, test_subject FROM sub""",
)
def loso_folds(spark, sf_dir):
    return splits.loso_folds(_subject_catalog(spark, sf_dir))


@query(
    "fold_roles",
    f"""WITH {PREDICTIONS_SQL},
own AS (SELECT global_subject_id AS test_subject, count(*) AS n_test FROM lab GROUP BY 1)
SELECT row_number() OVER (ORDER BY test_subject) - 1 AS fold_id, test_subject, n_test,
       (SELECT count(*) FROM lab) - n_test AS n_train
FROM own""",
)
def fold_roles(spark, sf_dir):
    dense = _windows(spark, sf_dir)
    return splits.fold_sizes(dense, splits.loso_folds(dense))


@query(
    "inner_val_subjects",
    f"""WITH {CATALOG_SQL}, sub AS (SELECT DISTINCT dataset || '_' || subject_id AS g FROM c),
pair AS (
  SELECT f.g AS test_subject, t.g AS g,
         row_number() OVER (PARTITION BY f.g ORDER BY md5('42|' || t.g), t.g) AS k, count(*) OVER (PARTITION BY f.g) AS m
  FROM sub f JOIN sub t ON f.g <> t.g),
val AS (
  SELECT * FROM pair WHERE k <= least(m - 1, greatest(1, round_even(m * 0.15::DOUBLE, 0)::BIGINT)))
SELECT test_subject, any_value(m) AS n_train, count(*) AS n_val, arg_max(g, k) AS last_val_subject
FROM val GROUP BY test_subject""",
)
def inner_val_subjects(spark, sf_dir):
    """Size of the inner validation set of every fold and its last subject in seeded order."""
    rows = _subject_catalog(spark, sf_dir)
    cuts = splits.inner_val_cuts(rows)
    ranked = splits.ranked_subjects(rows).select(F.col("rank").alias("_last"), F.col("global_subject_id").alias("last_val_subject"))
    placed = cuts.withColumn("_last", F.col("cut") - 1).join(ranked, "_last")
    return placed.select("test_subject", "n_train", "n_val", "last_val_subject")


@query(
    "class_weights",
    f"""WITH {PREDICTIONS_SQL},
k AS (
  SELECT f.test_subject, l.name AS label,
         (SELECT count(*) FROM lab WHERE label = l.name) -
         coalesce((SELECT count(*) FROM lab WHERE label = l.name AND global_subject_id = f.test_subject), 0) AS cnt
  FROM (SELECT DISTINCT global_subject_id AS test_subject FROM lab) f
  CROSS JOIN (VALUES ('non_fall'), ('pre_impact'), ('fall')) l(name)),
v AS (SELECT test_subject, label, CASE WHEN label = 'pre_impact' THEN 2.0 ELSE 1.0 END::DOUBLE / cnt AS inv FROM k)
SELECT test_subject, {", ".join(f"round(sum(inv) FILTER (label = '{n}') * 3 / sum(inv), 6) AS w_{n}" for n in LABEL_IDS)}
FROM v GROUP BY test_subject""",
)
def class_weights(spark, sf_dir):
    found = splits.fold_class_weights(_windows(spark, sf_dir))
    return found.select("test_subject", *[F.round(f"w_{n}", 6).alias(f"w_{n}") for n in LABEL_IDS])


@query(
    "scale_pos_weight",
    f"""WITH {CATALOG_SQL}
SELECT count(*) FILTER (label = 'fall') AS n_pos, count(*) FILTER (label = 'adl') AS n_neg,
       round(count(*) FILTER (label = 'adl') / count(*) FILTER (label = 'fall'), 6) AS scale_pos_weight
FROM c""",
)
def scale_pos_weight(spark, sf_dir):
    rows = catalog(spark, sf_dir).withColumn("label", (F.col("label") == "fall").cast("int"))
    return splits.scale_pos_weight(rows).withColumn("scale_pos_weight", F.round("scale_pos_weight", 6))


@query(
    "trial_batches",
    f"""WITH {PREDICTIONS_SQL},
pos AS (
  SELECT trial, window_index,
         row_number() OVER (ORDER BY md5('42|' || trial), trial, window_index) - 1 AS position FROM lab)
SELECT trial, window_index::BIGINT AS window_index, position, position // 256 AS batch_id FROM pos""",
)
def trial_batches(spark, sf_dir):
    rows = _windows(spark, sf_dir).select("trial", "window_index")
    return splits.trial_grouped_batches(rows, ["trial"], 256)


# Binary decisions over line items: returned or not, guessed from price and discount.
_BINARY = "SELECT l_linestatus AS fold, (l_returnflag = 'R')::INT AS label, l_quantity::INT % 50 / 50 AS proba FROM lineitem"


def _binary(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.select(
        F.col("l_linestatus").alias("fold"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        (F.col("l_quantity").cast("int") % 50 / 50).alias("proba"),
    )
    return rows.withColumn("predicted", (F.col("proba") >= 0.5).cast("int"))


@query(
    "binary_metrics",
    f"""WITH b AS ({_BINARY}),
k AS (
  SELECT fold, count(*) FILTER (label = 0 AND proba < 0.5) AS tn, count(*) FILTER (label = 0 AND proba >= 0.5) AS fp,
         count(*) FILTER (label = 1 AND proba < 0.5) AS fn, count(*) FILTER (label = 1 AND proba >= 0.5) AS tp
  FROM b GROUP BY fold),
m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM k)
SELECT fold, tn, fp, fn, tp, tn + fp + fn + tp AS n, fn + tp AS n_pos, round((tp + tn) / (tn + fp + fn + tp), 6) AS accuracy,
       round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1
FROM m""",
)
def binary_metrics(spark, sf_dir):
    found = metrics.binary_metrics(_binary(spark, sf_dir), by=["fold"])
    exact = ["fold", "tn", "fp", "fn", "tp", "n", "n_pos"]
    return found.select(*exact, *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query(
    "roc_auc",
    f"""WITH b AS ({_BINARY}),
r AS (
  SELECT fold, label, rank() OVER (PARTITION BY fold ORDER BY proba)
                      + (count(*) OVER (PARTITION BY fold, proba) - 1) / 2 AS mean_rank FROM b)
SELECT fold, round((sum(mean_rank) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2)
             / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 6) AS roc_auc
FROM r GROUP BY fold""",
)
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(_binary(spark, sf_dir), "label", "proba", ["fold"]).withColumn("roc_auc", F.round("roc_auc", 6))


def _class_sql(by: str) -> str:
    return f"""
cm AS (SELECT {by}, label, predicted_label, count(*) AS n FROM pr GROUP BY ALL),
pc AS (
  SELECT {by}, name AS class, coalesce(sum(n) FILTER (label = name AND predicted_label = name), 0) AS hit,
         coalesce(sum(n) FILTER (predicted_label = name), 0) AS guess, coalesce(sum(n) FILTER (label = name), 0) AS support
  FROM cm CROSS JOIN (VALUES ('non_fall'), ('pre_impact'), ('fall')) v(name) GROUP BY {by}, name),
sc AS (
  SELECT *, coalesce(hit / nullif(guess, 0), 0) AS p, coalesce(hit / nullif(support, 0), 0) AS r FROM pc),
sf AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM sc),
rep AS (
  SELECT {by}, class, p, r, f, support FROM sf
  UNION ALL SELECT {by}, 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support), sum(support) FROM sf GROUP BY {by}
  UNION ALL SELECT {by}, 'macro avg', avg(p), avg(r), avg(f), sum(support) FROM sf GROUP BY {by}
  UNION ALL SELECT {by}, 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support),
                   sum(f * support) / sum(support), sum(support) FROM sf GROUP BY {by})"""


@query(
    "class_report",
    f"""WITH {PREDICTIONS_SQL}, {_class_sql("dataset")}
SELECT dataset, class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support::BIGINT AS support FROM rep""",
)
def class_report(spark, sf_dir):
    found = metrics.class_report(predictions(spark, sf_dir), by=["dataset"])
    return found.select("dataset", "class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(
    "softmax_argmax",
    f"""WITH {PREDICTIONS_SQL}
SELECT trial, window_index::BIGINT AS window_index, round(p_non_fall, 6) AS p_non_fall, round(p_pre_impact, 6) AS p_pre_impact,
       round(p_fall, 6) AS p_fall, predicted_label_id::BIGINT AS predicted_label_id, predicted_label
FROM pr""",
)
def softmax_argmax(spark, sf_dir):
    return predictions(spark, sf_dir).select(
        "trial", "window_index", *[F.round(f"p_{n}", 6).alias(f"p_{n}") for n in LABEL_IDS],
        F.col("predicted_label_id").cast("long").alias("predicted_label_id"), "predicted_label",
    )


_LOG_PT = "(CASE label_id WHEN 0 THEN l_non_fall WHEN 1 THEN l_pre_impact ELSE l_fall END - top - ln(e0 + e1 + e2))"
_ALPHA = [0.5, 2.0, 0.5]


@query(
    "focal_loss",
    f"""WITH {PREDICTIONS_SQL},
f AS (
  SELECT global_subject_id, {_LOG_PT} AS lp, CASE label_id WHEN 0 THEN 0.5 WHEN 1 THEN 2.0 ELSE 0.5 END::DOUBLE AS a FROM pr)
SELECT global_subject_id, count(*) AS n, round(avg(-1 * (1 - exp(lp)) ** 2 * lp * a), 6) AS focal_mean,
       round(sum(-1 * (1 - exp(lp)) ** 2 * lp * a), 4) AS focal_sum, round(avg(-lp), 6) AS cross_entropy
FROM f GROUP BY global_subject_id""",
)
def focal_loss(spark, sf_dir):
    logits = [F.col(c) for c in LOGITS]
    weighted = metrics.focal_loss(logits, F.col("label_id"), _ALPHA)
    plain = metrics.focal_loss(logits, F.col("label_id"), gamma=0.0)
    return predictions(spark, sf_dir).groupBy("global_subject_id").agg(
        F.count("*").alias("n"),
        F.round(F.avg(weighted), 6).alias("focal_mean"),
        F.round(F.sum(weighted), 4).alias("focal_sum"),
        F.round(F.avg(plain), 6).alias("cross_entropy"),
    )


@query(
    "epoch_loss",
    """WITH b AS (SELECT o_custkey AS fold, o_orderkey % 256 + 1 AS n, o_totalprice / 100003 AS loss FROM orders)
SELECT fold, round(sum(loss * n) / sum(n), 6) AS loss FROM b GROUP BY fold""",
)
def epoch_loss(spark, sf_dir):
    batches = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("fold"), (F.col("o_orderkey") % 256 + 1).alias("n"), (F.col("o_totalprice") / 100003).alias("loss")
    )
    return metrics.weighted_loss(batches, ["fold"]).withColumn("loss", F.round("loss", 6))


@query(
    "early_stopping",
    """WITH h AS (
  SELECT o_custkey AS fold, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS epoch,
         o_totalprice AS val_loss FROM orders),
m AS (SELECT *, min(val_loss) OVER (PARTITION BY fold ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least FROM h),
b AS (
  SELECT *, max(CASE WHEN least IS NULL OR val_loss < least THEN epoch END)
            OVER (PARTITION BY fold ORDER BY epoch) AS best FROM m),
e AS (SELECT fold, coalesce(min(epoch) FILTER (epoch - best >= 5), max(epoch)) AS stop FROM b GROUP BY fold)
SELECT fold, arg_min(epoch, val_loss) AS best_epoch, min(val_loss) AS best_loss, count(*) AS epochs_run
FROM h JOIN e USING (fold) WHERE epoch <= stop GROUP BY fold""",
)
def early_stopping(spark, sf_dir):
    from kinelake.operators.blocks import number_rows

    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("fold"), "o_orderdate", "o_orderkey", F.col("o_totalprice").alias("val_loss")
    )
    history = number_rows(orders, ["fold"], ["o_orderdate", "o_orderkey"], F.col("o_orderdate"), "epoch")
    return metrics.early_stop(history.select("fold", "epoch", "val_loss"), ["fold"], 5)
