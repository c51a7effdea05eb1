"""Training and scoring."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from kinelake.functions.channels import AUX_CHANNELS, CHANNELS
from kinelake.operators import features, metrics, splits
from kinelake.operators.blocks import number_rows
from kinelake.operators.features import FEATURE_NAMES
from kinelake.plans import detection, prediction
from kinelake.queries.evaluation import PREDICTIONS_SQL, predictions
from kinelake.queries.registry import query
from kinelake.queries.standins import SAMPLES_SQL, samples, series, table, window_samples_sql, windows_sql
from kinelake.session import shared_path

LENGTH, STRIDE = 200, 100


def _labelled_features(spark, sf_dir):
    """Features per window with labels and subjects from the trial key, written once for the fits."""
    found = features.window_features(samples(spark, sf_dir), series(spark, sf_dir), ["trial"], LENGTH, STRIDE)
    trial, index = F.col("trial"), F.col("window_index")
    found = found.withColumns(
        {
            "dataset": F.lit("kfall"),
            "global_subject_id": F.format_string("kfall_SA%02d", trial % 8),
            "label": ((F.col("acc_x_mean") + F.col("tilt_std") / 10) * 7 % 2 >= 1).cast("int"),
            "stage": F.element_at(F.array(F.lit("non_fall"), F.lit("pre_impact"), F.lit("fall")), (index % 3 + 1).cast("int")),
            "start_frame": index * STRIDE,
            "fall_impact_frame": F.when(trial % 3 != 0, 330),
        }
    )
    path = shared_path(spark, "window-features")
    found.write.parquet(path)
    return spark.read.schema(found.schema).parquet(path)


@query("detector_scores")
def detector_scores(spark, sf_dir):
    """Boosted trees fitted on training subjects, stored, loaded, and applied to the test subjects."""
    rows = splits.split_by_subject(_labelled_features(spark, sf_dir))
    train, val, test = (rows.filter(F.col("split") == s) for s in ("train", "val", "test"))
    config = detection.DetectorConfig()
    path = shared_path(spark, "detector")
    detection.save_model(detection.train_detector(train, val, config), path)
    scored = detection.predict_features(detection.load_model(path), test)
    return scored.select("trial", "window_index", "label", "fall_probability", "predicted")


@query("detector_metrics")
def detector_metrics(spark, sf_dir):
    """Confusion, rates and AUC of those scores."""
    found = detector_scores(spark, sf_dir).select("label", "fall_probability", "predicted", F.lit(1).alias("_all"))
    path = shared_path(spark, "detector-scores")
    found.write.parquet(path)  # the rates read the scores once, the AUC three times
    scored = spark.read.schema(found.schema).parquet(path)
    auc = metrics.roc_auc(scored, "label", "fall_probability", ["_all"])
    counts = metrics.binary_metrics(scored, by=["_all"])
    return counts.join(auc, "_all").drop("_all")


def _loso(spark, sf_dir):
    rows = _labelled_features(spark, sf_dir).drop("label").withColumnRenamed("stage", "label")
    ids = F.when(F.col("label") == "non_fall", 0).when(F.col("label") == "pre_impact", 1).otherwise(2)
    return prediction.train_loso(rows.withColumn("label_id", ids), FEATURE_NAMES)


@query("loso_training")
def loso_training(spark, sf_dir):
    """Every fold trained and its held-out subject scored by the stage that early stopping picked, per window."""
    preds, _, _ = _loso(spark, sf_dir)
    return preds.select("fold", "trial", "window_index", "label", "trees", "predicted_label", "p_non_fall", "p_pre_impact", "p_fall")


def mean_logits(batch: np.ndarray) -> np.ndarray:
    """Logits from channel means: a stand-in for any model on (n, length, channels) arrays."""
    mean = batch.mean(axis=1)
    return np.column_stack([mean[:, 6], mean[:, 8] / 23.0, mean[:, 3] - mean[:, 0]])


@query(
    "batch_scoring",
    f"""WITH {SAMPLES_SQL}, {windows_sql(100, 50)}, {window_samples_sql(100)},
m AS (SELECT *, sqrt(acc_x*acc_x + acc_y*acc_y + acc_z*acc_z) AS mag FROM x)
SELECT trial, window_index::BIGINT AS window_index, round(avg(mag), 6) AS l_non_fall,
       round(avg(degrees(acos(greatest(-1.0, least(1.0, acc_z / CASE WHEN mag = 0 THEN 1e-8 ELSE mag END))))) / 23.0, 6) AS l_pre_impact,
       round(avg(gyro_x) - avg(acc_x), 6) AS l_fall
FROM m GROUP BY trial, window_index""",
)
def batch_scoring(spark, sf_dir):
    arrays = features.augmented_windows(samples(spark, sf_dir), series(spark, sf_dir), ["trial"], 100, 50)
    scored = prediction.score_windows(arrays, mean_logits, [*CHANNELS, *AUX_CHANNELS])
    return scored.select("trial", "window_index", *[F.round(f"l_{n}", 6).alias(f"l_{n}") for n in prediction.CLASSES])


@query(
    "loso_report",
    f"""WITH {PREDICTIONS_SQL},
h AS (
  SELECT *, row_number() OVER (PARTITION BY fold ORDER BY o_orderdate, o_orderkey) - 1 AS epoch
  FROM (SELECT 'kfall_' || printf('SA%02d', o_custkey % 32) AS fold, o_orderdate, o_orderkey, o_totalprice AS val_loss FROM orders)),
m AS (SELECT *, min(val_loss) OVER (PARTITION BY fold ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least FROM h),
b AS (SELECT *, max(CASE WHEN least IS NULL OR val_loss < least THEN epoch END) OVER (PARTITION BY fold ORDER BY epoch) AS best FROM m),
e AS (SELECT fold, coalesce(min(epoch) FILTER (epoch - best >= 5), max(epoch)) AS stop FROM b GROUP BY fold),
st AS (SELECT fold, arg_min(epoch, val_loss) AS best_epoch, min(val_loss) AS best_loss, count(*) AS epochs_run FROM h JOIN e USING (fold) WHERE epoch <= stop GROUP BY fold),
ac AS (SELECT global_subject_id AS fold, avg((label = predicted_label)::INT) AS accuracy FROM pr GROUP BY 1),
lt AS (
  SELECT global_subject_id AS fold, activity_code, trial_id,
         (max(fall_impact_frame) - min(start_frame) FILTER (predicted_label = 'pre_impact' AND start_frame < fall_impact_frame)) / 100 * 1000.0::DOUBLE AS lead
  FROM pr WHERE fall_impact_frame IS NOT NULL GROUP BY ALL),
ls AS (SELECT fold, count(*) AS n_trials, count(lead) AS n_flagged, avg(lead) AS mean_lead FROM lt GROUP BY fold)
SELECT fold, best_epoch, best_loss, epochs_run, round(accuracy, 6) AS accuracy, n_trials, n_flagged, round(mean_lead, 6) AS mean_lead_ms
FROM st JOIN ac USING (fold) LEFT JOIN ls USING (fold)""",
)
def loso_report(spark, sf_dir):
    """Early stopping, class report and lead time per fold."""
    orders = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("kfall_"), F.format_string("SA%02d", F.col("o_custkey") % 32)).alias("fold"),
        "o_orderdate", "o_orderkey", F.col("o_totalprice").alias("val_loss"),
    )
    history = number_rows(orders, ["fold"], ["o_orderdate", "o_orderkey"], F.col("o_orderdate"), "epoch")
    stops = metrics.early_stop(history.select("fold", "epoch", "val_loss"), ["fold"])
    preds = predictions(spark, sf_dir).withColumn("fold", F.col("global_subject_id"))
    report = prediction.loso_report(preds, stops, ["activity_code", "trial_id"])
    accuracy = F.filter("report", lambda r: r["class"] == "accuracy")[0]["f1"]
    return report.select(
        "fold", "best_epoch", "best_loss", "epochs_run", F.round(accuracy, 6).alias("accuracy"), "n_trials", "n_flagged",
        F.round("mean_lead_ms", 6).alias("mean_lead_ms"),
    )
