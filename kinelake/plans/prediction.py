"""Pre-impact prediction: leave-one-subject-out training and scoring of three classes."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinelake.functions.channels import AUX_CHANNELS, CHANNELS
from kinelake.operators.metrics import class_report, early_stop, focal_loss, weighted_loss
from kinelake.operators.review import lead_time, lead_time_summary
from kinelake.operators.splits import class_weights, inner_role, inner_val_cuts, ranked_subjects, with_fold_role
from kinelake.operators.windows import LABEL_IDS
from kinelake.session import shared_path

SUBJECT = "global_subject_id"
CLASSES = list(LABEL_IDS)
Scorer = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class PredictorConfig:
    """Forest and its stages: one of every ``step`` trees. A stage takes the place of an epoch.

    ``folds_at_once`` folds are worked on together: the tasks of one fill the gaps between the jobs of another.
    """

    trees: int = 40
    step: int = 5
    patience: int = 5
    max_depth: int = 8
    val_fraction: float = 0.15
    boost: float = 2.0
    gamma: float = 2.0
    seed: int = 42
    folds_at_once: int = 4


def score_windows(windows: DataFrame, scorer: Scorer, channels: Sequence[str] = (*CHANNELS, *AUX_CHANNELS)) -> DataFrame:
    """Add logits l_<class> from ``scorer(batch)``, which maps (n, length, channels) to (n, 3).

    Any model that runs on arrays can be plugged in; windows travel in Arrow batches.
    """
    channels = list(channels)
    schema = T.StructType([T.StructField(f"l_{name}", T.DoubleType()) for name in CLASSES])

    @F.pandas_udf(schema)
    def logits(batch: pd.DataFrame) -> pd.DataFrame:
        if not len(batch):
            return pd.DataFrame(columns=schema.names, dtype=float)
        stacked = np.stack([np.stack(batch[c].to_list()) for c in channels], axis=2)
        return pd.DataFrame(np.asarray(scorer(stacked), dtype=float), columns=schema.names)

    scored = windows.withColumn("_l", logits(F.struct(*channels)))
    return scored.select(*windows.columns, "_l.*")


def staged_scores(model: PipelineModel, rows: DataFrame, step: int) -> DataFrame:
    """Add ``stages``: class probabilities of the first ``step``, 2 * ``step``, .. trees of a fitted forest.

    A forest's probabilities are the mean of its trees', so every size is judged from one fit.
    """
    assembler, forest = model.stages
    trees = forest.trees
    scored = assembler.transform(rows)
    for i, tree in enumerate(trees):
        tree.setFeaturesCol("features").setProbabilityCol(f"_t{i}").setRawPredictionCol("").setPredictionCol("")
        scored = tree.transform(scored)
    votes = F.array(*[vector_to_array(f"_t{i}") for i in range(len(trees))])
    names = [f"p_{name}" for name in CLASSES]
    count, sizes = len(trees), np.arange(step, len(trees) + 1, step)

    # Arguments of a Python function are worked out in small methods. As columns of their own, so many trees make one
    # method too long to be compiled, and the loops over them run many times as long.
    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("trees", T.IntegerType()), *[T.StructField(n, T.DoubleType()) for n in names]])))
    def stages(batch: pa.Array) -> pa.Array:
        rows = len(batch)
        each = batch.flatten().flatten().to_numpy(zero_copy_only=False).reshape(rows, count, len(CLASSES))
        means = (each.cumsum(axis=1)[:, sizes - 1] / sizes[:, None]).reshape(-1, len(CLASSES))
        parts = [pa.array(np.tile(sizes.astype(np.int32), rows)), *[pa.array(p) for p in means.T.copy()]]
        ends = np.arange(rows + 1, dtype=np.int32) * len(sizes)
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(parts, ["trees", *names]))

    return scored.select(*rows.columns, stages(votes).alias("stages"))


def fit_fold(rows: DataFrame, names: Sequence[str], config: PredictorConfig | None = None) -> tuple[PipelineModel, DataFrame]:
    """Forest of one fold and its history: validation loss after each stage.

    ``rows`` have roles train, val and test. Loss is focal loss on the validation subjects; class weights come
    from all training subjects of the fold, validation included.
    """
    c = config or PredictorConfig()
    weights = class_weights(rows.filter("role != 'test'"), boost=c.boost).first()
    alpha = [float(weights[f"w_{name}"]) for name in CLASSES]
    weight = F.element_at(F.array(*[F.lit(a) for a in alpha]), F.col("label_id").cast("int") + 1)
    weighed = rows.withColumns({"weight": weight, "label_id": F.col("label_id").cast("double")})
    assembler = VectorAssembler(inputCols=list(names), outputCol="features", handleInvalid="keep")
    forest = RandomForestClassifier(
        featuresCol="features", labelCol="label_id", weightCol="weight", numTrees=c.trees, maxDepth=c.max_depth, seed=c.seed
    )
    model = Pipeline(stages=[assembler, forest]).fit(weighed.filter("role = 'train'"))
    val = staged_scores(model, weighed.filter("role = 'val'").select(SUBJECT, "label_id", *names), c.step)
    each = val.select(SUBJECT, "label_id", F.posexplode_outer("stages").alias("epoch", "_s")).select(SUBJECT, "label_id", "epoch", "_s.*")
    logs = [F.log(F.greatest(F.col(f"p_{name}"), F.lit(1e-12))) for name in CLASSES]
    loss = focal_loss(logs, F.col("label_id"), alpha, c.gamma)
    per_subject = each.groupBy("epoch", "trees", SUBJECT).agg(F.avg(loss).alias("loss"), F.count("*").alias("n"))
    return model, weighted_loss(per_subject, ["epoch", "trees"]).withColumnRenamed("loss", "val_loss")


def train_loso(
    features: DataFrame, names: Sequence[str], config: PredictorConfig | None = None, subjects: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Leave-one-subject-out over all subjects (or the given ones): (predictions, history, stops).

    Each fold is fitted once, early stopping picks the stage from its history, and that stage scores the subject
    left out. Rows with their subject's place in the seeded order, history and predictions are written to the
    shared folder, the last two a folder for each fold.
    """
    c = config or PredictorConfig()
    spark = features.sparkSession
    cuts = {r["test_subject"]: r["cut"] for r in inner_val_cuts(features, c.val_fraction, c.seed).collect()}  # one per subject
    folds = sorted(cuts) if subjects is None else list(subjects)
    absent = [s for s in folds if s not in cuts]
    if absent:
        raise ValueError(f"no rows of subjects {absent}")
    placed = shared_path(spark, "loso-rows")
    ranked = features.join(ranked_subjects(features, c.seed), SUBJECT)
    ranked.write.parquet(placed)
    ranked = spark.read.schema(ranked.schema).parquet(placed)
    told, scores = shared_path(spark, "loso-history"), shared_path(spark, "loso-scores")

    def fit(fold: str) -> PipelineModel:
        model, losses = fit_fold(ranked.withColumn("role", inner_role(fold, cuts[fold])), names, c)
        losses.select(F.lit(fold).alias("fold"), "epoch", "trees", "val_loss").write.parquet(f"{told}/{folds.index(fold)}")
        return model

    def score(fold: str) -> T.StructType:
        own = with_fold_role(ranked.drop("rank"), fold).filter("role = 'test'").drop("role")
        staged = staged_scores(models[fold], own, c.step)
        chosen = staged.withColumn("_s", F.get("stages", F.lit(best[fold]))).drop("stages")
        preds = _labelled(chosen.select(F.lit(fold).alias("fold"), *own.columns, F.col("_s.trees").alias("trees"), *[F.col(f"_s.p_{n}").alias(f"p_{n}") for n in CLASSES]))
        preds.write.parquet(f"{scores}/{folds.index(fold)}")
        return preds.schema

    with ThreadPool(c.folds_at_once) as pool:
        models = dict(zip(folds, pool.map(inheritable_thread_target(spark)(fit), folds)))
        history = spark.read.schema("fold string, epoch int, trees int, val_loss double").parquet(*[f"{told}/{i}" for i in range(len(folds))])
        stops = early_stop(history, ["fold"], c.patience)
        best = {r["fold"]: r["best_epoch"] for r in stops.collect()}  # one per fold
        schemas = pool.map(inheritable_thread_target(spark)(score), folds)
    return spark.read.schema(schemas[0]).parquet(*[f"{scores}/{i}" for i in range(len(folds))]), history, stops


def _labelled(df: DataFrame) -> DataFrame:
    """The class of the highest probability, the first of equal ones."""
    best = F.greatest(*[F.col(f"p_{name}") for name in CLASSES])
    label = None
    for name in CLASSES:
        test = F.col(f"p_{name}") == best
        label = F.when(test, F.lit(name)) if label is None else label.when(test, F.lit(name))
    return df.withColumn("predicted_label", label)


def loso_report(preds: DataFrame, stops: DataFrame, trial: Sequence[str], fold: str = "fold", rate_hz: float = 100.0) -> DataFrame:
    """Per fold: best epoch and loss, epochs run, class report and lead time.

    ``stops`` is the outcome of early stopping per fold.
    """
    report = class_report(preds, by=[fold])
    packed = report.groupBy(fold).agg(
        F.array_sort(F.collect_list(F.struct("class", "precision", "recall", "f1", "support"))).alias("report")
    )  # six rows a fold
    leads = lead_time_summary(lead_time(preds, [fold, *trial], rate_hz), [fold])
    return stops.join(packed, fold).join(leads, fold, "left")
