"""Fall detection: window features to a boosted-tree classifier and its scores."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.functions.channels import CHANNELS
from kinelake.operators.catalog import detection_trials
from kinelake.operators.features import FEATURE_NAMES, array_features, features_batch
from kinelake.operators.splits import scale_pos_weight
from kinelake.operators.windows import DETECTION_WINDOWS, WindowConfig, detection_windows
from kinelake.sources.sensors import TRIAL_KEYS


@dataclass(frozen=True)
class DetectorConfig:
    """Boosting settings. Early stopping compares validation error between rounds."""

    max_rounds: int = 300
    max_depth: int = 6
    learning_rate: float = 0.05
    row_share: float = 0.8
    feature_share: float = 0.8
    validation_tol: float = 1e-4
    seed: int = 42


def check_features(df: DataFrame, names: Sequence[str] = FEATURE_NAMES) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing feature columns {missing}")


def assembler(names: Sequence[str] = FEATURE_NAMES) -> VectorAssembler:
    return VectorAssembler(inputCols=list(names), outputCol="features", handleInvalid="keep")


def train_detector(
    train: DataFrame, val: DataFrame, config: DetectorConfig | None = None, names: Sequence[str] = FEATURE_NAMES
) -> PipelineModel:
    """Fit on ``train`` with positives weighted by class balance, stopping early on ``val``."""
    c = config or DetectorConfig()
    check_features(train, names)
    balance = scale_pos_weight(train).select("scale_pos_weight")
    marked = train.withColumn("is_validation", F.lit(False)).unionByName(val.withColumn("is_validation", F.lit(True)))
    weight = balance.first()[0]
    marked = marked.withColumn("weight", F.when(F.col("label") == 1, F.lit(float(weight))).otherwise(1.0))
    trees = GBTClassifier(
        featuresCol="features",
        labelCol="label",
        weightCol="weight",
        validationIndicatorCol="is_validation",
        maxIter=c.max_rounds,
        maxDepth=c.max_depth,
        stepSize=c.learning_rate,
        subsamplingRate=c.row_share,
        featureSubsetStrategy=str(c.feature_share),
        validationTol=c.validation_tol,
        seed=c.seed,
    )
    kept = marked.select(*names, F.col("label").cast("double").alias("label"), "weight", "is_validation")
    return Pipeline(stages=[assembler(names), trees]).fit(kept)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def model_features(model) -> list[str]:
    """Feature columns that a model reads: those of its assembler, or all."""
    for stage in getattr(model, "stages", [model]):
        if isinstance(stage, VectorAssembler):
            return stage.getInputCols()
    return list(FEATURE_NAMES)


def predict_features(model, features: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Fall probability and decision per window; works for one window as for many, or none.

    ``model`` is anything with ``transform``: a fitted one adds ``probability``, a vector of two, a fixed rule
    ``fall_probability`` itself. Columns that it needs and does not find are an error.
    """
    check_features(features, model_features(model))
    scored = model.transform(features)
    if "probability" in scored.columns:
        scored = scored.withColumn("fall_probability", vector_to_array("probability")[1])
    scored = scored.withColumn("predicted", (F.col("fall_probability") >= threshold).cast("int"))
    return scored.drop("features", "rawPrediction", "probability", "prediction")


def predict_windows(
    model, windows: DataFrame, keys: Sequence[str], config: WindowConfig = DETECTION_WINDOWS, threshold: float = 0.5
) -> DataFrame:
    """Windows given as rows of six channel arrays, named by ``keys``, to scored windows."""
    return predict_features(model, array_features(windows, keys, config.length, config.rate_hz), threshold)


def predict_window(
    spark: SparkSession, model, window: Sequence[Sequence[float]], config: WindowConfig = DETECTION_WINDOWS, threshold: float = 0.5
) -> tuple[float, int]:
    """Fall probability and decision of one window of (samples, six channels)."""
    channels = [[float(row[i]) for row in window] for i in range(len(CHANNELS))]
    one = spark.createDataFrame([(0, *channels)], "id int, " + ", ".join(f"{c} array<double>" for c in CHANNELS))
    row = predict_windows(model, one, ["id"], config, threshold).first()
    return row["fall_probability"], row["predicted"]


def predict(
    model,
    manifest: DataFrame,
    samples: DataFrame,
    config: WindowConfig = DETECTION_WINDOWS,
    datasets: Sequence[str] | None = None,
    keys: Sequence[str] = TRIAL_KEYS,
    threshold: float = 0.5,
) -> DataFrame:
    """Catalogue and samples to scored windows of the accepted trials."""
    windows = detection_windows(detection_trials(manifest, datasets), config)
    features = features_batch(windows, samples, keys, config.length, config.rate_hz)
    return predict_features(model, features, threshold)
