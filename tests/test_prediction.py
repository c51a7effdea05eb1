"""Leave-one-subject-out training: staged scores, histories and the stage that was picked."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from kinelake.plans import prediction
from kinelake.plans.prediction import CLASSES, PredictorConfig


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    data = []
    for subject in range(4):
        for i in range(30):
            k = i % 3
            data.append((f"kfall_SA{subject:02d}", i, CLASSES[k], k, float(k + rng.normal(0, 0.6)), float(rng.normal())))
    return spark.createDataFrame(data, "global_subject_id string, i int, label string, label_id int, x double, y double")


def test_stages_are_means_of_trees(rows):
    forest = RandomForestClassifier(labelCol="label_id", numTrees=6, maxDepth=3, seed=1)
    fit = Pipeline(stages=[VectorAssembler(inputCols=["x", "y"], outputCol="features"), forest]).fit(rows)
    whole = {(r["s"], r["i"]): r["p"] for r in fit.transform(rows).select(F.col("global_subject_id").alias("s"), "i", vector_to_array("probability").alias("p")).collect()}
    staged = prediction.staged_scores(fit, rows, 2).collect()
    assert len(staged) == len(whole) and [s["trees"] for s in staged[0]["stages"]] == [2, 4, 6]
    for r in staged:
        last = [r["stages"][-1][f"p_{n}"] for n in CLASSES]
        assert np.allclose(last, whole[r["global_subject_id"], r["i"]])
        assert all(sum(s[f"p_{n}"] for n in CLASSES) == pytest.approx(1) for s in r["stages"])


def test_all_folds_use_the_stage_of_their_history(spark, rows):
    import duckdb

    config = PredictorConfig(trees=8, step=1, patience=2, max_depth=3)
    preds, history, stops = prediction.train_loso(rows, ["x", "y"], config)
    told = history.toPandas()
    assert set(told["fold"]) == {f"kfall_SA{s:02d}" for s in range(4)} and len(told) == 4 * 8
    want = duckdb.sql(
        """WITH m AS (SELECT *, min(val_loss) OVER (PARTITION BY fold ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least FROM told),
        b AS (SELECT *, max(CASE WHEN least IS NULL OR val_loss < least THEN epoch END) OVER (PARTITION BY fold ORDER BY epoch) AS best FROM m),
        e AS (SELECT fold, coalesce(min(epoch) FILTER (epoch - best >= 2), max(epoch)) AS stop FROM b GROUP BY fold)
        SELECT fold, arg_min(epoch, val_loss) AS best FROM told JOIN e USING (fold) WHERE epoch <= stop GROUP BY fold"""
    ).fetchall()
    assert {(r["fold"], r["best_epoch"]) for r in stops.collect()} == set(want)
    found = preds.toPandas()
    assert len(found) == rows.count() and (found["fold"] == found["global_subject_id"]).all()
    assert dict(found.groupby("fold")["trees"].first() - 1) == dict(want)
    assert (found["label"] == found["predicted_label"]).mean() > 0.5


def test_unknown_subject_is_an_error(rows):
    with pytest.raises(ValueError, match="no rows"):
        prediction.train_loso(rows, ["x", "y"], subjects=["kfall_SA99"])


def test_folds_at_once_change_nothing(spark, rows):
    found = []
    for n in (1, 3):
        config = PredictorConfig(trees=4, step=2, max_depth=2, folds_at_once=n)
        preds, history, _ = prediction.train_loso(rows, ["x", "y"], config)
        found.append([sorted(map(tuple, t.collect())) for t in (preds, history)])
    assert found[0] == found[1]


def test_every_tree_of_a_forest_is_worked_out_in_compiled_methods(rows):
    forest = RandomForestClassifier(labelCol="label_id", numTrees=40, maxDepth=3, seed=1)
    fit = Pipeline(stages=[VectorAssembler(inputCols=["x", "y"], outputCol="features"), forest]).fit(rows)
    staged = prediction.staged_scores(fit, rows.select("global_subject_id", "x", "y"), 5)
    plan = staged._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "aggregate(" not in plan
    assert [s["trees"] for s in staged.first()["stages"]] == list(range(5, 41, 5))
