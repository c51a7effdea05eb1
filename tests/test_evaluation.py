import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinelake.operators import metrics, review, splits


@pytest.fixture(scope="module")
def people(spark):
    rows = [(d, f"{d}_S{i:02d}", k, k % 2) for d in ("a", "b") for i in range(10) for k in range(5)]
    return spark.createDataFrame(rows, "dataset string, global_subject_id string, k int, label int")


def test_split_sizes_and_disjointness(people):
    got = splits.split_by_subject(people)
    subjects = got.select("dataset", "global_subject_id", "split").distinct().toPandas()
    assert got.count() == 100 and len(subjects) == 20
    for _, g in subjects.groupby("dataset"):
        assert g["split"].value_counts().to_dict() == {"train": 6, "test": 2, "val": 2}
    splits.assert_no_leakage(got)
    again = splits.split_by_subject(people).select("dataset", "global_subject_id", "split").distinct().toPandas()
    key = ["dataset", "global_subject_id"]
    assert again.sort_values(key).reset_index(drop=True).equals(subjects.sort_values(key).reset_index(drop=True))


@pytest.mark.parametrize("n,sizes", [(70 - 32, (26, 6, 6)), (32, (22, 5, 5))])
def test_published_split_sizes(spark, n, sizes):
    df = spark.createDataFrame([("d", f"s{i}") for i in range(n)], "dataset string, global_subject_id string")
    counts = {r["split"]: r["count"] for r in splits.subject_splits(df).groupBy("split").count().collect()}
    assert (counts["train"], counts["val"], counts["test"]) == sizes


def test_leakage_is_caught(people, spark):
    bad = spark.createDataFrame([("s", "train"), ("s", "test")], "global_subject_id string, split string")
    with pytest.raises(ValueError, match="more than one split"):
        splits.assert_no_leakage(bad)
    few = people.filter("global_subject_id in ('a_S00', 'a_S01')")
    with pytest.raises(Exception, match="at least 3 subjects"):
        splits.split_by_subject(few).collect()


def test_folds_and_inner_validation(people):
    folds = splits.loso_folds(people).orderBy("fold_id").collect()
    assert [r["fold_id"] for r in folds] == list(range(20))
    assert [r["test_subject"] for r in folds] == sorted(r["test_subject"] for r in folds)
    sizes = splits.fold_sizes(people, splits.loso_folds(people)).collect()
    assert all((r["n_test"], r["n_train"]) == (5, 95) for r in sizes)
    ranked = splits.ranked_subjects(people)
    for r in splits.inner_val_cuts(people).orderBy("rank").collect()[::6]:
        roles = splits.with_inner_role(people, ranked, r["test_subject"], r["cut"])
        counts = {x["role"]: x["n"] for x in roles.groupBy("role").agg(F.countDistinct("global_subject_id").alias("n")).collect()}
        assert counts == {"test": 1, "val": 3, "train": 16} and r["n_val"] == 3
    one = people.filter("global_subject_id = 'a_S00'")
    with pytest.raises(Exception, match="at least 2"):
        splits.fold_sizes(one, splits.loso_folds(one)).collect()


def test_class_weights(spark):
    counts = {"non_fall": 249_970, "pre_impact": 15_912, "fall": 83_059}
    df = spark.createDataFrame([(k, v) for k, v in counts.items()], "label string, n int")
    df = df.withColumn("i", F.explode(F.expr("sequence(1, n)"))).drop("i")
    row = splits.class_weights(df).first()
    assert [row["w_non_fall"], row["w_pre_impact"], row["w_fall"]] == pytest.approx([0.0847, 2.660, 0.2548], abs=1e-3)
    with pytest.raises(Exception, match="no training rows of class"):
        splits.class_weights(df.filter("label != 'fall'")).collect()


def test_fold_class_weights(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(
        {"global_subject_id": rng.choice(list("abcd"), 400), "label": rng.choice(["non_fall", "pre_impact", "fall"], 400)}
    )
    got = {r["test_subject"]: r for r in splits.fold_class_weights(spark.createDataFrame(pdf)).collect()}
    for s in "abcd":
        c = pdf[pdf.global_subject_id != s]["label"].value_counts()
        inv = {"non_fall": 1 / c["non_fall"], "pre_impact": 2 / c["pre_impact"], "fall": 1 / c["fall"]}
        for k, v in inv.items():
            assert got[s][f"w_{k}"] == pytest.approx(3 * v / sum(inv.values()))


def test_batches(spark):
    rows = [(t, i) for t in range(7) for i in range(t + 3)]
    df = spark.createDataFrame(rows, "t long, window_index long")
    got = splits.trial_grouped_batches(df, ["t"], 4).toPandas().sort_values("position")
    assert list(got["position"]) == list(range(len(rows))) and (got["batch_id"] == got["position"] // 4).all()
    changes = (got["t"] != got["t"].shift()).sum()
    assert changes == 7 and (got.groupby("t")["window_index"].apply(lambda s: s.is_monotonic_increasing)).all()


def test_auc_against_pairs(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"label": rng.integers(0, 2, 300), "p": np.round(rng.random(300), 2)})
    pos, neg = pdf[pdf.label == 1]["p"].to_numpy(), pdf[pdf.label == 0]["p"].to_numpy()
    want = ((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)).mean()
    assert metrics.roc_auc(spark.createDataFrame(pdf), "label", "p").first()[0] == pytest.approx(want)
    one = metrics.roc_auc(spark.createDataFrame(pdf[pdf.label == 1]), "label", "p").first()[0]
    assert np.isnan(one)


def test_binary_metrics_undefined_is_zero(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "label int, predicted int")
    row = metrics.binary_metrics(df).first()
    assert (row["precision"], row["recall"], row["f1"], row["accuracy"]) == (0.0, 0.0, 0.0, 1.0)


def test_focal_loss(spark):
    df = spark.createDataFrame([(2.0, 1.0, -1.0, 0), (0.1, 0.2, 3.0, 1)], "a double, b double, c double, y int")
    logits = [F.col(c) for c in "abc"]
    x = np.array([[2.0, 1.0, -1.0], [0.1, 0.2, 3.0]])
    p = np.exp(x) / np.exp(x).sum(1, keepdims=True)
    pt = p[[0, 1], [0, 1]]

    def value(**kw):
        loss = metrics.focal_loss(logits, F.col("y"), **kw)
        return metrics.reduce_loss(df, loss).first()[0]

    assert value(gamma=0.0) == pytest.approx(-np.log(pt).mean())
    assert value() == pytest.approx(((1 - pt) ** 2 * -np.log(pt)).mean())
    assert value(alpha=[1.0, 3.0, 1.0]) == pytest.approx(((1 - pt) ** 2 * -np.log(pt) * [1, 3]).mean())
    with pytest.raises(ValueError):
        metrics.reduce_loss(df, F.lit(1.0), "max")


def test_early_stop(spark):
    losses = {1: [5, 4, 3, 3, 3, 3, 3, 3, 1], 2: [5, 4, 6, 6, 3, 9], 3: [1.0]}
    df = spark.createDataFrame([(f, e, float(v)) for f, vs in losses.items() for e, v in enumerate(vs)], "f int, epoch int, val_loss double")
    got = {r["f"]: tuple(r)[1:] for r in metrics.early_stop(df, ["f"], 5).collect()}
    assert got == {1: (2, 3.0, 8), 2: (4, 3.0, 6), 3: (0, 1.0, 1)}


def test_lead_times(spark):
    rows = [
        ("a", 150, "pre_impact", 208), ("a", 130, "pre_impact", 208), ("a", 100, "non_fall", 208), ("a", 210, "pre_impact", 208),
        ("b", 208, "pre_impact", 208), ("b", 10, "fall", 208), ("c", 0, "pre_impact", None),
    ]
    df = spark.createDataFrame(rows, "t string, start_frame int, predicted_label string, fall_impact_frame int")
    leads = review.lead_time(df, ["t"])
    assert {r["t"]: r["lead_time_ms"] for r in leads.collect()} == {"a": pytest.approx(780.0), "b": None}
    row = review.lead_time_summary(leads).first()
    assert (row["n_trials"], row["n_flagged"], row["detection_rate"]) == (2, 1, 0.5)
    assert row["median_lead_ms"] == pytest.approx(780.0)
    with pytest.raises(Exception, match="no trials"):
        review.lead_time_summary(leads.filter("t = 'z'")).collect()


def test_bins_are_right_closed(spark):
    df = spark.createDataFrame([(float(d),) for d in (-400, -399, -20, 0, 1, 20, 400, 401)], "d double")
    got = [r[0] for r in df.select(review.distance_bin(F.col("d"))).collect()]
    assert got == [None, 0, 4, 5, 6, 6, 11, None]


def test_qa_picks(spark):
    rows = [("s", "fall", f"p{i}") for i in range(3)] + [("s", "adl", "p9"), ("u", "fall", "p1"), ("u", "fall", "p2")]
    df = spark.createDataFrame(rows, "subject_id string, label string, path string")
    got = review.pick_qa_trials(df, 3).toPandas().sort_values(["subject_id", "pick"])
    assert list(got[got.subject_id == "s"]["path"]) == ["p9", "p0", "p1"]
    assert list(got[got.subject_id == "u"]["path"]) == ["p1", "p2"]
