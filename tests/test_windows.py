import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinelake.operators import windows as w


def loop_windows(n, length, stride):
    if n <= 0:
        return []
    if n <= length:
        return [(0, n)]
    out, start = [], 0
    while start + length <= n:
        out.append((start, start + length))
        start += stride
    if out[-1][1] < n:
        out.append((out[-1][1], n))
    return out


@pytest.mark.parametrize("length,stride", [(10, 5), (10, 10), (7, 3), (4, 9), (1, 1)])
def test_boundaries_match_loop(spark, length, stride):
    series = spark.range(0, 60).withColumn("n", F.col("id"))
    got = w.window_specs(series, "n", length, stride, per_task=4).toPandas().sort_values(["id", "window_index"])
    for n in range(60):
        rows = got[got["id"] == n]
        assert list(zip(rows["start_frame"], rows["end_frame"])) == loop_windows(n, length, stride)
        assert list(rows["window_index"]) == list(range(len(rows)))
        assert (rows["n_real_samples"] + rows["n_pad_samples"] == length).all()


@pytest.mark.parametrize("length,stride", [(10, 5), (7, 3), (4, 9)])
def test_samples_match_both_ways(spark, length, stride):
    sizes = [1, 3, 4, 7, 9, 10, 11, 14, 25, 40]
    pdf = pd.DataFrame([(k, f, float(k * 100 + f)) for k, n in enumerate(sizes) for f in range(n)], columns=["k", "frame", "v"])
    samples = spark.createDataFrame(pdf)
    series = spark.createDataFrame([(k, n) for k, n in enumerate(sizes)], "k long, n long")
    specs = w.window_specs(series, "n", length, stride).select("k", "window_index", "start_frame", "end_frame")
    joined = w.materialize_windows(specs, samples, ["k"], length)
    direct = w.assign_windows(samples.join(series, "k"), "n", length, stride)
    want = sorted(
        (k, i, o, float(k * 100 + min(s + o, e - 1)), s + o >= e)
        for k, n in enumerate(sizes)
        for i, (s, e) in enumerate(loop_windows(n, length, stride))
        for o in range(length)
    )
    for rows in (joined, direct):
        got = rows.select("k", "window_index", "offset", "v", "is_pad").collect()
        assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize(
    "start,end,onset,impact,label",
    [
        (0, 100, None, None, "non_fall"),
        (0, 100, 50, None, "non_fall"),
        (0, 130, 130, 208, "non_fall"),
        (31, 131, 130, 208, "pre_impact"),
        (108, 208, 130, 208, "pre_impact"),
        (109, 209, 130, 208, "fall"),
        (300, 400, 130, 208, "fall"),
    ],
)
def test_labels(spark, start, end, onset, impact, label):
    row = spark.createDataFrame([(start, end, onset, impact)], "s long, e long, o int, i int")
    got = row.select(w.onset_impact_label(F.col("s"), F.col("e"), F.col("o"), F.col("i"))).first()[0]
    assert got == label


def test_disordered_labels_raise(spark):
    row = spark.createDataFrame([(0, 100, 50, 50)], "s long, e long, o int, i int")
    with pytest.raises(Exception, match="precede"):
        row.select(w.onset_impact_label(F.col("s"), F.col("e"), F.col("o"), F.col("i"))).collect()


def test_half_even_lengths():
    assert w.WindowConfig(0.125, 0.1, 100.0).length == 12
    assert w.DETECTION_WINDOWS.length == 200 and w.DETECTION_WINDOWS.stride == 100
    assert w.PREDICTION_WINDOWS.length == 100 and w.PREDICTION_WINDOWS.stride == 10


def test_detection_example(spark):
    """550 samples at 200/100: five windows, the last one padded by 150."""
    row = spark.createDataFrame(
        [("kfall", "SA06", "T01", "R01", "adl", 5.5, "p")],
        "dataset string, subject_id string, activity_code string, trial_id string, label string, duration_s double, harmonized_path string",
    )
    got = w.detection_windows(row).orderBy("window_index").toPandas()
    assert list(got["start_frame"]) == [0, 100, 200, 300, 500]
    assert list(got["n_pad_samples"]) == [0, 0, 0, 0, 150]
    assert set(got["global_subject_id"]) == {"kfall_SA06"} and set(got["label"]) == {0}
    assert np.all(got.columns == w.DETECTION_COLUMNS)


def test_window_without_samples_is_an_error(spark):
    specs = spark.createDataFrame([(0, 0, 5, 5)], "k long, window_index long, start_frame long, end_frame long")
    samples = spark.createDataFrame([(0, 4, 1.0)], "k long, frame long, v double")
    with pytest.raises(Exception, match="without real samples"):
        w.materialize_windows(specs, samples, ["k"], 10).collect()
