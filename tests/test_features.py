import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinelake.functions.channels import AUX_CHANNELS, CHANNELS
from kinelake.operators import features
from kinelake.operators import windows as w
from test_windows import loop_windows

LENGTH, STRIDE, RATE = 32, 16, 100.0


def plain_features(x):
    """The features of one window, straight from their definitions."""
    out = {}

    def stats(name, v, which=features.CHANNEL_STATS):
        values = {
            "mean": v.mean(), "std": v.std(), "min": v.min(), "max": v.max(),
            "range": v.max() - v.min(), "rms": np.sqrt((v * v).mean()),
        }
        out.update({f"{name}_{k}": values[k] for k in which})

    for i, c in enumerate(CHANNELS):
        stats(c, x[:, i])
    mag = np.sqrt((x[:, :3] ** 2).sum(1))
    stats("accel_mag", mag)
    stats("gyro_mag", np.sqrt((x[:, 3:] ** 2).sum(1)), ["mean", "std", "max"])
    jerk = np.abs(np.diff(mag)) * RATE
    out["jerk_mean_abs"], out["jerk_max_abs"] = jerk.mean(), jerk.max()
    tilt = np.degrees(np.arccos(np.clip(x[:, 2] / np.where(mag == 0, 1e-8, mag), -1, 1)))
    stats("tilt", tilt, ["mean", "std", "range"])
    out["sma"] = np.abs(x[:, :3]).sum(1).mean()
    power = np.abs(np.fft.rfft(mag - mag.mean()))[1:] ** 2
    total = power.sum()
    if total > 1e-20:
        p = power / total
        out["dominant_freq_hz"] = (np.argmax(power >= power.max() * (1 - 1e-9)) + 1) * RATE / len(x)
        out["spectral_entropy"] = -(p * np.log2(p + 1e-12)).sum()
    else:
        total, out["dominant_freq_hz"], out["spectral_entropy"] = 0.0, 0.0, 0.0
    out["spectral_energy"] = total
    return out


@pytest.fixture(scope="module")
def trials(spark):
    rng = np.random.default_rng(3)
    arrays = {k: rng.normal(size=(n, 6)) for k, n in enumerate([5, 32, 40, 90, 131])}
    arrays[5] = np.ones((50, 6))
    t = np.arange(64) / RATE
    arrays[6] = np.column_stack([np.zeros(64), np.zeros(64), 2 + np.sin(2 * np.pi * 12.5 * t)] + [np.zeros(64)] * 3)
    arrays[7] = np.zeros((40, 6))
    pdf = pd.concat(
        [pd.DataFrame(a, columns=CHANNELS).assign(k=k, frame=np.arange(len(a))) for k, a in arrays.items()]
    )
    series = spark.createDataFrame([(k, len(a)) for k, a in arrays.items()], "k long, n_frames long")
    return arrays, spark.createDataFrame(pdf).repartition(3), series


def padded(a, s, e):
    x = a[s:e]
    return np.vstack([x, np.repeat(x[-1:], LENGTH - len(x), axis=0)])


@pytest.mark.parametrize("size", [24, 65_536])
def test_all_features(trials, size):
    arrays, samples, series = trials
    got = features.window_features(samples, series, ["k"], LENGTH, STRIDE, RATE, size=size).toPandas()
    assert list(got.columns) == ["k", "window_index", *features.FEATURE_NAMES] and len(features.FEATURE_NAMES) == 54
    got = got.set_index(["k", "window_index"]).sort_index()
    want = {
        (k, i): plain_features(padded(a, s, e))
        for k, a in arrays.items()
        for i, (s, e) in enumerate(loop_windows(len(a), LENGTH, STRIDE))
    }
    assert len(got) == len(want)
    for key, expected in want.items():
        for name, value in expected.items():
            assert got.loc[key, name] == pytest.approx(value, rel=1e-9, abs=1e-9), (key, name)
    assert got.loc[(6, 0), "dominant_freq_hz"] == pytest.approx(12.5)


def test_features_batch_agrees(trials):
    _, samples, series = trials
    specs = w.window_specs(series, "n_frames", LENGTH, STRIDE).withColumn("label", F.lit(1))
    batch = features.features_batch(specs, samples, ["k"], LENGTH, RATE).toPandas().sort_values(["k", "window_index"])
    direct = features.window_features(samples, series, ["k"], LENGTH, STRIDE, RATE).toPandas()
    direct = direct.sort_values(["k", "window_index"])
    assert np.allclose(batch[features.FEATURE_NAMES], direct[features.FEATURE_NAMES], atol=1e-9)
    assert set(batch["label"]) == {1}


@pytest.mark.parametrize("size", [24, 65_536])
def test_auxiliary_both_ways(trials, size):
    arrays, samples, series = trials
    specs = w.window_specs(series, "n_frames", LENGTH, STRIDE).select("k", "window_index", "start_frame", "end_frame")
    rows = w.materialize_windows(specs, samples, ["k"], LENGTH)
    rolled = features.auxiliary_channels(rows, ["k", "window_index"], LENGTH, RATE)
    dense = features.augmented_windows(samples, series, ["k"], LENGTH, STRIDE, RATE, size=size)
    zipped = F.posexplode(F.arrays_zip(*CHANNELS, *AUX_CHANNELS)).alias("offset", "x")
    dense = dense.select("k", "window_index", zipped).select("k", "window_index", "offset", "x.*")
    for table in (rolled, dense):
        pdf = table.toPandas().sort_values(["k", "window_index", "offset"])
        assert pdf.groupby(["k", "window_index"]).ngroups == sum(len(loop_windows(len(a), LENGTH, STRIDE)) for a in arrays.values())
        for (k, i), g in pdf.groupby(["k", "window_index"]):
            s, e = loop_windows(len(arrays[k]), LENGTH, STRIDE)[i]
            x = padded(arrays[k], s, e)
            mag = np.sqrt((x[:, :3] ** 2).sum(1))
            tilt = np.degrees(np.arccos(np.clip(x[:, 2] / np.where(mag == 0, 1e-8, mag), -1, 1)))
            want = np.column_stack([x, mag, np.gradient(mag) * RATE, tilt])
            assert np.allclose(g[CHANNELS + AUX_CHANNELS].to_numpy(), want, atol=1e-9)


def test_one_sample_windows_refused(trials):
    _, samples, series = trials
    with pytest.raises(ValueError):
        features.augmented_windows(samples, series, ["k"], 1, 1)


def test_array_features_agree(trials):
    _, samples, series = trials
    rows = w.materialize_windows(w.window_specs(series, "n_frames", LENGTH, STRIDE).select("k", "window_index", "start_frame", "end_frame"), samples, ["k"], LENGTH)
    arrays = features.window_arrays(rows.filter("not is_pad"), ["k", "window_index"], CHANNELS)
    got = features.array_features(arrays, ["k", "window_index"], LENGTH, RATE).toPandas().sort_values(["k", "window_index"])
    want = features.window_features(samples, series, ["k"], LENGTH, STRIDE, RATE).toPandas().sort_values(["k", "window_index"])
    assert len(got) == len(want) and np.allclose(got[features.FEATURE_NAMES], want[features.FEATURE_NAMES], atol=1e-9)
    assert features.array_features(arrays.limit(0), ["k", "window_index"], LENGTH, RATE).count() == 0


@pytest.mark.parametrize("short", [0, LENGTH + 1])
def test_array_features_refuse_other_sizes(trials, short):
    spark = trials[1].sparkSession
    bad = spark.createDataFrame([(None, *[[1.0] * short] * 6)], "k int, " + ", ".join(f"{c} array<double>" for c in CHANNELS))
    with pytest.raises(Exception, match="six arrays of one size"):
        features.array_features(bad, ["k"], LENGTH, RATE).collect()


def test_one_window_is_scored(trials):
    from pyspark.ml.feature import SQLTransformer

    from kinelake.operators.windows import WindowConfig
    from kinelake.plans import detection

    spark = trials[1].sparkSession
    rule = SQLTransformer(statement="SELECT *, 1 / (1 + exp(-acc_x_mean)) AS fall_probability FROM __THIS__")
    config = WindowConfig(LENGTH / RATE, STRIDE / RATE, RATE)
    p, decided = detection.predict_window(spark, rule, [[2.0, 0, 0, 0, 0, 0]] * 3 + [[4.0, 0, 0, 0, 0, 0]], config)
    mean = (3 * 2.0 + 4.0 * (LENGTH - 3)) / LENGTH
    assert p == pytest.approx(1 / (1 + np.exp(-mean))) and decided == 1
    assert detection.predict_window(spark, rule, [[-1.0, 0, 0, 0, 0, 0]], config)[1] == 0
    with pytest.raises(ValueError, match="missing feature columns"):
        detection.predict_features(rule, trials[1])


def test_features_batch_shuffles_samples_once(trials, spark):
    """One exchange of samples, and a window that misses frames, or its last one, folds those it has, without padding."""
    _, samples, series = trials
    specs = w.window_specs(series, "n_frames", LENGTH, STRIDE).select("k", "window_index", "start_frame", "end_frame")
    holes = samples.filter("frame % 16 != 7 and not (k = 3 and frame between 40 and 89)")
    found = features.features_batch(specs, holes, ["k"], LENGTH, RATE)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 5 and "ArrowEvalPython" in plan
    got = found.toPandas().set_index(["k", "window_index"]).sort_index()
    rows = w.materialize_windows(specs, holes, ["k"], LENGTH)
    want = rows.groupBy("k", "window_index").agg(F.avg("acc_x").alias("acc_x_mean"), F.max("gyro_z").alias("gyro_z_max")).toPandas()
    want = want.set_index(["k", "window_index"]).sort_index()
    assert list(got.index) == list(want.index) and len(want) < specs.count()
    assert np.allclose(got[want.columns], want, atol=1e-12)


def test_spectrum_looks_at_its_total_once(spark):
    """Sum and top of the bins are no part of what runs per bin."""
    from kinelake.functions.spectrum import spectral_columns

    one = spark.createDataFrame([([0.0, 1.0, 3.0, 0.0],)], "p array<double>")
    cols = spectral_columns("p", F.lit(6), RATE)
    row = one.select(*[c.alias(n) for n, c in cols.items()]).first()
    assert row["dominant_freq_hz"] == pytest.approx(2 * RATE / 6) and row["spectral_energy"] == 4.0
    assert row["spectral_entropy"] == pytest.approx(-(0.25 * np.log2(0.25) + 0.75 * np.log2(0.75)))
    long = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(20_001)), lambda i: i * 1.0).alias("p"))
    began = time.perf_counter()
    assert long.select(*[c.alias(n) for n, c in cols.items()]).first()["spectral_energy"] == sum(range(2, 20_002))
    assert time.perf_counter() - began < 20


def test_windows_are_cut_before_columns_are_taken(trials):
    """Per window the plan handles its own samples, not each column of the whole block."""
    _, samples, series = trials
    dense = features.augmented_windows(samples, series, ["k"], LENGTH, STRIDE, RATE)
    plan = dense._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(_samples#" in plan and "slice(_all_" not in plan


def test_window_features_number_samples_once(trials):
    """Time features and spectra come from one pass over the samples."""
    from kinelake.operators.blocks import number_rows

    _, samples, series = trials
    numbered = number_rows(samples.withColumnRenamed("frame", "at"), ["k"], ["at"], F.col("at")).drop("at")
    found = features.window_features(numbered, series, ["k"], LENGTH, STRIDE, RATE)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("row_number()") == 1


def test_window_features_of_missing_values(trials):
    """Samples without a value, or with NaN, count as they do when Spark folds them."""
    _, samples, series = trials
    odd = samples.withColumn("acc_x", F.when(F.col("frame") % 7 != 3, F.col("acc_x")))
    odd = odd.withColumn("acc_z", F.when((F.col("k") == 3) & (F.col("frame") == 40), float("nan")).otherwise(F.col("acc_z")))
    odd = odd.withColumn("gyro_y", F.when(F.col("k") != 2, F.col("gyro_y")))
    found, want = (
        f(odd, series, ["k"], LENGTH, STRIDE, RATE).toPandas().sort_values(["k", "window_index"]) for f in (features.window_features, features.time_features)
    )
    names = features.FEATURE_NAMES[:-3]
    assert len(found) == len(want) and np.allclose(found[names].astype(float), want[names].astype(float), atol=1e-9, equal_nan=True)
    assert found["gyro_y_mean"].isna().any() and found["acc_z_mean"].isna().any()


def test_samples_of_a_manifest_are_found_by_their_path(spark, sf_dir):
    """Samples under the path of their trial alone: the four ids come from the windows, the subject's too, and lie beside no sample."""
    from kinelake.operators.catalog import MANIFEST_KEY
    from kinelake.plans.detection import predict
    from kinelake.queries.windowing import measured_catalog, predict_manifest, rule

    scored = predict_manifest(spark, sf_dir)
    sent = [line for line in scored._jdf.queryExecution().optimizedPlan().toString().splitlines() if "RepartitionByExpression [harmonized_path" in line]
    assert len(sent) == 1 and set(MANIFEST_KEY) < set(scored.columns)
    want = predict(rule(), *measured_catalog(spark, sf_dir))  # samples under the four ids
    columns = [*MANIFEST_KEY, "window_index", "label", "predicted"]
    assert sorted(map(tuple, scored.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
