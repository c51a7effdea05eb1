import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinelake.functions import filters, units
from kinelake.functions.channels import CHANNELS
from kinelake.operators import filtering, rotation, stationary, validate


def frames(spark, arrays, columns=CHANNELS, rate=100.0):
    pdf = pd.concat(
        [
            pd.DataFrame(a, columns=columns).assign(k=k, frame=np.arange(len(a)), time_s=0.25 + np.arange(len(a)) / rate)
            for k, a in arrays.items()
        ]
    )
    return spark.createDataFrame(pdf).repartition(3)


def loop_segment(x, n, var_thr, gyro_thr):
    if len(x) < n:
        return None
    quiet = np.zeros(len(x), bool)
    gyro = np.sqrt((x[:, 3:] ** 2).sum(1))
    for s in range(len(x) - n + 1):
        if np.isfinite(x[s : s + n]).all() and x[s : s + n, :3].var(axis=0).sum() < var_thr and gyro[s : s + n].mean() < gyro_thr:
            quiet[s : s + n] = True
    edges = np.flatnonzero(np.diff(np.r_[0, quiet.astype(int), 0]))
    runs = [(e - s, -s, s, e) for s, e in zip(edges[::2], edges[1::2])]
    return max(runs)[2:] if runs else None


@pytest.mark.parametrize("size", [32, 50, 65_536])
def test_stillness_matches_loop(spark, size):
    rng = np.random.default_rng(5)
    arrays = {}
    for k in range(30):
        x = rng.normal(scale=1.0, size=(rng.integers(5, 260), 6))
        for _ in range(3):
            s = rng.integers(0, len(x))
            x[s : s + rng.integers(5, 120)] *= 0.02
        arrays[k] = x
    arrays[30] = rng.normal(scale=0.01, size=(240, 6))
    for k, value in ((31, np.nan), (32, np.inf)):
        arrays[k] = rng.normal(scale=0.01, size=(240, 6))
        arrays[k][[0, 90], [1, 4]] = value
    n, var_thr, gyro_thr = 20, 0.01, 0.5
    got = stationary.stationary_segments(frames(spark, arrays), ["k"], 100.0, n / 100, var_thr, gyro_thr, size=size)
    got = {r["k"]: (r["start_frame"], r["end_frame"]) for r in got.collect()}
    want = {k: s for k, x in arrays.items() if (s := loop_segment(x, n, var_thr, gyro_thr)) is not None}
    assert len(want) > 10 and got == want


def test_filter_response():
    b, a = filters.butter_bandpass(4, 0.5, 20.0, 100.0)

    def power(hz):
        z = np.exp(2j * np.pi * hz / 100.0)
        return np.abs(np.polyval(b, z) / np.polyval(a, z)) ** 2

    assert power(0.5) == pytest.approx(0.5, abs=1e-6) and power(20.0) == pytest.approx(0.5, abs=1e-6)
    assert power(0.0) < 1e-12 and power(3.0) == pytest.approx(1.0, abs=1e-3) and power(30.0) < 0.01
    assert np.abs(np.roots(a)).max() < 1
    with pytest.raises(ValueError):
        filters.butter_bandpass(4, 0.5, 50.0, 100.0)


def loop_zero_phase(x, b, a, pad):
    """Direct recursion over one channel, forwards and backwards."""
    zi = filters.steady_state(b, a)

    def one_way(v):
        z, out = zi * v[0], np.empty_like(v)
        for i, u in enumerate(v):
            y = b[0] * u + z[0]
            z = np.r_[z[1:], 0.0] + b[1:] * u - a[1:] * y
            out[i] = y
        return out

    ext = np.r_[2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]
    return one_way(one_way(ext)[::-1])[::-1][pad:-pad]


def test_zero_phase_matches_recursion():
    rng = np.random.default_rng(7)
    b, a = filters.butter_bandpass(4, 0.5, 20.0, 100.0)
    impulse, settle = filters.responses(4, 0.5, 20.0, 100.0)
    for n in (28, 60, 700, 9000):
        x = rng.normal(size=n) + 1.0
        got = filters.zero_phase(x[:, None], impulse, settle, 27)[:, 0]
        assert np.allclose(got, loop_zero_phase(x, b, a, 27), atol=1e-7)
    with pytest.raises(ValueError):
        filters.zero_phase(np.ones((27, 1)), impulse, settle, 27)


def test_bandpass_keeps_the_band_and_the_phase(spark):
    t = np.arange(1000) / 100.0
    x = 0.5 * np.sin(2 * np.pi * 0.1 * t) + np.sin(2 * np.pi * 2 * t) + 0.3 * np.sin(2 * np.pi * 30 * t)
    spike = np.zeros(1000)
    spike[500:510] = 5 * np.sin(np.pi * np.arange(10) / 10)
    df = frames(spark, {0: np.column_stack([x, spike])}, ["value", "spike"])
    got = filtering.bandpass(df, ["k"], ["value", "spike"], 100.0).toPandas().sort_values("frame")
    middle = slice(200, 800)
    assert np.abs(got["value"].to_numpy() - np.sin(2 * np.pi * 2 * t))[middle].max() < 0.1
    assert got["spike"].max() > 0.7 * 5 and abs(int(got["spike"].argmax()) - 505) <= 1
    assert np.allclose(got["time_s"], 0.25 + t)


def test_bandpass_in_blocks(spark):
    rng = np.random.default_rng(8)
    arrays = {0: rng.normal(size=(30_000, 1)) + 1, 1: rng.normal(size=(100, 1)), 2: rng.normal(size=(12_010, 1))}
    df = frames(spark, arrays, ["v"])
    whole = filtering.bandpass(df, ["k"], ["v"], 100.0).toPandas().sort_values(["k", "frame"])
    parts = filtering.bandpass(df, ["k"], ["v"], 100.0, size=4000).toPandas().sort_values(["k", "frame"])
    assert len(parts) == len(whole) and np.abs(parts["v"].to_numpy() - whole["v"].to_numpy()).max() < 1e-8


def plain_resample(x, up, down):
    taps = filters.resample_taps(up, down)
    half = len(taps) // 2
    stuffed = np.zeros(len(x) * up)
    stuffed[::up] = x
    full = np.convolve(stuffed, taps)
    return full[half::down][: round(len(x) * up / down)]


@pytest.mark.parametrize("native,target", [(200.0, 100.0), (150.0, 100.0), (100.0, 30.0)])
def test_resample(spark, native, target):
    rng = np.random.default_rng(9)
    up, down = filters.resample_ratio(native, target)
    arrays = {k: rng.normal(size=(n, 2)) for k, n in enumerate([1, 5, 63, 64, 65, 200, 401])}
    df = frames(spark, arrays, ["p", "q"], native)
    for size in (64, 65_536):
        got = filtering.resample(df, ["k"], ["p", "q"], native, target, size=size).toPandas()
        for k, x in arrays.items():
            g = got[got["k"] == k].sort_values("frame")
            want = np.column_stack([plain_resample(x[:, i], up, down) for i in (0, 1)])
            assert list(g["frame"]) == list(range(len(want)))
            assert np.allclose(g[["p", "q"]], want, atol=1e-12)
            assert np.allclose(g["time_s"], 0.25 + np.arange(len(want)) / target)


def test_resample_keeps_5hz_drops_80hz(spark):
    t = np.arange(2000) / 200.0
    df = frames(spark, {0: np.column_stack([np.sin(2 * np.pi * 5 * t), np.sin(2 * np.pi * 80 * t)])}, ["low", "high"], 200.0)
    got = filtering.resample(df, ["k"], ["low", "high"], 200.0, 100.0).toPandas().sort_values("frame")
    assert len(got) == 1000
    assert np.allclose(got["low"][50:-50], np.sin(2 * np.pi * 5 * t[::2])[50:-50], atol=0.02)
    assert got["high"][50:-50].abs().max() < 0.05


def test_resample_refuses_up_and_leaves_equal(spark):
    df = frames(spark, {0: np.ones((40, 1))}, ["v"])
    assert filtering.resample(df, ["k"], ["v"], 100.0, 100.0) is df
    with pytest.raises(ValueError):
        filtering.resample(df, ["k"], ["v"], 50.0, 100.0)


def test_rotation(spark):
    rng = np.random.default_rng(10)
    vectors = [(0.0, 0.0, 1.0), (0.0, 0.0, -1.0), (1.0, 0.0, 0.0), (1e-9, 1e-9, -1.0), *map(tuple, rng.normal(size=(40, 3)))]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(vectors)], "i int, x double, y double, z double")
    for row in rotation.gravity_rotation(df, "x", "y", "z").collect():
        r = np.array([row[n] for n in rotation.ROTATION]).reshape(3, 3)
        v = np.array(vectors[row["i"]])
        assert np.allclose(r @ r.T, np.eye(3), atol=1e-9) and np.linalg.det(r) == pytest.approx(1.0)
        assert np.allclose(r @ (v / np.linalg.norm(v)), [0, 0, 1], atol=1e-8)
    zero = spark.createDataFrame([(0.0, 0.0, 0.0)], "x double, y double, z double")
    with pytest.raises(Exception, match="gravity"):
        rotation.gravity_rotation(zero, "x", "y", "z").collect()


def test_units(spark):
    raw = spark.createDataFrame([("SisFall", *[256] * 9)], ["dataset", *units.RAW_COLUMNS])
    row = units.convert_units(raw).first()
    assert row["acc_x"] == 1.0 and row["gyro_x"] == 256 * 4000 / 65536 and row["mma_acc_z"] == 0.25
    same = spark.createDataFrame([("kfall", *[0.5] * 6)], ["dataset", *CHANNELS])
    assert units.convert_units(same).first()["gyro_z"] == 0.5
    with pytest.raises(Exception, match="no unit conversion"):
        units.convert_units(same.withColumn("dataset", __import__("pyspark").sql.functions.lit("other"))).collect()


def test_each_validation_rule(spark):
    rng = np.random.default_rng(11)
    good = rng.normal(size=(300, 6))
    arrays = {k: good.copy() for k in range(12)}
    arrays[1][5, 0] = np.nan
    arrays[2][5, 4] = np.inf
    arrays[3][7, 2] = 25.0
    arrays[4][:, 1] = 0.3
    df = frames(spark, arrays)
    shift = __import__("pyspark").sql.functions
    df = df.withColumn("time_s", shift.expr("CASE WHEN k = 5 AND frame > 100 THEN time_s + 0.005 ELSE time_s END"))
    df = df.select("k", "frame", "time_s", *CHANNELS)
    meta = {
        6: ("adl", 100, 160), 7: ("fall", 100, None), 8: ("fall", 160, 160), 9: ("fall", 100, 301), 10: ("fall", 100, 300),
    }
    rows = [(k, k, "T09" if k == 11 else "T01", *meta.get(k, ("adl", None, None))) for k in arrays]
    trials = spark.createDataFrame(
        rows, "k long, s long, activity_code string, label string, fall_onset_frame int, fall_impact_frame int"
    )
    cal = spark.createDataFrame([(k, 0.0, 0.0, 1.5 if k == 0 else 1.0) for k in arrays], "s long, g_x double, g_y double, g_z double")
    cal = rotation.gravity_rotation(cal, "g_x", "g_y", "g_z")
    ranges = spark.createDataFrame([("T09", 5.0, 9.0)], "activity_code string, min_s double, max_s double")
    for size in (64, 65_536):
        found = validate.validate(df, trials, cal, ["k"], ["s"], 100.0, ranges, size=size).collect()
        codes = {r["k"]: r["issue_codes"] for r in found}
        assert codes == {
            0: ["gravity_vertical"], 1: ["nan"], 2: ["inf"], 3: ["range_acc_z"], 4: ["flat_acc_y"], 5: ["timing"],
            6: ["adl_frames"], 7: ["one_frame"], 8: ["frame_order"], 9: ["impact_late"], 10: [], 11: ["duration"],
        }
        assert {r["k"] for r in found if r["accepted"]} == {10}
    short = validate.validate(df.drop("gyro_z"), trials, cal, ["k"], ["s"], 100.0).filter("k = 10").first()
    assert short["issue_codes"] == ["schema"]
    wide = validate.validate(df.withColumn("euler_x", F.lit(0.0)), trials, cal, ["k"], ["s"], 100.0).filter("k = 10").first()
    assert wide["issue_codes"] == ["schema"] and "euler_x" in wide["issues"][0]
    mixed = df.select(*[c for c in df.columns if c != "acc_x"], "acc_x")
    assert validate.validate(mixed, trials, cal, ["k"], ["s"], 100.0).filter("k = 10").first()["issue_codes"] == ["schema"]
    more = trials.union(spark.createDataFrame([(77, 10, "T01", "adl", None, None)], trials.schema))
    lost = validate.validate(df, more, cal.filter("s <> 11"), ["k"], ["s"], 100.0).collect()
    codes = {r["k"]: (r["issue_codes"], r["accepted"], r["n_frames"]) for r in lost}
    assert codes[77] == (["no_samples"], False, 0) and codes[11][:2] == (["no_calibration"], False) and codes[10][1]


def test_samples_without_calibration_stay(spark):
    cal = rotation.gravity_rotation(spark.createDataFrame([(1, 0.0, 0.0, 1.0)], "s long, g_x double, g_y double, g_z double"), "g_x", "g_y", "g_z")
    rows = spark.createDataFrame([(k, float(k), 1.0, 2.0, 3.0, 4.0, 5.0) for k in (1, 2)], "s long, acc_x double, acc_y double, acc_z double, gyro_x double, gyro_y double, gyro_z double")
    got = {r["s"]: r["acc_z"] for r in rotation.rotate(rows, cal, ["s"]).collect()}
    assert got[1] == 2.0 and got[2] is None


def test_short_series_does_not_end_the_run(spark):
    rows = [(k, i, float(i % 7)) for k, n in ((1, 27), (2, 200)) for i in range(n)]
    got = filtering.bandpass(spark.createDataFrame(rows, "k long, frame long, acc_x double"), ["k"], ["acc_x"], 100.0).collect()
    assert len(got) == 227 and all((r["acc_x"] is None) == (r["k"] == 1) for r in got)
