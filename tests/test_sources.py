"""Readers, label sheets, the store and the full run, on files made here."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinelake.functions.channels import CHANNELS, HARMONIZED_COLUMNS
from kinelake.operators.catalog import MANIFEST_COLUMNS
from kinelake.operators.rotation import ROTATION
from kinelake.operators.windows import WindowConfig
from kinelake.plans import harmonize
from kinelake.plans.detection import features_batch
from kinelake.operators.windows import detection_windows
from kinelake.operators.catalog import detection_trials
from kinelake.sources import labels, naming, sensors, tables

HEADER = "TimeStamp(s),FrameCounter,AccX,AccY,AccZ,GyrX,GyrY,GyrZ,EulerX,EulerY,EulerZ"


def write_kfall(root, subject, name, n, still, seed):
    rng = np.random.default_rng(seed)
    tilt = np.array([0.3, 0.1, np.sqrt(1 - 0.1)])
    acc = tilt + rng.normal(scale=0.005 if still else 0.8, size=(n, 3))
    gyro = rng.normal(scale=0.3 if still else 60.0, size=(n, 3))
    folder = root / subject
    folder.mkdir(parents=True, exist_ok=True)
    rows = [
        ",".join([f"{i / 100:.2f}", str(i + 7), *(f"{v:.6f}" for v in [*acc[i], *gyro[i]]), "0", "0", "0"]) for i in range(n)
    ]
    (folder / name).write_text("\n".join([HEADER, *rows]) + "\n")
    return np.column_stack([acc, gyro])


@pytest.fixture(scope="module")
def kfall(tmp_path_factory):
    root = tmp_path_factory.mktemp("kfall")
    sensor = root / "sensor_data"
    data = {
        ("SA06", "T01", "R01"): write_kfall(sensor, "SA06", "S06T01R01.csv", 400, True, 1),
        ("SA06", "T22", "R01"): write_kfall(sensor, "SA06", "S06T22R01.csv", 320, False, 2),
        ("SA06", "T22", "R02"): write_kfall(sensor, "SA06", "S06T22R02.csv", 310, False, 3),
        ("SA07", "T06", "R01"): write_kfall(sensor, "SA07", "SA07T06R01.csv", 500, True, 4),
        ("SA07", "T05", "R01"): write_kfall(sensor, "SA07", "SA07T05R01.csv", 150, False, 5),
        ("SA08", "T05", "R01"): write_kfall(sensor, "SA08", "SA08T05R01.csv", 210, False, 6),
    }
    (sensor / "SA06" / "readme.csv").write_text("not,a,trial\n1,2,3\n")
    sheets = root / "label_data"
    sheets.mkdir()
    (sheets / "SA06_label.csv").write_text(
        "Task Code (Task ID),Description,Trial ID,Fall_onset_frame,Fall_impact_frame\n"
        "F01 (20),Forward fall,1,130,208\n,,2,140,\n,,2,1,2\nF02 (21),Backward fall,1,100,150\n"
    )
    return root, data


def test_read_kfall(spark, kfall):
    root, data = kfall
    samples = sensors.read_kfall(spark, str(root / "sensor_data"))
    pdf = samples.toPandas()
    assert {tuple(k) for k in pdf[["subject_id", "activity_code", "trial_id"]].drop_duplicates().values} == set(data)
    for (s, a, t), want in data.items():
        g = pdf[(pdf.subject_id == s) & (pdf.activity_code == a) & (pdf.trial_id == t)].sort_values("frame")
        assert list(g["frame"]) == list(range(len(want)))
        assert np.allclose(g[CHANNELS], want, atol=1e-6) and np.allclose(g["time_s"], np.arange(len(want)) / 100)


def test_missing_column_is_an_error(spark, tmp_path):
    folder = tmp_path / "SA01"
    folder.mkdir()
    (folder / "SA01T01R01.csv").write_text("TimeStamp(s),FrameCounter,AccX\n0,1,2\n")
    with pytest.raises(ValueError, match="missing sensor columns"):
        sensors.read_kfall(spark, str(tmp_path))


def test_labels(spark, kfall):
    root, _ = kfall
    _, trials = sensors.load_trials(spark, "kfall", str(root / "sensor_data"), labels.read_labels(spark, str(root / "label_data")))
    rows = {(r.subject_id, r.activity_code, r.trial_id): r for r in trials.collect()}
    first, second = rows[("SA06", "T22", "R01")], rows[("SA06", "T22", "R02")]
    assert (first.fall_onset_frame, first.fall_impact_frame, first.label) == (130, 208, "fall")
    # The first of two matching rows counts, and its impact is blank.
    assert (second.fall_onset_frame, second.fall_impact_frame) == (140, None)
    quiet = rows[("SA07", "T06", "R01")]
    assert (quiet.fall_onset_frame, quiet.label, quiet.n_frames, quiet.native_rate_hz) == (None, "adl", 500, 100.0)


def test_sheets_with_headers_of_their_own(spark, tmp_path):
    """Columns in other orders and under other names, one sheet without onsets, quotes, blank cells and lines."""
    (tmp_path / "SA06_label.csv").write_text("Task Code (Task ID),Description,Trial ID,Fall_onset_frame,Fall_impact_frame\nF01 (20),\"Forward, slip\",1,100,150\n,,2,110,161\n")
    (tmp_path / "SA07_label.csv").write_text("Impact frame,Onset frame,Trial,TASK\r\n90,70,1,F02 (21)\r\n\r\n95,72,2,\r\n,,3,\r\n")
    (tmp_path / "SA08_label.csv").write_text("note,Trial no,impact,Fall description,onset,My task,extra\nx,4,12,\"a, b\",7,T05,z\n")
    (tmp_path / "SA09_label.csv").write_text("Task,Comment\nT01,no frames here\n")
    (tmp_path / "SA10_label.csv").write_text("")
    got = [tuple(r) for r in labels.read_labels(spark, str(tmp_path)).orderBy("subject_id", "row_no").select("subject_id", "task_id", "repetition", "onset", "impact", "row_no").collect()]
    assert got == [
        ("SA06", 22, 1, 100, 150, 1), ("SA06", 22, 2, 110, 161, 2),
        ("SA07", 23, 1, 70, 90, 1), ("SA07", 23, 2, 72, 95, 3), ("SA07", 23, 3, None, None, 4), ("SA08", 5, 4, 7, 12, 1),
    ]


def test_sheets_without_the_columns_label_nothing(spark, tmp_path):
    (tmp_path / "SA06_label.csv").write_text("Name,Trial ID\nx,1\n")
    assert labels.read_labels(spark, str(tmp_path)).count() == 0
    filled = spark.createDataFrame([("SA06", 22, 0)], "subject_id string, resolved_task_id int, row_no long")
    assert labels.standard_labels(filled).count() == 0


@pytest.mark.parametrize("code", ["F01 (22)", "X1", "", None, "T22a"])
def test_bad_task_codes(spark, code):
    df = spark.createDataFrame([(code,)], "c string")
    assert df.select(labels.try_task_id(F.col("c"))).first()[0] is None
    with pytest.raises(Exception):
        df.select(labels.resolve_task_id(F.col("c"))).collect()


@pytest.mark.parametrize("code,task", [("T22", 22), ("t07", 7), ("F01 (20)", 22), (" f15(34) ", 36)])
def test_good_task_codes(spark, code, task):
    assert spark.createDataFrame([(code,)], "c string").select(labels.resolve_task_id(F.col("c"))).first()[0] == task


def test_bad_file_name_is_an_error(spark):
    df = spark.createDataFrame([("/x/notes.txt",)], "p string")
    for keys in (naming.with_kfall_keys, naming.with_sisfall_keys):
        with pytest.raises(Exception, match="trial pattern"):
            keys(df, "p").collect()


def write_sisfall(root, subject, name, rows):
    folder = root / subject
    folder.mkdir(parents=True, exist_ok=True)
    lines = [",".join(f"{v:5d}" for v in row) + ";" for row in rows]
    (folder / name).write_text("\n".join(lines) + "\n\n")


@pytest.fixture(scope="module")
def sisfall(tmp_path_factory):
    root = tmp_path_factory.mktemp("sisfall")
    rng = np.random.default_rng(6)
    moving = {k: rng.integers(-900, 900, size=(n, 9)) for k, n in {"D01": 200, "F01": 300, "D02": 150}.items()}
    still = np.column_stack([rng.integers(-1, 2, 500), rng.integers(-1, 2, 500), 256 + rng.integers(-1, 2, 500), *rng.integers(-2, 3, (6, 500))])
    write_sisfall(root, "SA01", "D01_SA01_R01.txt", moving["D01"])
    write_sisfall(root, "SA01", "F01_SA01_R01.txt", moving["F01"])
    write_sisfall(root, "SA02", "D02_SA02_R01.txt", moving["D02"])
    write_sisfall(root, "SA02", "D07_SA02_R01.txt", still)
    (root / "SA01" / "notes.txt").write_text("ignore\n")
    (root / "Readme.txt").write_text("ignore\n")
    return root, moving | {"D07": still}


def test_read_sisfall(spark, sisfall):
    root, data = sisfall
    pdf = sensors.read_sisfall(spark, str(root)).toPandas()
    assert pdf.groupby("activity_code").size().to_dict() == {k: len(v) for k, v in data.items()}
    for code, want in data.items():
        g = pdf[pdf.activity_code == code].sort_values("frame")
        assert (g[[c for c in g.columns if c.startswith("raw_")]].to_numpy() == want).all()
        assert np.allclose(g["time_s"], np.arange(len(want)) / 200)


def test_file_in_many_splits_keeps_its_order(spark, sisfall):
    root, data = sisfall
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = sensors.read_sisfall(spark, str(root))
        assert lines.rdd.getNumPartitions() >= 1
        pdf = lines.filter("activity_code = 'D07'").toPandas().sort_values("frame")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert list(pdf["frame"]) == list(range(500))
    assert (pdf["raw_adxl_acc_z"].to_numpy() == data["D07"][:, 2]).all()


@pytest.mark.parametrize("line", ["1,2,3,4,5;", "1,2,3,4,5,6,7,8,x;", "1,2,3,4,5,6,7,8,9.5;", "1,2,3,4,5,6,7,8,9,10;"])
def test_bad_lines(spark, line):
    df = spark.createDataFrame([(line, "f.txt"), ("  1, 2,3,4,5,6,7,8, -9 ;", "f.txt"), ("  ", "f.txt")], "value string, source_path string")
    with pytest.raises(Exception, match="expected 9 whole numbers"):
        sensors.parse_sisfall_lines(df).collect()
    assert [tuple(r)[:2] for r in sensors.unreadable_lines(df).collect()] == [("f.txt", 1)]


def test_unknown_dataset(spark):
    with pytest.raises(ValueError):
        sensors.load_trials(spark, "other", "/nowhere")


def test_run_kfall(spark, kfall, tmp_path):
    root, data = kfall
    sheet = labels.read_labels(spark, str(root / "label_data"))
    store, manifest = str(tmp_path / "store"), str(tmp_path / "manifest")
    summary = harmonize.run_harmonization(spark, "kfall", str(root / "sensor_data"), store, sheet, manifest).first()
    assert summary.n_trials_total == 6 and summary.n_written + summary.n_quarantined == 6
    assert summary.calibration_source_counts == {"T01": 1, "auto_detected": 1, "group_fallback": 1}
    rows = tables.load_manifest(spark, manifest)
    assert rows.columns == MANIFEST_COLUMNS
    bad = rows.filter("not accepted").select("activity_code", "trial_id").collect()
    assert [tuple(r) for r in bad] == [("T22", "R02")]  # onset without impact
    accepted = tables.read_harmonized(spark, f"{store}/samples", columns=HARMONIZED_COLUMNS)
    assert accepted.select("subject_id", "activity_code", "trial_id").distinct().count() == 5
    assert tables.read_harmonized(spark, f"{store}/samples", accepted=False).count() == 310
    # Gravity is gone after the band-pass.
    quiet = accepted.filter("activity_code = 'T01'").agg(F.max(F.abs("acc_z"))).first()[0]
    assert quiet < 0.1
    record = spark.read.parquet(f"{store}/provenance").filter("trial_id = 'R02'").first()
    assert not record.accepted and "onset" in record.issues[0] and '"filter_order":4' in record.record
    # A second run replaces its own rows.
    harmonize.run_harmonization(spark, "kfall", str(root / "sensor_data"), store, sheet, manifest)
    assert tables.load_manifest(spark, manifest).count() == 6
    accepted = tables.read_harmonized(spark, f"{store}/samples")
    assert accepted.select("subject_id", "activity_code", "trial_id").distinct().count() == 5
    windows = detection_windows(detection_trials(tables.load_manifest(spark, manifest)))
    found = features_batch(windows, accepted, sensors.TRIAL_KEYS, 200, 100.0)
    assert found.count() == windows.count() > 5


def test_run_sisfall(spark, sisfall, tmp_path):
    root, _ = sisfall
    store = str(tmp_path / "store")
    summary = harmonize.run_harmonization(spark, "sisfall", str(root), store, manifest_path=str(tmp_path / "m")).first()
    assert summary.n_trials_total == 4
    assert summary.calibration_source_counts == {"auto_detected": 1, "group_fallback": 1}
    rows = {r.activity_code: r for r in tables.load_manifest(spark, str(tmp_path / "m")).collect()}
    assert rows["D07"].duration_s == 2.5 and rows["F01"].duration_s == 1.5 and rows["F01"].label == "fall"
    assert rows["D07"].sample_rate_hz == 100.0


def test_harmonize_is_its_steps(spark, kfall):
    from kinelake.functions import filters

    root, data = kfall
    samples, trials = sensors.load_trials(spark, "kfall", str(root / "sensor_data"))
    cal = harmonize.resolve_calibrations(samples, trials, 100.0, harmonize.CALIBRATION["kfall"]).persist()
    got = harmonize.harmonize(samples, cal, 100.0).toPandas()
    impulse, settle = filters.responses(4, 0.5, 20.0, 100.0)
    for r in cal.collect():
        rot = np.array([r[n] for n in ROTATION]).reshape(3, 3)
        for (s, a, t), x in data.items():
            if s != r.subject_id:
                continue
            turned = np.column_stack([np.round(x, 6)[:, :3] @ rot.T, np.round(x, 6)[:, 3:] @ rot.T])
            want = filters.zero_phase(turned, impulse, settle, 27)
            g = got[(got.subject_id == s) & (got.activity_code == a) & (got.trial_id == t)].sort_values("frame")
            assert np.allclose(g[CHANNELS], want, atol=1e-6)


def test_manifest_keeps_other_rows(spark, tmp_path):
    def rows(ids, seconds):
        return spark.createDataFrame(
            [("kfall", "SA06", "T01", i, "adl", seconds, 100.0, True, "T01", "p", None, None) for i in ids],
            "dataset string, subject_id string, activity_code string, trial_id string, label string, duration_s double, "
            "sample_rate_hz double, accepted boolean, calibration_source string, harmonized_path string, "
            "fall_onset_frame int, fall_impact_frame int",
        )

    path = str(tmp_path / "m")
    tables.write_manifest(rows(["R01", "R02"], 1.0), path)
    tables.write_manifest(rows(["R02", "R03", "R03"], 2.0), path)
    got = tables.load_manifest(spark, path).select("trial_id", "duration_s").collect()
    assert sorted(map(tuple, got)) == [("R01", 1.0), ("R02", 2.0), ("R03", 2.0), ("R03", 2.0)]


def test_cache_recompute(spark, tmp_path):
    path = str(tmp_path / "c")
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "x double, dataset string")
    assert tables.cache_features(df.filter("dataset = 'a'"), path).count() == 1
    assert tables.cache_features(df.withColumn("x", F.lit(9.0)), path).agg(F.sum("x")).first()[0] == 10.0
    assert tables.cache_features(df.withColumn("x", F.lit(5.0)), path, recompute=True).agg(F.sum("x")).first()[0] == 10.0


def test_window_config():
    assert pd.Series([WindowConfig(1.0, 0.1).stride]).tolist() == [10]


def test_store_adds_beside_what_is_stored(spark, tmp_path):
    """A second batch of a dataset leaves the first; a trial that comes again is replaced, accepted or not."""
    schema = "dataset string, subject_id string, activity_code string, trial_id string, frame long, acc_x double"
    def batch(subject, trial, value, n=3):
        return spark.createDataFrame([("kfall", subject, "T01", trial, i, value) for i in range(n)], schema)

    def verdict(rows, accepted):
        return rows.select(*tables.TRIAL_KEYS).distinct().withColumn("accepted", F.lit(accepted))

    root = str(tmp_path / "samples")
    for rows, accepted in ((batch("SA06", "R01", 1.0), False), (batch("SA07", "R01", 2.0), True), (batch("SA06", "R02", 3.0), True), (batch("SA06", "R01", 4.0, 2), True)):
        tables.write_harmonized(rows, verdict(rows, accepted), root, "kfall")
    held = {(r.subject_id, r.trial_id): (r.n, r.v) for r in tables.read_harmonized(spark, root, True, ["acc_x"]).groupBy("subject_id", "trial_id").agg(F.count("*").alias("n"), F.max("acc_x").alias("v")).collect()}
    assert held == {("SA06", "R01"): (2, 4.0), ("SA06", "R02"): (3, 3.0), ("SA07", "R01"): (3, 2.0)}
    assert tables.read_harmonized(spark, root, False, ["acc_x"]).count() == 0


def test_cache_returns_what_was_asked(spark, tmp_path):
    rows = spark.createDataFrame([("kfall", 1.0), ("sisfall", 2.0)], "dataset string, x double").select("x", "dataset")
    tables.cache_features(rows, str(tmp_path / "cache"))
    assert [r.dataset for r in tables.cache_features(rows.filter("dataset = 'kfall'"), str(tmp_path / "cache")).collect()] == ["kfall"]


def test_upsert_works_out_its_rows_once(spark, tmp_path):
    """Rows that replace stored ones pass through their plan once; trials without new rows stay."""
    seen = spark.sparkContext.accumulator(0)
    schema = "dataset string, subject_id string, activity_code string, trial_id string, frame long"

    def rows(low, high):
        def counted(frames):
            for f in frames:
                seen.add(len(f))
                yield f

        made = spark.range(low, high).selectExpr("'kfall' dataset", "'SA1' subject_id", "'T1' activity_code", "concat('R', id) trial_id", "id frame")
        return made.mapInPandas(counted, schema)

    for low, high, whole in ((0, 6, 6), (4, 9, 9)):
        seen.value = 0
        tables.upsert(rows(low, high), str(tmp_path / "store"))
        assert seen.value == high - low
        assert spark.read.parquet(str(tmp_path / "store")).count() == whole
