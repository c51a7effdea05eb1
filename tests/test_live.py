"""The stream must agree with the batch operators, however its batches are cut."""

import json
import os
import sys
import time

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from kinelake.functions.channels import CHANNELS
from kinelake.operators import alerts
from kinelake.streaming import live

cloudpickle.register_pickle_by_value(sys.modules[__name__])
LENGTH, STRIDE = 20, 5


def scorer(batch):
    return np.column_stack([batch[:, :, 6].mean(axis=1), batch[:, :, 0].max(axis=1), batch[:, :, 8].mean(axis=1) / 60.0])


@pytest.fixture(scope="module")
def recorded(tmp_path_factory):
    rng = np.random.default_rng(21)
    data = {"w1": rng.normal(size=(97, 6)), "w2": rng.normal(size=(60, 6)), "w3": rng.normal(size=(7, 6))}
    folder = tmp_path_factory.mktemp("incoming")

    def sample(d, i):
        return {"device": d, "seq": i, **dict(zip(CHANNELS, map(float, data[d][i])))}

    number = 0
    for lo in range(0, 97, 13):
        items = [sample(d, i) for d in data for i in range(lo, min(lo + 13, len(data[d])))]
        rng.shuffle(items)
        if lo == 26:
            items += [sample("w1", 0), sample("w2", 30)]  # late and repeated
            items.append({"device": "w1", "seq": 500, "acc_x": 1.0})  # incomplete
        (folder / f"s{number:03d}.json").write_text(json.dumps(items))
        number += 1
    (folder / "s003b.json").write_text("{not json")
    (folder / "s004b.json").write_text(json.dumps(sample("w3", 6), indent=1))  # one object over many lines, seen before
    for age, path in enumerate(sorted(folder.iterdir())):
        os.utime(path, (1_700_000_000 + age, 1_700_000_000 + age))
    return folder, data


def expected(spark, data):
    rows = []
    for d, x in data.items():
        starts = range(0, len(x) - LENGTH + 1, STRIDE)
        if len(starts):
            views = np.stack([live.augment(x[s : s + LENGTH], 100.0) for s in starts])
            rows += [(d, i, *map(float, p)) for i, p in enumerate(live.softmax_rows(scorer(views)))]
    df = spark.createDataFrame(rows, "device string, window_index long, p_non_fall double, p_pre_impact double, p_fall double")
    return {(r.device, r.window_index): (r.state, r.p_fall) for r in alerts.smooth_alerts(df, ["device"]).collect()}


@pytest.mark.parametrize("files", [3, 100])
def test_stream_equals_batch(spark, recorded, tmp_path, files):
    folder, data = recorded
    live.use_rocksdb(spark)
    stream = live.well_formed(live.read_sample_stream(spark, str(folder), files_per_trigger=files))
    scored = live.score_stream(stream, scorer, LENGTH, STRIDE)
    out = live.run_to_table(scored, str(tmp_path / "out"), str(tmp_path / "cp"))
    rows = out.collect()
    got = {(r.device, r.window_index): (r.state, r.p_fall) for r in rows if r.window_ready}
    want = expected(spark, data)
    assert set(got) == set(want)
    for k in want:
        assert got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1])
    for d, x in data.items():
        filling = [(r.seq, r.buffered_samples) for r in rows if r.device == d and r.state == "buffering"]
        assert sorted(filling) == [(i, i + 1) for i in range(min(len(x), LENGTH - 1))]
    assert all(r.buffered_samples == LENGTH for r in rows if r.window_ready)
    assert sorted((r.device, r.seq) for r in rows if r.state == "rejected") == [("w1", 0), ("w2", 30), ("w3", 6)]


def test_any_order_of_files_gives_the_same(spark, recorded, tmp_path):
    """Files in shuffled order, one per batch: held back, scored in order, closed by end marks."""
    folder, data = recorded
    live.use_rocksdb(spark)
    incoming = tmp_path / "incoming"
    incoming.mkdir()
    files = sorted(folder.iterdir())
    np.random.default_rng(5).shuffle(files)
    for age, f in enumerate(files):
        (incoming / f.name).write_text(f.read_text())
        os.utime(incoming / f.name, (1_700_000_000 + age, 1_700_000_000 + age))

    def run():
        stream = live.well_formed(live.read_sample_stream(spark, str(incoming), files_per_trigger=4))
        return live.run_to_table(live.score_stream(stream, scorer, LENGTH, STRIDE, lateness=1000), str(tmp_path / "out"), str(tmp_path / "cp"))

    assert run().filter("window_ready").count() == 0  # all within the lateness
    (incoming / "zend.json").write_text(json.dumps([{"device": d, "seq": len(x), "end": True} for d, x in data.items()]))
    rows = run().collect()
    got = {(r.device, r.window_index): r.state for r in rows if r.window_ready}
    assert got == {k: v[0] for k, v in expected(spark, data).items()}
    assert sorted((r.device, r.seq) for r in rows if r.state == "rejected") == [("w1", 0), ("w2", 30), ("w3", 6)]
    (incoming / "zlate.json").write_text(json.dumps([{"device": "w1", "seq": 40.5, **dict.fromkeys(CHANNELS, 1)}, {"device": "w1", "seq": -7, **dict.fromkeys(CHANNELS, 1)}]))
    late = [r for r in run().collect() if r.state == "rejected" and r.seq == -7]
    assert len(late) == 1


def test_end_mark_starts_afresh(spark, tmp_path):
    """Samples after an end mark fill a new window: neither buffer nor average leaks over."""
    live.use_rocksdb(spark)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 6))
    one = [{"device": "d", "seq": i, **dict(zip(CHANNELS, map(float, v)))} for i, v in enumerate(x)]
    items = one[:30] + [{"device": "d", "seq": 30, "end": True}] + [{**s, "seq": s["seq"] + 1} for s in one[30:]]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(items))
    stream = live.well_formed(live.read_sample_stream(spark, str(tmp_path / "in")))
    scored = live.score_stream(stream, scorer, LENGTH, STRIDE)
    rows = live.run_to_table(scored, str(tmp_path / "out"), str(tmp_path / "cp")).collect()
    got = sorted((r.seq, r.p_fall) for r in rows if r.window_ready)
    want = [(k + s + LENGTH - 1 + (k > 0), live.softmax_rows(scorer(live.augment(x[k + s : k + s + LENGTH], 100.0)[None]))[0, 2]) for k in (0, 30) for s in (0, 5, 10)]
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want])


def test_samples_without_device_and_number(spark, tmp_path):
    """Six channels alone: order by file name and place, numbers as text, bad neighbours rejected one by one."""
    good = dict(zip(CHANNELS, (1, "2.5", -3, 0.0, "4e-1", 7)))
    (tmp_path / "sample_00002.json").write_text(json.dumps([good, {**good, "acc_y": None}, 5, {**good, "acc_x": "up"}, {**good, "acc_x": 9}]))
    (tmp_path / "sample_00010.json").write_text(json.dumps({**good, "acc_x": 10}))
    (tmp_path / "sample_00011.json").write_text("[]")
    (tmp_path / "sample_00012.json").write_text("")
    place = {"source_file": F.col("_metadata.file_name"), "modified": F.col("_metadata.file_modification_time")}
    rows = live.parse_samples(spark.read.text(str(tmp_path), wholetext=True).withColumns(place))
    kept = live.well_formed(rows).orderBy("source_file", "place").collect()
    assert [r.acc_x for r in kept] == [1.0, 9.0, 10.0] and {r.device for r in kept} == {"default"} and kept[0].acc_y == 2.5
    assert sorted(r.problem for r in live.rejects(rows).collect() if r.source_file == "sample_00002.json") == ["acc_x", "acc_y", "not an object"]


def test_places_of_a_long_array(spark):
    """An array beyond 2**20 elements keeps its places; numbers are no longer packed with the file's."""
    n = (1 << 20) + 5
    files = spark.createDataFrame([("[" + ",".join(["7"] * n) + "]", "a.json", None)], "value string, source_file string, modified timestamp")
    rows = live.parse_samples(files).agg(F.count("*"), F.max("place"), F.countDistinct("place"), F.max("seq")).first()
    assert tuple(rows) == (n, n - 1, n, None)


@pytest.mark.parametrize("at_once", [500, 100])
def test_waiting_is_bounded_and_batches_do_not_matter(spark, tmp_path, at_once):
    """A session of 40 slices in 500 files: the same rows, and few samples held, however the files are taken."""
    live.use_rocksdb(spark)
    rng, lateness = np.random.default_rng(8), 300
    n = 5000
    seq = np.argsort(np.arange(n) + rng.integers(0, lateness // 2, n), kind="stable")  # displaced by less than the lateness
    x = rng.normal(size=(n, 6))
    folder = tmp_path / "in"
    folder.mkdir()
    for f in range(500):
        items = [{"device": "d", "seq": 40 * int(i), **dict(zip(CHANNELS, map(float, x[i])))} for i in seq[f * 10 : f * 10 + 10]]
        (folder / f"f{f:04d}.json").write_text(json.dumps(items))
        os.utime(folder / f"f{f:04d}.json", (1_700_000_000 + f, 1_700_000_000 + f))
    stream = live.well_formed(live.read_sample_stream(spark, str(folder), files_per_trigger=at_once))
    scored = live.score_stream(stream, scorer, LENGTH, STRIDE, lateness=40 * lateness, report=True)
    rows = live.run_to_table(scored, str(tmp_path / "out"), str(tmp_path / "cp")).collect()
    waiting = [r.buffered_samples for r in rows if r.state == "held"]
    assert len(waiting) == 500 // at_once and max(waiting) <= lateness + 1
    assert not [r for r in rows if r.state == "rejected"]
    got = sorted((r.window_index, r.seq, r.p_fall) for r in rows if r.window_ready)
    due = n - 1 - lateness
    starts = range(0, due + 2 - LENGTH, STRIDE)
    views = np.stack([live.augment(x[s : s + LENGTH], 100.0) for s in starts])
    want = live.softmax_rows(scorer(views))[:, 2]
    assert [g[:2] for g in got] == [(i, 40 * (s + LENGTH - 1)) for i, s in enumerate(starts)]
    assert np.allclose([g[2] for g in got], want)


def test_memory_of_one_call_is_bounded(monkeypatch):
    """Rows beyond the limit move to the store while they come, and come back slice by slice, in order."""

    class Store(dict):
        updateValue = dict.__setitem__
        getValue = dict.__getitem__
        removeKey = dict.__delitem__

    store = Store()
    held = live.Held(store, [], 100, 64)
    order = np.random.default_rng(2).permutation(1000).astype(np.int64)
    for part in np.array_split(order, 50):
        held.put(np.column_stack([part.view(np.float64), part.view(np.float64), np.zeros((len(part), 7))]))
        assert held.count <= 64 + len(part)
    assert held.slices() == list(range(10)) and len(store) == 10
    taken = [live.Held.orders(held.take(s)) for s in held.slices()]
    assert np.array_equal(np.concatenate(taken), np.arange(1000)) and not store and held.count == 0


def test_current_state(spark, recorded, tmp_path):
    folder, data = recorded
    live.use_rocksdb(spark)
    stream = live.well_formed(live.read_sample_stream(spark, str(folder), files_per_trigger=4))
    scored = live.score_stream(stream, scorer, LENGTH, STRIDE)
    live.write_state(scored, str(tmp_path / "state"), str(tmp_path / "cp"), availableNow=True).awaitTermination()
    got = {r.device: r for r in live.read_state(spark, str(tmp_path / "state")).collect()}
    want = expected(spark, data)
    for d in ("w1", "w2"):
        last = max(i for k, i in want if k == d)
        assert (got[d].window_index, got[d].state) == (last, want[(d, last)][0])
    assert got["w3"].state == "buffering" and got["w3"].buffered_samples == 7


def test_rejects(spark, recorded):
    folder, _ = recorded
    place = {"source_file": F.col("_metadata.file_name"), "modified": F.col("_metadata.file_modification_time")}
    rows = live.parse_samples(spark.read.text(str(folder), wholetext=True).withColumns(place))
    bad = [(r.source_file, r.problem) for r in live.rejects(rows).collect()]
    assert sorted(bad) == [("s002.json", ",".join(CHANNELS[1:])), ("s003b.json", "unreadable file")]
    assert live.well_formed(rows).filter(F.col("seq") == 500).count() == 0


def test_lines_of_a_file_are_judged_alone(spark):
    """A file of many arrays, a line each: a broken line costs itself alone, and places go on from line to line."""
    good = dict(zip(CHANNELS, range(6)))
    text = json.dumps([good, 5]) + "\n\n{not json\r\n" + json.dumps({**good, "acc_x": 9}) + "\n" + json.dumps([good])
    files = spark.createDataFrame([(text, "a", None)], "value string, source_file string, modified timestamp")
    rows = live.parse_samples(files, lines=True)
    assert [r.acc_x for r in live.well_formed(rows).orderBy("place").collect()] == [0.0, 9.0, 0.0]
    assert sorted(r.problem for r in live.rejects(rows).collect()) == ["not an object", "unreadable file"]


def test_a_long_session_is_scored_in_lots():
    """Windows are scored many at a time and rows come out in few frames: 50,000 samples take seconds."""

    class Value:
        stored = None

        def get(self):
            return self.stored

        def update(self, value):
            self.stored = value

    n, calls = 50_000, []
    processor = live.LiveScorer(lambda b: calls.append(len(b)) or scorer(b), "device", 2, 1, 100.0, live.SmootherConfig(), 0, None)
    processor.state, processor.held, processor.handle = Value(), None, None
    processor.rows_at_once = 2 * n
    x = np.random.default_rng(3).normal(size=(n, 6))
    frame = pd.DataFrame({"seq": np.nan, **dict(zip(CHANNELS, x.T)), "ends": False, "source_file": "a", "place": np.arange(n)})
    began = time.process_time()
    out = list(processor.handleInputRows(("d",), iter([frame]), None))
    assert time.process_time() - began < 3
    assert sum(map(len, out)) == n and sum(calls) == n - 1 and len(out) <= 2 + n // 1024
    assert [int(s) for f in out for s in f["seq"]] == list(range(n))


@pytest.mark.parametrize("part", [live.rejects, live.well_formed])
def test_an_object_is_read_once_also_under_a_filter(spark, part):
    files = spark.createDataFrame([('[{"device": "a"}, 7, null]', "f", None), ("[]", "g", None), ("{not", "h", None)], "value string, source_file string, modified timestamp")
    samples = live.parse_samples(files)
    plan = part(samples)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(MapType") == 1
    found = {(r["source_file"], r["place"]): r["problem"] for r in live.rejects(samples).collect()}
    assert found == {("f", 0): ",".join(live.CHANNELS), ("f", 1): "not an object", ("f", 2): "not an object", ("g", None): "not an object", ("h", None): "unreadable file"}


def test_samples_are_sent_packed(spark):
    """A device's samples reach the stateful step in few rows, with all they hold: long numbers, missing ones, missing names."""
    rows = [("a" if i % 3 else None, (1 << 60) + i if i % 5 else None, *[float(i)] * 6, i % 7 == 0, f"f{i % 4}" if i % 11 else None, i) for i in range(2000)]
    names = ["device", "seq", *CHANNELS, "ends", "source_file", "place"]
    types = ["string", "long", *["double"] * 6, "boolean", "string", "long"]
    samples = spark.createDataFrame(rows, ", ".join(map(" ".join, zip(names, types)))).coalesce(1)
    packed = live.pack_samples(samples, "device").toPandas()
    assert len(packed) == 2
    got = []
    for device, frame in packed.groupby("device", dropna=False):
        files = {}
        for part, blank in live.unpacked(iter([frame]), files, 100_000):
            name = {n: f for f, n in files.items()}
            seq = np.ascontiguousarray(part[:, 2]).view(np.int64)
            for s, none, x in zip(seq.tolist(), blank, part.tolist()):
                key = "a" if device == "a" else None
                got.append((key, None if none else s, *x[3:9], x[9] > 0, *((name[int(x[0])], int(x[1])) if none else (None, 0))))
    want = [r if r[1] is None else (*r[:-2], None, 0) for r in rows]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_rows_in_memory_are_taken_at_once():
    """All that is due, in the order and with the repeats that slice by slice would give; the rest stays."""
    rng = np.random.default_rng(4)
    at, seq = rng.integers(0, 5000, 900), rng.integers(0, 3, 900)
    rows = np.column_stack([at.view(np.float64), seq.view(np.float64), np.arange(900.0), np.zeros((900, 6))])
    once, each = (live.Held({}, [], 10, 10_000) for _ in range(2))
    once.put(rows)
    each.put(rows)
    assert once.first() == at.min() // 10
    taken = np.vstack([each.take(n) for n in each.slices() if n < 300])
    assert np.array_equal(once.take_near(2999), taken) and once.count == each.count == (at >= 3000).sum()
    assert np.array_equal(once.take_near(5000), np.vstack([each.take(n) for n in each.slices()])) and once.first() is None


def test_arrays_read_at_once_give_the_same_samples(spark, monkeypatch):
    """Odd values, neighbours that are no objects and cut texts: as each element alone, whatever way the array is read."""
    good = ", ".join(f'"{c}": {i}.5' for i, c in enumerate(CHANNELS[1:]))

    def one(x, more=""):
        return f'{{"acc_x": {x}, {good}{more}}}'

    odd = ["1", '"2"', "NaN", '"NaN"', "-Infinity", "1e400", '"\\"5\\""', "null", "[1]", '{"a": 1}', "1e5", "12345678901234567890", '"high"', "1, \"acc_x\": 2"]
    texts = [f"[{one(1)}, {one(x)}]" for x in odd]
    texts += [f"[{one(1)}, {x}, {one(3)}]" for x in ("7", "null", "[]", '"text"', "[" + one(2) + "]", json.dumps(one(2)), "true")]
    texts += [f"[{one(1)}, {one(2)}", f"[{one(1)}, {{]", f"[{one(1)}] 5", f"[{one(1)},]", one(4), "[]", "", "7", "null", "[null]", f"[{one(1)}, {{}}]"]
    texts += [f"[{one(1, more)}]" for more in (', "device": "d", "seq": 5', ', "seq": "6", "end": true', ', "seq": 7.5', ', "device": {"a": "b"}')]
    alone = {}
    for way in ("at once", "alone"):
        if way == "alone":
            texts_now = [t[:-1] + ", 7]" if t.startswith("[{") and t.endswith("}]") else t for t in texts]  # one that is no object: all are read alone
        else:
            texts_now = texts
        files = spark.createDataFrame([(t, f"{i:03d}", None) for i, t in enumerate(texts_now)], "value string, source_file string, modified timestamp")
        rows = live.parse_samples(files).orderBy("source_file", "place").collect()
        added = {f"{i:03d}": len(json.loads(t)) - 1 for i, t in enumerate(texts_now) if t != texts[i]}
        alone[way] = [repr(r) for r in rows if r["place"] != added.get(r["source_file"], -1)]
    assert alone["at once"] == alone["alone"]
    assert len(alone["alone"]) > len(texts)


def test_plain_arrays_are_not_read_as_texts(spark):
    """Arrays of objects are read in one go, without a text for each of them."""
    good = dict(zip(CHANNELS, range(6)))
    files = spark.createDataFrame([(json.dumps([good] * 3), "a", None)], "value string, source_file string, modified timestamp")
    samples = live.parse_samples(files)
    assert "from_json(ArrayType(MapType" in samples._jdf.queryExecution().optimizedPlan().toString()
    assert live.well_formed(samples).count() == 3


def test_samples_with_event_times_are_packed_and_late_ones_come_out(spark, tmp_path):
    """Behind the watermark a sample is rejected if its device was scored beyond it, else scored; none goes without a row."""
    live.use_rocksdb(spark)
    rng, begin = np.random.default_rng(6), pd.Timestamp("2024-01-01", tz="UTC")

    def write(number, rows):
        x = rng.normal(size=(len(rows), 6))
        frame = pd.DataFrame([(d, s, begin + pd.Timedelta(seconds=t), *map(float, v)) for (d, s, t), v in zip(rows, x)], columns=["device", "seq", "ts", *CHANNELS])
        (tmp_path / "in").mkdir(exist_ok=True)
        path = tmp_path / "in" / f"f{number}.parquet"
        frame.astype({"ts": "datetime64[us, UTC]"}).to_parquet(path)
        os.utime(path, (1_700_000_000 + number, 1_700_000_000 + number))

    write(0, [("a", i, 10 * i) for i in range(60)] + [("b", i, 10 * i) for i in range(3)])
    write(1, [("a", 60, 1800)])
    write(2, [("c", 0, 1810)])
    write(3, [("a", 100, 65), ("b", 101, 150)])
    schema = "device string, seq long, ts timestamp, " + ", ".join(f"{c} double" for c in CHANNELS)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    scored = live.score_stream(stream, scorer, LENGTH, STRIDE, time="ts", delay="1 minute")
    rows = live.run_to_table(scored, str(tmp_path / "out"), str(tmp_path / "cp")).collect()
    assert [(r.device, r.seq) for r in rows if r.state == "rejected"] == [("a", 100)]
    assert sorted((r.seq, r.buffered_samples) for r in rows if r.device == "b") == [(0, 1), (1, 2), (2, 3), (101, 4)]
    assert sorted(r.window_index for r in rows if r.window_ready) == list(range(9)) and {r.device for r in rows} == {"a", "b"}
    assert all(r.p_fall is None for r in rows if not r.window_ready)


def test_scores_leave_the_stateful_step_packed():
    """A call gives one frame of one row, the key and bytes, for few samples: a frame costs by its columns."""
    processor = live.LiveScorer(scorer, "device", LENGTH, STRIDE, 100.0, live.SmootherConfig(), 0, None, packed=True)
    out = live.Rows("device", "d", LENGTH, processor.packed)
    processor.scored(processor.fresh(), np.arange(40), np.random.default_rng(7).normal(size=(40, 6)), out)
    (frame,) = out.frames(1)
    assert list(frame.columns) == ["device", "rows"] and len(frame) == 1
    columns = live.output_columns(np.frombuffer(frame["rows"][0]).reshape(-1, len(live.OUTPUT_NAMES)))
    assert columns["seq"].to_pylist() == [*range(19), *range(19, 40, 5)] and columns["window_index"].to_pylist() == [None] * 19 + list(range(5))
    assert columns["state"].to_pylist()[:19] == ["buffering"] * 19 and set(columns["state"].to_pylist()[19:]) <= set(live.STATES)


def test_columns_of_samples_without_numbers_are_let_go():
    parts = [np.arange(5), np.arange(5, 9)]
    assert live.joined(parts).tolist() == list(range(9)) and parts == []
