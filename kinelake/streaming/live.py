"""Live scoring: a reorder buffer, a ring buffer, a scorer and alert smoothing per device.

Samples wait in keyed state, in slices of their order, until they are due; then they are scored in order, one score
for every ``stride`` new samples once the window is full. They are due when a sample of their device is more than
``lateness`` ahead in ``seq``, or, with event times, when the stream's watermark has passed their slice; an end mark
makes all before it due. A call holds a bounded number of rows and one slice in memory, however long a session is or
however much arrives at once; the rest lies in the state store. Output depends on the samples alone, not on how files
fall into batches: what arrives later than that, or twice, comes out as a counted "rejected" row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate, chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from kinelake.functions.channels import CHANNELS
from kinelake.operators.alerts import CALM, FALL, STATES, SmootherConfig, next_code
from kinelake.operators.windows import LABEL_IDS
from kinelake.sources.versions import drop_versions, versions

SAMPLE_SCHEMA = T.StructType(
    [
        T.StructField("device", T.StringType()),
        T.StructField("seq", T.LongType()),
        *[T.StructField(c, T.DoubleType()) for c in CHANNELS],
        T.StructField("ends", T.BooleanType()),
        T.StructField("problem", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("place", T.LongType()),
    ]
)
_STATE = (
    "at long, seq long, newest long, newest_seq long, seen long, buffer binary, average array<double>, code int, "
    "near binary, slices array<long>, held long, timer long"
)
NEVER = -(1 << 63)

#: Width of a slice in ``seq``, and in milliseconds of event time.
SLICE_SEQ, SLICE_MS = 4096, 60_000

#: Rows that one call keeps in memory before it moves them to map state, rows that stay beside the device's own state
#: between calls (few rows are cheaper there than slices of their own), and windows scored at once.
ROWS_AT_ONCE, ROWS_NEAR, SCORED_AT_ONCE = 65_536, 1024, 1024

#: Output rows that a call gathers before it gives them out.
ROWS_OUT = 8192

#: Samples that are packed by device at once, before they are sent, and the numbers of a packed one without event time.
ROWS_PACKED, PACKED_WIDTH = 131_072, len(CHANNELS) + 4


def parse_samples(files: DataFrame, device: str = "device", lines: bool = False) -> DataFrame:
    """Samples from rows (value, source_file, modified): the text of a file, its name and its time.

    A file is one JSON object or an array of them. Each element is judged alone: numbers may be strings,
    further keys are ignored, and a bad one gets a ``problem`` ("unreadable file" for text that is no JSON,
    "not an object", or the names of missing or non-numeric channels) while its neighbours stay. Without
    ``device`` the name is "default". Without ``seq`` it is null: such samples follow what came in earlier batches, in
    the order of the files' whole names and then of their places in the array. ``"end": true`` ends a session.

    With ``lines`` each line that is not blank is such an object or array of its own, and is judged alone ("unreadable
    file" then means a line): a recorder that packs many messages into a file spares the cost of a file for each.
    Places then go by line and by place in its array.
    """
    above = F.lit(0).cast("long")
    if lines:
        files = files.select("source_file", "modified", F.posexplode(F.split("value", "\r?\n")).alias("_line", "value"))
        files = files.filter(F.trim("value") != "")
        above = F.shiftleft(F.col("_line").cast("long"), 32)
    files = files.withColumn("_above", above)
    text = F.trim("value")
    # An array of nothing but objects is read in one go. All others, and those with a value that comes out quoted (as NaN
    # does), are read as texts and each of them alone.
    whole = F.when(text.startswith("{"), F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)
    objects = files.withColumn("objects", F.from_json(whole, "array<map<string,string>>"))
    odd = F.exists("objects", lambda o: o.isNull() | F.exists(F.map_values(o), lambda v: v.startswith('"')))
    objects = objects.withColumn("plain", (F.size("objects") > 0) & ~F.coalesce(odd, F.lit(False)))
    objects = objects.withColumn("plain", F.coalesce("plain", F.lit(False)))
    elements = objects.withColumn("elements", F.when(~F.col("plain"), F.from_json(whole, "array<string>")))
    unreadable = F.col("elements").isNull() | (F.size("elements") == 1) & F.get("elements", F.lit(0)).isNull()

    # Objects are read before the array is taken apart: read after it, a filter on the rows reads each once per use. Each
    # takes along whether its text is readable: found later, every row would carry the whole array to find it from.
    def judged(item: Column, unreadable: bool = False) -> Column:
        return F.struct(item.alias("item"), F.lit(unreadable).alias("unreadable"))

    def read(element: Column) -> Column:
        return judged(F.when(F.trim(element).startswith("{"), F.from_json(element, "map<string,string>")))

    nothing = F.array(judged(F.lit(None).cast("map<string,string>"), True))
    each = F.when(F.col("plain"), F.transform("objects", lambda o: judged(o))).when(unreadable, nothing).otherwise(F.transform("elements", read))
    rows = elements.select("source_file", "modified", "_above", F.posexplode_outer(each).alias("_place", "_read"))
    rows = rows.withColumns({"item": F.col("_read.item"), "unreadable": F.col("_read.unreadable")})
    rows = rows.withColumn("place", F.when(~F.col("unreadable"), F.col("_place")))
    number = {c: F.expr(f"try_cast(item['{c}'] AS DOUBLE)") for c in CHANNELS}
    ends = F.coalesce(F.expr("try_cast(item['end'] AS BOOLEAN)"), F.lit(False))
    missing = F.array_compact(F.array(*(F.when(v.isNull(), F.lit(c)) for c, v in number.items())))
    problem = (
        F.when(F.col("unreadable"), F.lit("unreadable file"))
        .when(F.col("item").isNull(), F.lit("not an object"))
        .when(~ends & (F.size(missing) > 0), F.array_join(missing, ","))
    )
    return rows.select(
        F.coalesce(F.col("item")[device], F.lit("default")).alias("device"),
        F.expr("try_cast(item['seq'] AS BIGINT)").alias("seq"),
        *[v.alias(c) for c, v in number.items()],
        ends.alias("ends"), problem.alias("problem"), "source_file", (F.col("_above") + F.col("place")).alias("place"),
    )


def read_sample_stream(spark: SparkSession, folder: str, delete: bool = False, files_per_trigger: int | None = None, lines: bool = False) -> DataFrame:
    """Samples from JSON files, or files of JSON ``lines``; see ``parse_samples``. ``delete`` removes files once done."""
    reader = spark.readStream
    if delete:
        reader = reader.option("cleanSource", "delete")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    place = {"source_file": F.col("_metadata.file_name"), "modified": F.col("_metadata.file_modification_time")}
    return parse_samples(reader.text(folder, wholetext=True).withColumns(place), lines=lines)


def well_formed(samples: DataFrame) -> DataFrame:
    """Samples without a problem."""
    return samples.filter(F.col("problem").isNull()).drop("problem")


def rejects(samples: DataFrame) -> DataFrame:
    """What ``well_formed`` leaves out, with the reason."""
    return samples.filter(F.col("problem").isNotNull())


def augment(window: np.ndarray, rate_hz: float) -> np.ndarray:
    """Nine channels of one window of six, or of each of a stack of windows."""
    accel = window[..., :3]
    mag = np.sqrt((accel**2).sum(axis=-1))
    cosine = np.clip(accel[..., 2] / np.where(mag == 0, 1e-8, mag), -1.0, 1.0)
    added = np.stack([mag, np.gradient(mag, axis=-1) * rate_hz, np.degrees(np.arccos(cosine))], axis=-1)
    return np.concatenate([window, added], axis=-1)


def softmax_rows(logits: np.ndarray) -> np.ndarray:
    powers = np.exp(logits - logits.max(axis=1, keepdims=True))
    return powers / powers.sum(axis=1, keepdims=True)


def pack_samples(rows: DataFrame, key: str, timed: bool = False) -> DataFrame:
    """One row per device of each run of ``ROWS_PACKED`` samples: their files' names, and the samples as numbers.

    A sample is the place of its file among the names and its place there (only if it has no number; -1 and 0 if it has),
    ``seq``, the channels, the end mark and, if ``timed``, the event time ``at``. So the shuffle, its sort and the stateful step handle few rows, whatever the samples.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, count = [], 0
        for batch in batches:
            some.append(batch)
            count += batch.num_rows
            if count >= ROWS_PACKED:
                yield packed(pa.Table.from_batches(some))
                some, count = [], 0
        if count:
            yield packed(pa.Table.from_batches(some))

    def packed(table: pa.Table) -> pa.RecordBatch:
        keys, names = (table[c].combine_chunks().dictionary_encode(null_encoding="encode") for c in (key, "source_file"))
        device = keys.indices.to_numpy()
        order = np.argsort(device, kind="stable")
        device = device[order]
        blank = table["seq"].is_null().to_numpy()[order]
        samples = np.empty((len(order), PACKED_WIDTH + timed))
        samples[:, 2] = table["seq"].fill_null(0).to_numpy().astype(np.int64)[order].view(np.float64)
        for i, c in enumerate(CHANNELS):
            samples[:, 3 + i] = table[c].cast(pa.float64()).to_numpy()[order]
        samples[:, PACKED_WIDTH - 1] = table["ends"].to_numpy()[order]
        if timed:
            samples[:, PACKED_WIDTH] = table["at"].to_numpy().astype(np.int64)[order].view(np.float64)
        samples[:, 0], samples[:, 1] = -1, 0
        pairs, number = np.unique(device[blank].astype(np.int64) * len(names.dictionary) + names.indices.to_numpy()[order][blank], return_inverse=True)
        owner = pairs // max(len(names.dictionary), 1)
        files_at = np.searchsorted(owner, np.arange(len(keys.dictionary) + 1))
        samples[blank, 0] = number - files_at[device[blank]]
        samples[blank, 1] = table["place"].cast(pa.float64()).to_numpy()[order][blank]
        files = names.dictionary.take(pa.array(pairs % max(len(names.dictionary), 1)))
        at = np.searchsorted(device, np.arange(len(keys.dictionary) + 1)) * samples.itemsize * samples.shape[1]
        columns = [
            keys.dictionary,
            pa.ListArray.from_arrays(pa.array(files_at, pa.int32()), files),
            pa.Array.from_buffers(pa.binary(), len(keys.dictionary), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(samples)]),
        ]
        return pa.RecordBatch.from_arrays(columns, [key, "files", "samples"])

    kind = T.StructType([rows.schema[key], T.StructField("files", T.ArrayType(T.StringType())), T.StructField("samples", T.BinaryType())])
    return rows.mapInArrow(pack, kind)


def unpacked(frames: Iterator[pd.DataFrame], files: dict, at_once: int, timed: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Samples of packed rows, some at a time, and where they have no number; files are numbered as they come."""
    for frame in frames:
        some, count = [], 0
        for names, packed in zip(frame["files"], frame["samples"]):
            samples = np.frombuffer(packed).reshape(-1, PACKED_WIDTH + timed)
            if len(names):
                samples = samples.copy()
                number = np.array([files.setdefault(f, len(files)) for f in names])
                blank = samples[:, 0] >= 0
                samples[blank, 0] = number[samples[blank, 0].astype(np.int64)]
            some.append(samples)
            count += len(samples)
            if count >= at_once:
                yield (whole := np.concatenate(some)), whole[:, 0] >= 0
                some, count = [], 0
        if some:
            yield (whole := np.concatenate(some)), whole[:, 0] >= 0


def joined(parts: list[np.ndarray]) -> np.ndarray:
    """The parts as one array; they are let go, so that one column at a time lies in memory twice."""
    whole = np.concatenate(parts)
    parts.clear()
    return whole


class Held:
    """Rows of one device that wait, by slice: a bounded number in memory, the rest in map state, an entry per slice.

    A row is order (event time or ``seq``), ``seq``, the channels, and whether it ends the session.
    """

    WIDTH = len(CHANNELS) + 3

    def __init__(self, store, stored: Sequence[int], width: int, rows_at_once: int, near: bytes = b""):
        self.store, self.stored, self.width, self.limit = store, set(stored), width, rows_at_once
        self.come: list[np.ndarray] = []
        self.near: dict[int, list[np.ndarray]] = {}
        self.count = 0
        self.put(np.frombuffer(near, np.float64).reshape(-1, self.WIDTH))

    def put(self, rows: np.ndarray) -> None:
        if len(rows):
            self.come.append(rows)
        self.count += len(rows)
        if self.count > self.limit:
            self.settle()

    def _split(self) -> None:
        """Puts what has come into its slices."""
        if not self.come:
            return
        rows = np.concatenate(self.come)
        number = self.orders(rows) // self.width
        by_slice = np.argsort(number, kind="stable")
        number, rows = number[by_slice], rows[by_slice]
        at = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
        for i, part in zip(at, np.split(rows, at[1:])):
            self.near.setdefault(int(number[i]), []).append(part)
        self.come = []

    def settle(self) -> None:
        """Moves what is in memory to the state store."""
        self._split()
        for number, parts in self.near.items():
            earlier = [self._stored(number)] if number in self.stored else []
            self.store.updateValue((number,), (np.vstack([*earlier, *parts]).tobytes(),))
            self.stored.add(number)
        self.near, self.count = {}, 0

    def _all(self) -> np.ndarray:
        return np.concatenate([np.empty((0, self.WIDTH)), *(p for parts in self.near.values() for p in parts), *self.come])

    def packed(self) -> bytes:
        """What stays beside the device's state: all rows in memory if they are few, else none."""
        if self.count > ROWS_NEAR:
            self.settle()
        return self._all().tobytes()

    def first(self) -> int | None:
        """The first slice that holds rows."""
        rows = self._all()
        slices = [*self.stored, *([int(self.orders(rows).min()) // self.width] if len(rows) else [])]
        return min(slices, default=None)

    def take_near(self, bound: int) -> np.ndarray:
        """The rows up to ``bound``, in order as by ``take``, if all rows are in memory; they are no longer held."""
        rows = self._all()
        due = self.orders(rows) <= bound
        self.near, self.come, self.count = {}, [], 0
        self.put(rows[~due])
        rows = rows[due]
        return rows[np.lexsort((self.numbers(rows), self.orders(rows)))]

    def slices(self) -> list[int]:
        self._split()
        return sorted(self.stored.union(self.near))

    def take(self, number: int) -> np.ndarray:
        """The rows of one slice in order, the first to come of equal ones first; they are no longer held."""
        self._split()
        parts = self.near.pop(number, [])
        self.count -= sum(map(len, parts))
        if number in self.stored:
            parts = [self._stored(number), *parts]
            self.store.removeKey((number,))
            self.stored.discard(number)
        rows = np.vstack(parts)
        return rows[np.lexsort((self.numbers(rows), self.orders(rows)))]

    def _stored(self, number: int) -> np.ndarray:
        return np.frombuffer(self.store.getValue((number,))[0], np.float64).reshape(-1, self.WIDTH)

    @staticmethod
    def orders(rows: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(rows[:, 0]).view(np.int64)

    @staticmethod
    def numbers(rows: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(rows[:, 1]).view(np.int64)


class Rows:
    """Output rows of one call as numbers, given out a frame at a time; -1 stands for no number.

    ``packed`` frames have one row, the key and the rows' bytes, since a frame costs by its columns; see ``unpack_rows``.
    """

    def __init__(self, key: str, value, needed: int, packed: bool = False):
        self.key, self.value, self.needed, self.packed = key, value, needed, packed
        self.parts: list[np.ndarray] = []
        self.count = 0

    def add(self, seq: np.ndarray, state, index=-1, buffered=-1, ready: bool = False, probs=np.nan) -> None:
        """``state`` is a name, or numbers among the names."""
        n = len(seq)
        if n:
            rows = np.empty((n, len(OUTPUT_NAMES)))
            numbers = rows.view(np.int64)
            numbers[:, 0], numbers[:, 1], numbers[:, 2], numbers[:, 3] = index, seq, buffered, ready
            numbers[:, 4] = OUTPUT_STATES.index(state) if isinstance(state, str) else state
            rows[:, 5:] = probs
            self.parts.append(rows)
            self.count += n

    def frames(self, least: int = ROWS_OUT) -> Iterator[pd.DataFrame]:
        if self.count < max(least, 1):
            return
        rows = np.concatenate(self.parts)
        self.parts, self.count = [], 0
        if self.packed:
            yield pd.DataFrame({self.key: pd.Series([self.value], dtype=object), "rows": [rows.tobytes()]})
            return
        columns = {n: v.to_pandas(integer_object_nulls=True) for n, v in output_columns(rows).items()}
        yield pd.DataFrame({self.key: [self.value] * len(rows), **columns, "needed_samples": np.full(len(rows), self.needed)}, copy=False)


def output_columns(rows: np.ndarray) -> dict[str, pa.Array]:
    """Columns of the rows that ``Rows`` gathers."""
    numbers = rows.view(np.int64)
    known = {n: pa.array(numbers[:, i], mask=numbers[:, i] < 0 if n != "seq" else None) for i, n in enumerate(OUTPUT_NAMES[:3])}
    states = pa.DictionaryArray.from_arrays(numbers[:, 4].astype(np.int8), OUTPUT_STATES).cast(pa.string())
    probs = {n: pa.array(rows[:, 5 + i], from_pandas=True) for i, n in enumerate(OUTPUT_NAMES[5:])}  # NaN is null
    return {**known, OUTPUT_NAMES[3]: pa.array(numbers[:, 3] > 0), OUTPUT_NAMES[4]: states, **probs}


def unpack_rows(packed: DataFrame, key: T.StructField, needed: int) -> DataFrame:
    """Output rows from packed ones."""
    schema = output_schema(key)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some, count, begin = [], 0, 0
            for i, lot in enumerate(batch["rows"]):
                some.append(np.frombuffer(lot.as_buffer()).reshape(-1, len(OUTPUT_NAMES)))
                count += len(some[-1])
                if count >= ROWS_AT_ONCE or i + 1 == batch.num_rows:
                    owner = np.repeat(np.arange(begin, i + 1), [len(p) for p in some])
                    columns = [batch[key.name].take(pa.array(owner)), *output_columns(np.concatenate(some)).values(), pa.array(np.full(count, needed))]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)
                    some, count, begin = [], 0, i + 1

    return packed.mapInArrow(unpack, schema)


class LiveScorer(StatefulProcessor):
    """Per device: samples that wait, the last ``length`` ones, the moving average and the alert state."""

    def __init__(
        self,
        scorer: Callable[[np.ndarray], np.ndarray],
        key: str,
        length: int,
        stride: int,
        rate_hz: float,
        config: SmootherConfig,
        lateness: int,
        ttl_ms: int | None,
        timed: bool = False,
        report: bool = False,
        packed: bool = False,
    ) -> None:
        self.packed = packed
        self.scorer, self.key, self.length, self.stride = scorer, key, length, stride
        self.rate_hz, self.config, self.lateness, self.ttl_ms = rate_hz, config, lateness, ttl_ms
        self.timed, self.report, self.width = timed, report, SLICE_MS if timed else SLICE_SEQ
        self.rows_at_once = ROWS_AT_ONCE

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("device", _STATE, self.ttl_ms)
        self.held = handle.getMapState("held", "slice long", "rows binary", self.ttl_ms)

    def _load(self) -> dict:
        stored = self.state.get()
        if stored is None:
            return dict(last=(NEVER, NEVER), newest=NEVER, newest_seq=-1, window=self.fresh(), near=b"", slices=[], held=0, timer=0)
        at, seq, newest, newest_seq, seen, flat, average, code, near, slices, held, timer = stored
        window = (seen, np.frombuffer(flat).reshape(-1, len(CHANNELS)), list(average) or None, code)
        return dict(last=(at, seq), newest=newest, newest_seq=newest_seq, window=window, near=near, slices=slices, held=held, timer=timer)

    def _save(self, device: dict, held: Held) -> None:
        near = held.packed()
        if self.timed and (first := held.first()) is not None:
            due = (first + 1) * self.width
            if due != device["timer"]:
                self.handle.registerTimer(due)
                device["timer"] = due
        seen, buffer, average, code = device["window"]
        self.state.update(
            (*device["last"], device["newest"], device["newest_seq"], seen, buffer.tobytes(), [] if average is None else list(average), code,
             near, sorted(held.stored), device["held"], device["timer"])
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        device, out = self._load(), Rows(self.key, key[0], self.length, self.packed)
        held = Held(self.held, device["slices"], self.width, self.rows_at_once, device["near"])
        until = NEVER  # an end mark makes due all up to it, however late others may be
        unnumbered, files = [], {}
        for part in self._parts(rows, files):
            blank, seq, number, place, values, at = part
            if not blank.any():
                until = self._wait(device, held, seq, at, values, until, out)
            else:
                # Order of arrival: batch by batch, then by whole file name and place.
                unnumbered.append((number[blank], place[blank], values[blank], *([at[blank]] if self.timed else [])))
                until = self._wait(device, held, seq[~blank], at[~blank] if self.timed else None, values[~blank], until, out)
            yield from out.frames()
        if unnumbered:
            columns = [list(c) for c in zip(*unnumbered)]
            unnumbered.clear()
            number, place, values, *at = map(joined, columns)
            ranks = np.empty(len(files), np.int64)
            ranks[[files[f] for f in sorted(files, key=lambda f: (f is None, f or ""))]] = np.arange(len(files))
            order = np.lexsort((place, ranks[number]))
            first = device["newest_seq"] + 1
            for i in range(0, len(order), self.rows_at_once):
                some = order[i : i + self.rows_at_once]
                seq = first + i + np.arange(len(some))
                until = self._wait(device, held, seq, at[0][some] if self.timed else None, values[some], until, out)
                if not self.timed:  # what follows has higher numbers
                    yield from self._release(device, held, max(until, device["newest"] - self.lateness), out)
        bound = until if self.timed else max(until, device["newest"] - self.lateness)
        yield from self._release(device, held, bound, out)
        self._save(device, held)
        if self.report:
            out.add(np.array([device["newest_seq"]]), "held", buffered=device["held"])
        yield from out.frames(1)

    def _parts(self, frames: Iterator[pd.DataFrame], files: dict) -> Iterator[tuple]:
        """Samples as arrays: without a number or not, ``seq``, number of the file, place, values, and event time if there is one."""
        frames = iter(frames)
        if (head := next(frames, None)) is None:
            return
        frames = chain([head], frames)
        if "samples" in head:
            for samples, blank in unpacked(frames, files, self.rows_at_once, self.timed):
                seq = np.ascontiguousarray(samples[:, 2]).view(np.int64)
                at = np.ascontiguousarray(samples[:, PACKED_WIDTH]).view(np.int64) if self.timed else None
                yield blank, seq, samples[:, 0].astype(np.int64), samples[:, 1], samples[:, 3:PACKED_WIDTH], at
            return
        for frame in frames:
            blank = frame["seq"].isna().to_numpy()
            values = np.column_stack([frame[c].to_numpy(float) for c in [*CHANNELS, "ends"]])
            at = frame["at"].to_numpy(np.int64) if self.timed else None
            number, place = np.full(len(frame), -1), np.zeros(len(frame))
            if blank.any():
                named = frame["source_file"].to_numpy(object)[blank].tolist()
                number[blank] = np.fromiter((files.setdefault(f, len(files)) for f in named), np.int64, len(named))
                place = frame["place"].to_numpy(float)
            yield blank, frame["seq"].fillna(0).to_numpy(np.int64) if blank.any() else frame["seq"].to_numpy(np.int64), number, place, values, at

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The watermark has passed a slice: it is due, with all before it."""
        device, out = self._load(), Rows(self.key, key[0], self.length, self.packed)
        held = Held(self.held, device["slices"], self.width, self.rows_at_once, device["near"])
        device["timer"] = 0  # it is gone: what comes late for the same slice needs another
        bound = timerValues.getCurrentWatermarkInMs() // self.width * self.width - 1
        yield from self._release(device, held, bound, out)
        self._save(device, held)
        yield from out.frames(1)

    def _wait(self, device: dict, held: Held, seq: np.ndarray, at: np.ndarray | None, values: np.ndarray, until: int, out: Rows) -> int:
        """Puts samples into their slices; those before what is scored come out as rejected. ``values`` end with the end marks."""
        if not len(seq):
            return until
        at = seq if at is None else at
        late = (at < device["last"][0]) | (at == device["last"][0]) & (seq <= device["last"][1])
        if late.any():
            out.add(seq[late], "rejected")
            at, seq, values = at[~late], seq[~late], values[~late]
        if len(seq):
            device["newest"] = max(device["newest"], int(at.max()))
            device["newest_seq"] = max(device["newest_seq"], int(seq.max()))
            device["held"] += len(seq)
            held.put(np.column_stack([at.view(np.float64), seq.view(np.float64), values]))
            ends = values[:, -1] > 0
            if ends.any():
                until = max(until, int(at[ends].max()))
        return until

    def _release(self, device: dict, held: Held, bound: int, out: Rows) -> Iterator[pd.DataFrame]:
        """Scores all samples up to ``bound``, one slice or a run of small ones at a time."""
        if not held.stored:
            rows = held.take_near(bound)
            begin = 0
            while begin < len(rows):
                stop = min(begin + ROWS_OUT, len(rows))
                while stop < len(rows) and (rows[stop, :2].view(np.int64) == rows[stop - 1, :2].view(np.int64)).all():
                    stop += 1  # equal ones are told apart together
                self._due(device, rows[begin:stop], out)
                yield from out.frames()
                begin = stop
            return
        run, size = [], 0
        for number in held.slices():
            if number * self.width > bound:
                break
            rows = held.take(number)
            ready = int(np.searchsorted(Held.orders(rows), bound, "right"))
            if ready < len(rows):
                held.put(rows[ready:])
            run.append(rows[:ready])
            size += ready
            if size >= ROWS_NEAR:
                self._due(device, np.vstack(run), out)
                yield from out.frames()
                run, size = [], 0
        if size:
            self._due(device, np.vstack(run), out)
            yield from out.frames()

    def _due(self, device: dict, rows: np.ndarray, out: Rows) -> None:
        """Scores rows that are in order."""
        device["held"] -= len(rows)
        at, seq = Held.orders(rows), Held.numbers(rows)
        again = np.zeros(len(rows), bool)
        again[1:] = (at[1:] == at[:-1]) & (seq[1:] == seq[:-1])
        device["last"] = (int(at[-1]), int(seq[-1]))
        out.add(seq[again], "rejected")
        rows, seq = rows[~again], seq[~again]
        begin = 0
        for stop in [*np.flatnonzero(rows[:, -1] > 0).tolist(), len(rows)]:
            device["window"] = self.scored(device["window"], seq[begin:stop], rows[begin:stop, 2:-1], out)
            if stop < len(rows):
                device["window"] = self.fresh()
            begin = stop + 1

    @staticmethod
    def fresh() -> tuple:
        return 0, np.empty((0, len(CHANNELS))), None, CALM

    def scored(self, window: tuple, seq: np.ndarray, values: np.ndarray, out: Rows) -> tuple:
        """Feeds samples that are in order; adds a row for each while the window fills, then one per stride."""
        seen, buffer, average, code = window
        if not len(seq):
            return window
        filling = min(len(seq), max(0, self.length - 1 - seen))
        out.add(seq[:filling], "buffering", buffered=seen + 1 + np.arange(filling))
        series = np.vstack([buffer, values])
        first, total = seen - len(buffer), seen + len(seq)  # position of series[0]; samples by now
        # Windows end at length, length + stride, ...; those not yet scored end after ``seen``.
        begin = max(0, -(-(seen + 1 - self.length) // self.stride))
        starts = np.arange(begin * self.stride, total - self.length + 1, self.stride)
        a = self.config.ema_alpha
        b = 1 - a
        for lot in (starts[i : i + SCORED_AT_ONCE] for i in range(0, len(starts), SCORED_AT_ONCE)):
            views = series[(lot - first)[:, None] + np.arange(self.length)]
            probs = softmax_rows(np.asarray(self.scorer(augment(views, self.rate_hz)), dtype=float))
            before = [[]] * probs.shape[1] if average is None else [[q] for q in average]
            smooth = [list(accumulate(chain(q, p), lambda q, p: a * p + b * q))[len(q) :] for q, p in zip(before, probs.T.tolist())]
            states = []
            for pre, fall in zip(smooth[1], smooth[2]):
                code = next_code(code, pre, fall, self.config)
                states.append(code)
            average = [s[-1] for s in smooth]
            out.add(seq[lot + (self.length - 1 - seen)], np.minimum(states, FALL), lot // self.stride, self.length, True, probs)
        return total, series[-self.length :], average, code

    def close(self) -> None:
        pass


OUTPUT_NAMES = ["window_index", "seq", "buffered_samples", "window_ready", "state", *[f"p_{n}" for n in LABEL_IDS]]
OUTPUT_STATES = [*STATES, "buffering", "rejected", "held"]


def output_schema(key: T.StructField) -> T.StructType:
    return T.StructType(
        [
            key,
            T.StructField("window_index", T.LongType()),
            T.StructField("seq", T.LongType()),
            T.StructField("buffered_samples", T.LongType()),
            T.StructField("window_ready", T.BooleanType()),
            T.StructField("state", T.StringType()),
            *[T.StructField(f"p_{n}", T.DoubleType()) for n in LABEL_IDS],
            T.StructField("needed_samples", T.LongType()),
        ]
    )


def score_stream(
    samples: DataFrame,
    scorer: Callable[[np.ndarray], np.ndarray],
    length: int = 100,
    stride: int = 10,
    rate_hz: float = 100.0,
    key: str = "device",
    config: SmootherConfig | None = None,
    lateness: int = 0,
    state_ttl_ms: int | None = None,
    time: str | None = None,
    delay: str = "10 seconds",
    report: bool = False,
) -> DataFrame:
    """Scores and alert states per device.

    One row per scored window (``seq`` is that of its last sample), one "buffering" row for each sample that
    does not yet fill the window (with the fill level), and one "rejected" row for each sample that came after
    a sample more than ``lateness`` ahead had been scored, or whose ``seq`` came before. A sample with ``ends``
    closes the session: what waits up to it is scored and the device starts afresh. Samples without ``seq`` are
    numbered as they come: batch by batch, by ``source_file`` and ``place`` inside a batch.

    With ``time``, a timestamp column, order is by it and then ``seq``, and samples wait until the stream's watermark,
    ``delay`` behind the newest time of any device, has passed their minute; so a silent device is scored to its end.
    A sample that comes later than that is scored all the same as long as no later one of its device is, else rejected.

    State (waiting samples, one window, average and alert) lies in the RocksDB store; ``state_ttl_ms`` lets that of
    silent devices expire, by processing time (not together with ``time``), so such a stream always has another
    batch: run it continuously, not to an end. ``report`` adds a "held" row per device and batch with the number of
    samples that go on waiting.
    """
    if time is not None and state_ttl_ms is not None:
        raise ValueError("state expires by processing time, which event times exclude")
    timed, field = time is not None, samples.schema[key]
    processor = LiveScorer(scorer, key, length, stride, rate_hz, config or SmootherConfig(), lateness, state_ttl_ms, timed, report, packed=True)
    ends = F.coalesce("ends", F.lit(False)) if "ends" in samples.columns else F.lit(False)
    named = [F.col(c) if c in samples.columns else F.lit(None).cast(t).alias(c) for c, t in (("source_file", "string"), ("place", "long"))]
    when = [F.unix_millis(F.col(time).cast("timestamp")).alias("at")] if timed else []
    rows = samples.filter(F.col(time).isNotNull()).withWatermark(time, delay) if timed else samples
    rows = rows.select(key, "seq", *CHANNELS, ends.alias("ends"), *named, *when)
    scored = pack_samples(rows, key, timed).groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor,
        outputStructType=T.StructType([field, T.StructField("rows", T.BinaryType())]),
        outputMode="Append",
        timeMode="EventTime" if timed else "None" if state_ttl_ms is None else "ProcessingTime",
    )
    return unpack_rows(scored, field, length)


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that keeps large state off the heap."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def latest_state(rows: DataFrame, key: str) -> DataFrame:
    """The newest row per device by ``seq``; rejected samples and reports do not count."""
    rest = [c for c in rows.columns if c != key]
    newest = F.max_by(F.struct(*rest), F.col("seq"))
    return rows.filter("state NOT IN ('rejected', 'held')").groupBy(key).agg(newest.alias("_row")).select(key, "_row.*")


def write_state(stream: DataFrame, path: str, checkpoint: str, key: str = "device", **trigger) -> StreamingQuery:
    """Keep the current state of every device below ``path``, one version per batch, the last two of them.

    Batch n is written over version n alone, so a repeated batch leaves the same result. Read with
    ``read_state``.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = latest_state(batch, key)
        before = [v for v in versions(spark, path, "batch") if v < batch_id]
        if before:
            newest = latest_state(spark.read.schema(batch.schema).parquet(f"{path}/batch={before[-1]}").unionByName(newest), key)
        newest.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        drop_versions(spark, path, "batch", before[:-1])

    writer = stream.writeStream.outputMode("append").foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of the current state."""
    return spark.read.parquet(f"{path}/batch={versions(spark, path, 'batch')[-1]}")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Process what is available now into a table and return it."""
    spark = stream.sparkSession
    out = stream if columns is None else stream.select(*columns)
    query = (
        out.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(path)
    )
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(path)
