"""Which hashes occur under more than one owner: packed batches out, packed answers back.

A batch is a bounded run of owners (documents, classes of equal sets). It sends every distinct hash
once, to the bucket named by the hash's top bits, as arrays: 8 bytes a hash, mostly one byte of place
(the distance from the one before), and one entry for each run of hashes of the same owner. A hash that many owners of a batch share is therefore
sent once per batch, however hot it is, and a bucket answers with the places of the hashes that other
owners hold. Repeats inside a batch travel beside this as runs that point to the first place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext

from kinelake.llm.words import run_lengths, spans

#: Batches hold about this many hashes.
BATCH_HASHES = 1 << 21

#: bucket row: hashes, places, owners, runs, weights. base row (``body`` set): what the batch keeps about itself.
PACKED = "bucket int, batch string, hashes binary, places binary, owners binary, runs binary, weights binary, body binary"
PACKED_ARROW = pa.schema(
    [("bucket", pa.int32()), ("batch", pa.string())] + [(n, pa.binary()) for n in ("hashes", "places", "owners", "runs", "weights", "body")]
)


def batch_names() -> Iterator[str]:
    """Names of a task's batches: the same when the task runs again."""
    part = TaskContext.get().partitionId()
    return (f"{part}-{i}" for i in count())


@dataclass
class Distinct:
    """The first place of each distinct hash, and every later place with the first one it repeats."""

    first: np.ndarray
    later: np.ndarray
    repeats: np.ndarray


def distinct(hashes: np.ndarray) -> Distinct:
    order = np.argsort(hashes, kind="stable")
    starts, lengths = run_lengths(hashes[order])
    first = order[starts]
    again = np.ones(len(order), bool)
    again[starts] = False
    later = order[again]
    repeats = np.repeat(first, lengths - 1)
    by_place = np.argsort(later, kind="stable")
    return Distinct(first, later[by_place], repeats[by_place])


def packed_rows(batch: str, hashes: np.ndarray, owners: np.ndarray, places: np.ndarray, bits: int, body: bytes, weights: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows of one batch: one for each bucket, and the base row."""
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    order = np.lexsort((places, bucket))
    bucket, hashes, owners, places = bucket[order], hashes[order], owners[order], places[order]
    weights = None if weights is None else weights[order]
    at, n = run_lengths(bucket)
    cols: dict[str, list] = {k: [] for k in PACKED_ARROW.names}
    for a, b in zip(at, at + n):
        run_at, run_n = run_lengths(owners[a:b])
        row = (int(bucket[a]), batch, hashes[a:b].tobytes(), small(np.diff(places[a:b], prepend=0)), owners[a:b][run_at].tobytes(), small(run_n), None if weights is None else small(weights[a:b]), None)
        for k, v in zip(cols, row):
            cols[k].append(v)
    for k, v in zip(cols, (hash_bucket(batch, bits), batch, None, None, None, None, None, body)):
        cols[k].append(v)
    return pa.RecordBatch.from_pydict(cols, PACKED_ARROW)


def hash_bucket(name: str, bits: int) -> int:
    """A bucket for a base row, the same in every process."""
    return sum(name.encode()) % (1 << bits)


def packed_body(**columns: bytes) -> bytes:
    row = pa.record_batch([pa.array([v], pa.binary()) for v in columns.values()], list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, row.schema) as out:
        out.write_batch(row)
    return sink.getvalue().to_pybytes()


def opened_body(rows: list[dict]) -> dict[str, bytes]:
    body = next(r["body"] for r in rows if r["body"] is not None)
    return pa.ipc.open_stream(body).read_all().to_pylist()[0]


def array(value: bytes | memoryview, dtype) -> np.ndarray:
    return np.frombuffer(value, dtype)


def small(values: np.ndarray) -> bytes:
    """Mostly small integers: a byte each; 255 stands for the next of the four-byte values at the end."""
    low = np.minimum(values, 255).astype(np.uint8)
    return low.tobytes() + values[values >= 255].astype(np.uint32).tobytes()


def opened_small(value: bytes, n: int) -> np.ndarray:
    out = array(value[:n], np.uint8).astype(np.int64)
    out[out == 255] = array(value[n:], np.uint32)
    return out


def packed_ints(values: np.ndarray) -> bytes:
    """Integers by their bytes, low ones first, compressed."""
    return zstandard.compress(np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes())


def opened_ints(value: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(value), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


@dataclass
class Bucket:
    """All hashes of one bucket, with owner, row of the packed table, and place."""

    rows: list[dict]
    hashes: np.ndarray
    owners: np.ndarray
    row: np.ndarray
    places: np.ndarray


def opened(rows: list[dict]) -> Bucket:
    rows = [r for r in rows if r["body"] is None]
    counts = [len(r["hashes"]) // 8 for r in rows]
    join = lambda parts, dtype: np.concatenate([np.zeros(0, dtype), *parts])
    return Bucket(
        rows,
        join((array(r["hashes"], np.uint64) for r in rows), np.uint64),
        join((np.repeat(own := array(r["owners"], np.int64), opened_small(r["runs"], len(own))) for r in rows), np.int64),
        np.repeat(np.arange(len(rows)), counts),
        join((np.cumsum(opened_small(r["places"], n)) for r, n in zip(rows, counts)), np.int64),
    )


def packed_runs(*columns: np.ndarray) -> bytes:
    """Rows of ascending integers, where all columns rise by one, as starts and lengths."""
    if not len(columns[0]):
        return b""
    cut = np.zeros(len(columns[0]), bool)
    cut[0] = True
    for c in columns:
        cut[1:] |= np.diff(c.astype(np.int64)) != 1
    at = np.flatnonzero(cut)
    return np.vstack([*(c[at] for c in columns), np.diff(np.append(at, len(cut)))]).astype(np.uint32).tobytes()


def opened_runs(value: bytes, columns: int = 1) -> list[np.ndarray]:
    runs = array(value, np.uint32).reshape(columns + 1, -1).astype(np.int64)
    step = spans(runs[-1])
    return [np.repeat(c, runs[-1]) + step for c in runs[:-1]]
