"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer network.

Tokens are runs of letters, of digits, or of other symbols. A token's index vector has a few random signs;
its word vector is the sum of the index vectors of its neighbours over the whole corpus, counted in integers
(so that the sum does not depend on the order of tasks) in ``buckets`` hashed rows. A document is the mean of
its word vectors, with the share of each letter-case and symbol shape and the chances that two of its words, or
two neighbouring ones, agree. The network learns from at most ``sample`` labelled rows, those with the smallest hash of their id; a
fifth of them sets the temperature that calibrates its probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.llm import words

SHAPES = 6  # lower, capital, upper, mixed, digits, symbols
_AGREE = 256
_SIGNS = 4


@dataclass(frozen=True)
class Settings:
    """``buckets * dims`` four-byte numbers are gathered once; ``sample`` bounds the labelled rows learned from."""

    buckets: int = 1 << 14
    dims: int = 32
    reach: int = 2
    sample: int = 20_000
    hidden: int = 24
    steps: int = 300
    seed: int = 11


def _kinds() -> np.ndarray:
    code = np.arange(256)
    kind = np.full(256, 3)  # symbols
    kind[(code == 0x20) | ((code >= 9) & (code <= 13))] = 0
    kind[(code >= 0x80) | ((code >= 65) & (code <= 90)) | ((code >= 97) & (code <= 122))] = 1
    kind[(code >= 48) & (code <= 57)] = 2
    return kind


_KIND = _kinds()


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and shape of every token of the texts, and the number of tokens before each text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    kind = _KIND[data]
    cut = np.ones(n + 1, bool)
    cut[1:-1] = kind[1:] != kind[:-1]
    cut[at] = True
    edges = np.flatnonzero(cut)
    full = kind[edges[:-1]] > 0
    starts, ends = edges[:-1][full], edges[1:][full]
    hashes = words.span_hashes(data, starts, ends, words.alphabet(lower=True))
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    caps, of = upper[ends] - upper[starts], kind[starts]
    shape = np.select([of == 2, of == 3, caps == 0, (caps == ends - starts) & (caps > 1), (caps == 1) & (upper[starts + 1] > upper[starts])], [4, 5, 0, 2, 1], 3)
    return hashes, shape, np.searchsorted(starts, at)


def index_vectors(s: Settings) -> np.ndarray:
    """A few signs per bucket, from its number alone."""
    out = np.zeros((s.buckets, s.dims), np.int64)
    rows = np.arange(s.buckets)
    for k in range(_SIGNS):
        h = words.mix(rows.astype(np.uint64) * np.uint64(_SIGNS) + np.uint64(k) + np.uint64(s.seed << 40))
        np.add.at(out, (rows, (h >> np.uint64(8)).astype(np.int64) % s.dims), np.where(h & np.uint64(1), 1, -1))
    return out


_BLOCKS = 64

#: Sums of a block are added in two steps, first those of the partitions that are alike modulo this.
_SHARES = 256


_SUMS = "block int, share int, sums binary"


def _counter(s: Settings):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_vectors(s)
        total = np.zeros((s.buckets, s.dims), np.int64)
        for batch in batches:
            for a, b, data, at in words.pieces(batch.column(0)):
                hashes, _, first = tokens(data, at)
                bucket = (hashes % np.uint64(s.buckets)).astype(np.int64)
                doc = np.repeat(np.arange(b - a), np.diff(first))
                for step in range(1, s.reach + 1):
                    same = doc[step:] == doc[:-step]
                    pair = bucket[:-step][same] * s.buckets + bucket[step:][same]
                    pair, n = np.unique(pair, return_counts=True)
                    left, right = pair // s.buckets, pair % s.buckets
                    for one, other in ((left, right), (right, left)):
                        order = np.argsort(one, kind="stable")
                        at_, _ = words.run_lengths(one[order])
                        if len(at_):
                            total[one[order][at_]] += np.add.reduceat(index[other[order]] * n[order, None], at_)
        parts = total.reshape(_BLOCKS, -1)
        share = pa.array(np.full(_BLOCKS, TaskContext.get().partitionId() % _SHARES, np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(_BLOCKS, dtype=np.int32)), share, pa.array([p.tobytes() for p in parts], pa.binary())], ["block", "share", "sums"])

    return count


def _adder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the sums of a (block, share), batch by batch: memory does not grow with their number."""
    total, first = 0, None
    for batch in batches:
        first = first or batch.slice(0, 1)
        for b in batch.column("sums"):
            total = total + np.frombuffer(b.as_buffer(), np.int64)
    if first is not None:
        yield pa.RecordBatch.from_arrays([first.column("block"), first.column("share"), pa.array([total.tobytes()], pa.binary())], ["block", "share", "sums"])


def word_vectors(documents: DataFrame, s: Settings, text: str = "text") -> np.ndarray:
    """Unit word vectors by bucket, over all documents. What reaches the driver is ``buckets * dims`` numbers."""
    parts = documents.select(F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(_counter(s), _SUMS)
    shares = parts.groupBy("block", "share").applyInArrow(_adder, _SUMS)
    rows = shares.withColumn("share", F.lit(0)).groupBy("block").applyInArrow(_adder, _SUMS).collect()
    total = np.zeros((_BLOCKS, s.buckets * s.dims // _BLOCKS))
    for r in rows:
        total[r["block"]] = np.frombuffer(r["sums"], np.int64)
    total = total.reshape(s.buckets, s.dims)
    return (total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)).astype(np.float32)


#: Beside the mean word vector and the shapes: agreement of any two and of neighbouring word tokens, length of the
#: mean vector, logarithm of the number of tokens.
_MORE = 4


def features(data: np.ndarray, at: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """One row per text: mean word vector, shares of shapes, and the four of ``_MORE``."""
    hashes, shape, first = tokens(data, at)
    counts = np.diff(first)
    n, dims = len(counts), vectors.shape[1]
    out = np.zeros((n, dims + SHAPES + _MORE), np.float32)
    full = counts > 0
    if full.any():
        bucket = (hashes % np.uint64(len(vectors))).astype(np.int64)
        doc = np.repeat(np.arange(n), counts)
        out[full, :dims] = np.add.reduceat(vectors[bucket], first[:-1][full]) / counts[full][:, None]
        out[:, dims : dims + SHAPES] = np.bincount(doc * SHAPES + shape, minlength=n * SHAPES).reshape(n, SHAPES) / np.maximum(counts, 1)[:, None]
        word = shape < 4
        doc, hashes = doc[word], hashes[word]
        own = np.bincount(doc * _AGREE + (hashes >> np.uint64(56)).astype(np.int64), minlength=n * _AGREE).reshape(n, _AGREE)
        total = own.sum(1)
        out[:, -4] = np.sqrt((np.square(own).sum(1) - total) / np.maximum(total * (total - 1.0), 1.0))
        near = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
        out[:, -3] = np.bincount(doc[1:], near, minlength=n) / np.maximum(total - 1.0, 1.0)
        out[full, -2] = np.linalg.norm(out[full, :dims], axis=1)
        out[:, -1] = np.log1p(counts)
    return out


@dataclass(frozen=True)
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, ...]
    temperature: float

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Calibrated probability of label 1 of each text."""
        return 1 / (1 + np.exp(-self.logits((features(data, at, self.vectors) - self.mean) / self.scale) / self.temperature))

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.clip(np.tanh(x.astype(np.float64) @ w1 + b1) @ w2 + b2, -500, 500)


def _trained(x: np.ndarray, y: np.ndarray, s: Settings) -> tuple[np.ndarray, ...]:
    rng = np.random.default_rng(s.seed)
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], s.hidden)), np.zeros(s.hidden), rng.normal(0, 1 / np.sqrt(s.hidden), s.hidden), np.zeros(())]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, s.steps + 1):
        h = np.tanh(x @ p[0] + p[1])
        g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -500, 500))) - y) / len(y)
        back = np.outer(g, p[2]) * (1 - h * h)
        grads = [x.T @ back + 1e-4 * p[0], back.sum(0), h.T @ g + 1e-4 * p[2], g.sum()]
        for i, d in enumerate(grads):
            m[i], v[i] = 0.9 * m[i] + 0.1 * d, 0.999 * v[i] + 0.001 * d * d
            p[i] = p[i] - 0.02 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return tuple(p)


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits, between 1/4 and 8, with the least log loss."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 241))
    loss = [np.mean(np.logaddexp(0, -logits / t * (2 * y - 1))) for t in grid]
    return float(grid[int(np.argmin(loss))])


def _vectorised(vectors):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, at in words.pieces(batch.column(2)):
                x = features(data, at, vectors.value)
                rows = pa.array([r.tobytes() for r in x], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], rows], ["id", "y", "x"])

    return run


def fit(documents: DataFrame, labels: DataFrame, s: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Learns from documents with a label of 0 or 1; word vectors from all documents.

    Rows of ``labels`` with a null id or label are left out; of several labels of one id the largest counts, of
    several texts of one id the one with the least hash.
    With no usable label, or labels of one kind only, every score is the share of label 1 (a half if none).
    """
    spark = documents.sparkSession
    vectors = word_vectors(documents, s, text)
    shared = spark.sparkContext.broadcast(vectors)
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(s.sample)
    rows = documents.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(known), "id").groupBy("id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.xxhash64(F.lit(1), "text"))).alias("text"))  # ``sample`` ids at most
    kind = documents.schema[doc_id].dataType.simpleString()
    got = rows.mapInArrow(_vectorised(shared), f"id {kind}, y int, x binary").toArrow().sort_by("id")
    y = got.column("y").to_numpy().astype(np.float64)
    width = s.dims + SHAPES + _MORE
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(-1, width)
    share = float(y.mean()) if len(y) else 0.5
    if not 0 < share < 1 or len(y) < 10:
        flat = (np.zeros((width, 1)), np.zeros(1), np.zeros(1), np.array(np.log((share + 1e-6) / (1 - share + 1e-6))))
        return Model(vectors, np.zeros(width, np.float32), np.ones(width, np.float32), flat, 1.0)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    x = ((x - mean) / scale).astype(np.float64)
    held = np.arange(len(y)) % 5 == 4
    layers = _trained(x[~held], y[~held], s)
    model = Model(vectors, mean, scale, layers, 1.0)
    return Model(vectors, mean, scale, layers, _temperature(model.logits(x[held]), y[held]))


def _scorer(model, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [model.value.scores(data, at) for _, _, data, at in words.pieces(batch.column(text))]
            score = np.concatenate([np.zeros(0), *own])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, "score"])

    return run


def score(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents with ``score``, from the text alone: the probability of label 1.

    A column of that name is replaced. Null and empty texts have all features 0 and get the score that goes
    with that; repeated rows score alike; an empty table gives an empty result.
    """
    base = documents.drop("score")
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + ", score double"
    return base.mapInArrow(_scorer(shared, base.columns.index(text)), schema)


def held_out(doc_id: str = "doc_id"):
    """Ids whose label is never learned from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4 == 2
