"""Language-model scoring: interpolated modified Kneser-Ney n-grams, counted in Spark.

Counting: batches of tokens send their distinct n-grams with counts, packed, to the bucket of the context.
Each bucket task sums its n-grams, writes them as sorted hash arrays into the model folder, and passes on the
suffixes with the number of their distinct left neighbours, which are the counts of the next lower order.
Contexts that fill a large share of any batch are spread over buckets by the whole n-gram; the statistics of
these few are summed afterwards.

Scoring: workers map the arrays into memory and look the n-grams of a batch up by binary search, bucket by
bucket. Files of the folder are written whole and renamed, so a repeated task leaves the same files.

The folder must be a mounted path that all workers see; by default it lies below ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.llm import words
from kinelake.llm.frames import partitions
from kinelake.llm.shared import array, opened_small, small
from kinelake.session import shared_path

#: Tokens of a counting batch, and of a scoring batch.
BATCH_TOKENS = 1 << 21

#: A context is spread when it starts this share of some batch's n-grams; at most this many are.
HOT_SHARE, MOST_HOT = 1 / 512, 4096

END, BEGIN, EMPTY = np.uint64(3), np.uint64(5), np.uint64(7)
_STEP = np.uint64(0xD6E8FEB86659FD93)

PACKED = "bucket int, contexts binary, runs binary, words binary, counts binary, raw binary"
_PACKED = pa.schema([("bucket", pa.int32())] + [(n, pa.binary()) for n in ("contexts", "runs", "words", "counts", "raw")])
_CONTEXT = np.dtype([("total", "<f8"), ("n1", "<u4"), ("n2", "<u4"), ("n3", "<u4")])


def extended(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of the n-gram that ends a context with a word."""
    return words.mix(context * _STEP + word)


def context_hash(context: list[np.ndarray]) -> np.ndarray:
    """Hash of context words, oldest first."""
    h = np.full(len(context[0]), EMPTY)
    for w in context:
        h = extended(h, w)
    return h


def token_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of each text, an end token after each, and their numbers."""
    w = words.words_of(data, at, words.alphabet(lower=True))
    return np.insert(w.hashes, w.first[1:], END), w.counts + 1


def contexts(tokens: np.ndarray, counts: np.ndarray, length: int) -> list[np.ndarray]:
    """The ``length`` tokens before each token, oldest first; the begin token where the text has none."""
    place = words.spans(counts)
    out = []
    for back in range(length, 0, -1):
        before = np.concatenate([np.full(min(back, len(tokens)), BEGIN), tokens[: max(0, len(tokens) - back)]])
        out.append(np.where(place >= back, before, BEGIN))
    return out


def _batches(frames: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[pa.RecordBatch, int, int]]]]:
    """Tokens of about BATCH_TOKENS at a time, with counts per text and the rows they come from."""
    held, size = [], 0
    for frame in frames:
        for a, b, data, at in words.pieces(frame.column(text)):
            tokens, counts = token_hashes(data, at)
            if size and size + len(tokens) > BATCH_TOKENS:
                yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), [h[2] for h in held]
                held, size = [], 0
            held.append((tokens, counts, (frame, a, b)))
            size += len(tokens)
    if held:
        yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), [h[2] for h in held]


def _routed(context: np.ndarray, whole: np.ndarray, hot: np.ndarray, bits: int) -> np.ndarray:
    """Bucket of an n-gram: by its context, or by all of it where the context is hot."""
    return (np.where(np.isin(context, hot), whole, context) >> np.uint64(64 - bits)).astype(np.int64)


def _packed(gram: list[np.ndarray], counts: np.ndarray, raw: np.ndarray | None, hot: np.ndarray, bits: int) -> pa.RecordBatch:
    """Rows for distinct n-grams (word hashes by place): contexts once per run, then words and counts."""
    context = context_hash(gram[:-1]) if len(gram) > 1 else np.full(len(counts), EMPTY)
    bucket = _routed(context, extended(context, gram[-1]), hot, bits)
    order = np.lexsort((gram[-1], context, bucket))
    gram, counts, context, bucket = [g[order] for g in gram], counts[order], context[order], bucket[order]
    raw = None if raw is None else raw[order]
    cols: dict[str, list] = {k: [] for k in _PACKED.names}
    for a, b in zip(*(lambda s, n: (s.tolist(), (s + n).tolist()))(*words.run_lengths(bucket))):
        at, n = words.run_lengths(context[a:b])
        own = np.concatenate([np.zeros(0, np.uint64), *(g[a:b][at] for g in gram[:-1])])
        row = (int(bucket[a]), own.tobytes(), small(n), gram[-1][a:b].tobytes(), small(counts[a:b]), None if raw is None else small(raw[a:b]))
        for k, v in zip(cols, row):
            cols[k].append(v)
    return pa.RecordBatch.from_pydict(cols, _PACKED)


def _opened(table: pa.Table, order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    parts: list[list[np.ndarray]] = [[] for _ in range(order)]
    counts, raw = [], []
    for r in table.to_pylist():
        last = array(r["words"], np.uint64)
        if order > 1:
            own = array(r["contexts"], np.uint64).reshape(order - 1, -1)
            n = opened_small(r["runs"], own.shape[1])
            for part, c in zip(parts, own):
                part.append(np.repeat(c, n))
        parts[-1].append(last)
        counts.append(opened_small(r["counts"], len(last)))
        raw.append(counts[-1] if r["raw"] is None else opened_small(r["raw"], len(last)))
    return [np.concatenate(p) for p in parts], np.concatenate(counts), np.concatenate(raw)


def _hot_finder(order: int):
    def find(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, counts, _ in _batches(frames, 0):
            for length in range(1, order):
                found, n = np.unique(context_hash(contexts(tokens, counts, length)), return_counts=True)
                hot = found[n >= HOT_SHARE * len(tokens)].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hot), length, np.int32)), pa.array(hot), pa.array(n[n >= HOT_SHARE * len(tokens)])], ["length", "context", "n"])

    return find


def _counter(order: int, hot: dict[int, np.ndarray], bits: int):
    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, counts, _ in _batches(frames, 0):
            before = contexts(tokens, counts, order - 1)
            whole = extended(context_hash(before), tokens)
            _, first, n = np.unique(whole, return_index=True, return_counts=True)
            yield _packed([*(b[first] for b in before), tokens[first]], n, None, hot[order - 1], bits)

    return count


def _write(folder: str, name: str, value: np.ndarray) -> None:
    part = f"{folder}/.{name}.{TaskContext.get().taskAttemptId()}"
    with open(part, "wb") as out:
        out.write(value.tobytes())
    os.replace(part, f"{folder}/{name}")


def _summer(order: int, hot: dict[int, np.ndarray], bits: int, folder: str):
    """Writes a bucket's arrays of one order; returns packed suffixes, or at order 1 nothing more."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        gram, counts, raw = _opened(table, order)
        context = context_hash(gram[:-1]) if order > 1 else np.full(len(counts), EMPTY)
        keys, first, where = np.unique(extended(context, gram[-1]), return_index=True, return_inverse=True)
        total = np.bincount(where, counts).astype(np.int64)
        total_raw = np.bincount(where, raw).astype(np.int64)
        name = f"{order}-{bucket}"
        _write(folder, f"{name}.keys", keys)
        _write(folder, f"{name}.counts", np.minimum(total, 255).astype(np.uint8))
        _write(folder, f"{name}.large", total[total >= 255].astype("<i8"))
        _write(folder, f"{name}.tally", np.array([len(keys), total.sum(), total_raw.sum(), *(np.count_nonzero(total == i) for i in (1, 2, 3, 4)), np.count_nonzero(total >= 3)], "<i8"))
        if order == 1:
            _write(folder, f"{name}.raw", total_raw.astype("<i8"))
            return pa.Table.from_pylist([], _PACKED)
        context, gram = context[first], [g[first] for g in gram]
        by = np.argsort(context, kind="stable")
        at, _ = words.run_lengths(context[by])
        stats = np.zeros(len(at), _CONTEXT)
        ordered = total[by]
        for field, value in (("total", ordered), ("n1", ordered == 1), ("n2", ordered == 2), ("n3", ordered >= 3)):
            stats[field] = np.add.reduceat(value.astype(np.int64), at)
        own = context[by][at]
        spread = np.isin(own, hot[order - 1])
        for end, pick in (("", ~spread), ("-hot", spread)):
            _write(folder, f"{name}{end}.contexts", own[pick])
            _write(folder, f"{name}{end}.stats", stats[pick])
        suffix = gram[1:]
        lower = context_hash(suffix)
        _, first, where = np.unique(lower, return_index=True, return_inverse=True)
        left = np.bincount(where)
        return pa.Table.from_batches([_packed([s[first] for s in suffix], left, np.bincount(where, total_raw).astype(np.int64), hot[order - 2], bits)])

    return run


@dataclass(frozen=True)
class Order:
    """What scoring needs to know of one order beside its arrays."""

    distinct: int
    total: float
    tokens: int
    n1: int
    n2: int
    n3: int
    discounts: tuple[float, float, float]


@dataclass(frozen=True)
class Model:
    folder: str
    order: int
    bits: int
    hot: dict[int, np.ndarray]
    hot_stats: dict[int, np.ndarray]
    orders: dict[int, Order]


def local_folder(path: str) -> str:
    """The mounted path of a file: URL."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"the model folder must be a mounted path that all workers see, not {path}")
    return unquote(url.path)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Discounts of counts 1, 2, and 3 or more, from the numbers of n-grams with counts 1 to 4; where too few
    counts are known, half a count (n1 or n2 is 0) or the discount before."""
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d1 = 1 - 2 * y * n2 / n1
    d2 = 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return max(d1, 0.0), min(max(d2, 0.0), 2.0), min(max(d3, 0.0), 3.0)


def _tally(folder: str, order: int, bits: int) -> Order:
    """Sums one 64-byte file per bucket."""
    rows = [np.fromfile(p, "<i8") for b in range(1 << bits) if os.path.exists(p := f"{folder}/{order}-{b}.tally")]
    distinct, total, tokens, n1, n2, n3, n4, more = (int(x) for x in sum(rows, np.zeros(8, np.int64)))
    return Order(distinct, float(total), tokens, n1, n2, more, discounts(n1, n2, n3, n4))


def train(documents: DataFrame, order: int = 2, text: str = "text", folder: str | None = None) -> Model:
    """Counts n-grams up to ``order`` (2 at least) over all texts and writes the model's arrays.

    A text is its lower-cased words (A-Z; free of ASCII white space) and one end token; null and empty texts are
    the end token alone. No rows give a model under which every token has probability 1.
    """
    if order < 2:
        raise ValueError("order must be 2 at least")
    spark = documents.sparkSession
    folder = local_folder(folder or shared_path(spark, "ngram-model"))
    os.makedirs(folder)
    bits = max(4, (partitions(documents) - 1).bit_length())
    texts = documents.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = texts.mapInArrow(_hot_finder(order), "length int, context long, n long").groupBy("length", "context").agg(F.sum("n").alias("n"))
    found = found.orderBy(F.desc("n"), "context").limit(MOST_HOT).collect()
    hot = {k: np.sort(np.array([r["context"] for r in found if r["length"] == k], np.int64).view(np.uint64)) for k in range(1, order)}
    hot[0] = np.array([EMPTY])
    rows = texts.mapInArrow(_counter(order, hot, bits), PACKED)
    for k in range(order, 0, -1):
        rows = rows.groupBy("bucket").applyInArrow(_summer(k, hot, bits, folder), PACKED)
    rows.write.format("noop").mode("overwrite").save()
    hot_stats = {}
    for k in range(2, order + 1):
        total = np.zeros(len(hot[k - 1]), _CONTEXT)
        for b in range(1 << bits):
            if os.path.exists(f"{folder}/{k}-{b}-hot.contexts"):
                at = np.searchsorted(hot[k - 1], np.fromfile(f"{folder}/{k}-{b}-hot.contexts", np.uint64))
                stats = np.fromfile(f"{folder}/{k}-{b}-hot.stats", _CONTEXT)
                for field in _CONTEXT.names:
                    total[field][at] += stats[field]
        hot_stats[k] = total
    return Model(folder, order, bits, hot, hot_stats, {k: _tally(folder, k, bits) for k in range(1, order + 1)})


class Arrays:
    """A model's arrays, mapped into memory as they are asked for."""

    def __init__(self, model: Model):
        self.model = model
        self.maps: dict[str, np.ndarray] = {}

    def _map(self, name: str, dtype) -> np.ndarray:
        if name not in self.maps:
            path = f"{self.model.folder}/{name}"
            full = os.path.exists(path) and os.path.getsize(path)
            self.maps[name] = np.memmap(path, dtype, "r") if full else np.zeros(0, dtype)
        return self.maps[name]

    def _spots(self, order: int, end: str, keys: np.ndarray, buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each bucket: which keys (sorted within it) are stored there, and where."""
        for a, n in zip(*words.run_lengths(buckets)):
            stored = self._map(f"{order}-{buckets[a]}.{end}", np.uint64)
            if len(stored):
                own = keys[a : a + n]
                at = np.searchsorted(stored, own)
                hit = np.flatnonzero(stored[np.minimum(at, len(stored) - 1)] == own)
                yield int(buckets[a]), a + hit, at[hit]

    def counts(self, order: int, context: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of n-grams, and raw counts where the order is 1."""
        buckets = _routed(context, whole, self.model.hot[order - 1], self.model.bits)
        by = np.lexsort((whole, buckets))
        out, raw = np.zeros(len(by), np.int64), np.zeros(len(by), np.int64)
        for bucket, which, at in self._spots(order, "keys", whole[by], buckets[by]):
            low = self._map(f"{order}-{bucket}.counts", np.uint8)
            found = low[at].astype(np.int64)
            if (found == 255).any():
                large = np.flatnonzero(low == 255)
                found[found == 255] = self._map(f"{order}-{bucket}.large", "<i8")[np.searchsorted(large, at[found == 255])]
            out[by[which]] = found
            if order == 1:
                raw[by[which]] = self._map(f"{order}-{bucket}.raw", "<i8")[at]
        return out, raw

    def stats(self, order: int, context: np.ndarray) -> np.ndarray:
        """Statistics of contexts; zeros where a context is unknown."""
        hot = self.model.hot[order - 1]
        out = np.zeros(len(context), _CONTEXT)
        buckets = (context >> np.uint64(64 - self.model.bits)).astype(np.int64)
        by = np.lexsort((context, buckets))
        for bucket, which, at in self._spots(order, "contexts", context[by], buckets[by]):
            out[by[which]] = self._map(f"{order}-{bucket}.stats", _CONTEXT)[at]
        if len(hot):
            at = np.minimum(np.searchsorted(hot, context), len(hot) - 1)
            own = hot[at] == context
            out[own] = self.model.hot_stats[order][at[own]]
        return out

    def probabilities(self, tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each token after its context, and its raw count in training."""
        model = self.model
        one, where = np.unique(tokens, return_inverse=True)
        empty = np.full(len(one), EMPTY)
        held, raw = self.counts(1, empty, extended(empty, one))
        low = model.orders[1]
        share = np.full(len(one), 1 / (low.distinct + 1))
        p = _interpolated(held, low.discounts, low.total, (low.n1, low.n2, low.n3), share)[where]
        for k in range(2, model.order + 1):
            context = context_hash(contexts(tokens, counts, k - 1))
            whole = extended(context, tokens)
            _, first, where_k = np.unique(whole, return_index=True, return_inverse=True)
            held, _ = self.counts(k, context[first], whole[first])
            seen, where_c = np.unique(context, return_inverse=True)
            s = self.stats(k, seen)[where_c]
            p = _interpolated(held[where_k], model.orders[k].discounts, s["total"], (s["n1"], s["n2"], s["n3"]), p)
        return p, raw[where]


def _interpolated(count, d, total, kinds, lower):
    """Discounted share of the count, and the mass so freed spread by the lower order."""
    cut = np.select([count >= 3, count == 2, count == 1], [d[2], d[1], d[0]], 0.0)
    free = d[0] * kinds[0] + d[1] * kinds[1] + d[2] * kinds[2]
    return np.where(total > 0, (np.maximum(count - cut, 0) + free * lower) / np.maximum(total, 1), lower)


_OPEN: dict[str, Arrays] = {}


def _scorer(shared, text: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        if model.folder not in _OPEN:
            _OPEN.clear()
            _OPEN[model.folder] = Arrays(model)
        low = model.orders[1]
        for tokens, counts, parts in _batches(frames, text):
            p, raw = _OPEN[model.folder].probabilities(tokens, counts)
            at = np.cumsum(counts) - counts
            added = [
                counts, np.add.reduceat((raw > 0).astype(np.int64), at), np.add.reduceat(np.log10(p), at),
                np.add.reduceat(np.log10((raw + 1) / (low.tokens + low.distinct + 1)), at),
            ]
            done = 0
            for frame, a, b in parts:
                own = [pa.array(x[done : done + b - a]) for x in added]
                yield pa.RecordBatch.from_arrays([*(c[a:b] for c in frame.columns), *own], [*frame.schema.names, "n_tokens", "n_known", "score", "base_score"])
                done += b - a

    return run


ADDED = ("n_tokens", "n_known", "score", "base_score")


def score(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents with ``n_tokens``, ``n_known`` (tokens seen in training), ``score`` (log10 probability of the
    text) and ``base_score`` (under add-one unigrams). Perplexity is ``10 ** (-score / n_tokens)``.

    Columns of those names are replaced, others stay. Null and empty texts are the end token alone; repeated
    rows score alike; an empty table gives an empty result.
    """
    base = documents.drop(*ADDED)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + ", n_tokens long, n_known long, score double, base_score double"
    return base.mapInArrow(_scorer(documents.sparkSession.sparkContext.broadcast(model), base.columns.index(text)), schema)
