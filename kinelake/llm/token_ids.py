"""Token ids of whole texts as ORC files in ascending id order, and readers of those files.

Ids are integers under ORC's run-length encoding; files carry row indexes and a Bloom filter on the
document id, so a look-up by id prunes files, stripes and row groups, and a full read splits by stripe.

The tokenizer runs on pieces of a text that it would never join: white-space-separated chunks, cut once
more between an ASCII or Latin-1 letter and ASCII punctuation. A worker encodes a distinct chunk (told apart by its
bytes) once and then copies its ids, as long as the chunk comes up again within two generations of the cache; the ids equal those of encoding the whole text at once, because
normalisation and pre-tokenisation never reach over such a cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinelake.llm import words
from kinelake.llm.frames import text_key
from kinelake.session import shared_path

#: Chunks in each of the two generations that a worker remembers (about 300 bytes each).
KNOWN_CHUNKS = 120_000

#: New chunks that go through the tokenizer as one text.
CHUNKS_AT_ONCE = 500

ORC_OPTIONS = {
    "compression": "zstd",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.stripe.size": str(32 << 20),
}

#: doc_id, number and place of the ids within the shard, and the ids.
SCHEMA = "doc_id long, n_tokens long, first long, shard int, ids array<int>"

_LETTER, _MARK, _GLUE, _SPACE = 1, 2, 3, 0


def _classes() -> np.ndarray:
    """White space, letters and digits, punctuation that may be cut off, and bytes that are never cut next to."""
    code = np.arange(256)
    kind = np.full(256, _MARK)
    kind[(code == 0x20) | ((code >= 9) & (code <= 13))] = _SPACE
    kind[((code >= 48) & (code <= 57)) | ((code >= 65) & (code <= 90)) | ((code >= 97) & (code <= 122))] = _LETTER
    kind[(code >= 0x80) | (code < 0x20) & (kind != _SPACE) | (code == 0x7F)] = _GLUE
    kind[[ord(c) for c in "'<|>"]] = _GLUE
    return kind


class Generation:
    """Chunks by number, and their ids one after another."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.ids, self.at = np.zeros(1 << 18, np.int32), np.zeros(1 << 14, np.int64)

    def add(self, chunks: list[bytes], ids: np.ndarray, counts: np.ndarray) -> None:
        have, more = len(self.known), len(chunks)
        used = int(self.at[have])
        if have + more + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros(max(len(self.at), more + 1), np.int64)])
        if used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.int32)])
        self.at[have + 1 : have + 1 + more] = used + np.cumsum(counts)
        self.ids[used : used + len(ids)] = ids
        self.known.update(zip(chunks, range(have, have + more)))

    def get(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the numbered chunks one after another, and how many each has."""
        begin = self.at[numbers]
        count = self.at[numbers + 1] - begin
        return self.ids[np.repeat(begin, count) + words.spans(count)], count


class Encoder:
    """Whole texts to ids. A full generation of chunks gives way to a new one, which takes over what is asked for again."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = _classes()
        self.new, self.old = Generation(), Generation()

    def _learn(self, chunks: list[bytes]) -> None:
        """Takes chunks over from the last generation, or encodes them, many to a text with spaces between."""
        again = [c for c in chunks if c in self.old.known]
        if again:
            self.new.add(again, *self.old.get(np.fromiter(map(self.old.known.__getitem__, again), np.int64, len(again))))
        fresh = [c for c in chunks if c not in self.old.known]
        for i in range(0, len(fresh), CHUNKS_AT_ONCE):
            some = [c.decode() for c in fresh[i : i + CHUNKS_AT_ONCE]]
            found = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            begin = np.cumsum([0, *(len(c) + 1 for c in some)])
            place = np.fromiter((o[0] for o in found.offsets), np.int64, len(found))
            counts = np.diff(np.searchsorted(place, begin))
            self.new.add(fresh[i : i + CHUNKS_AT_ONCE], np.array(found.ids, np.int32), counts)

    def _chunks(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        kind = self.kind[data]
        before, after = kind[:-1], kind[1:]
        accented = np.zeros(n, bool)  # the second byte of a Latin-1 letter
        accented[1:] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        letter_end = (before == _LETTER) | accented[:-1]
        letter_start = after == _LETTER
        letter_start[:-1] |= (data[1:-1] == 0xC3) & accented[2:]
        cut = np.ones(n + 1, bool)
        cut[1:-1] = (before == _SPACE) | (after == _SPACE) | letter_end & (after == _MARK) | (before == _MARK) & letter_start
        cut[at] = True
        edges = np.flatnonzero(cut)
        full = kind[edges[:-1]] != _SPACE
        return edges[:-1][full], edges[1:][full]

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts ``data[at[d]:at[d + 1]]``, and how many each has."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(at) - 1, np.int64)
        if len(self.new.known) > KNOWN_CHUNKS:
            self.new, self.old = Generation(), self.new
        exact = b"<|" in data.tobytes()  # special tokens keep their case
        data = data if exact else words.alphabet(lower=True).fold[data]
        starts, ends = self._chunks(data, at)
        bounds = np.concatenate([[0], np.cumsum(ends - starts)])
        flat = data[self.kind[data] != _SPACE]  # chunks are all but the white space
        found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(flat)]).dictionary_encode()
        chunks = found.dictionary.to_pylist()
        if new := [c for c in chunks if c not in self.new.known]:
            self._learn(new)
        known = np.fromiter(map(self.new.known.__getitem__, chunks), np.int64, len(chunks))
        ids, count = self.new.get(known[found.indices.to_numpy()])
        total = np.concatenate([[0], np.cumsum(count)])
        return ids, np.diff(total[np.searchsorted(starts, at)])


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str, end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        shard, first = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b, data, at in words.pieces(batch.column(1)):
                ids, counts = _ENCODERS[path].encode(data, at)
                ids = np.insert(ids, np.cumsum(counts), end_id).astype(np.int32)
                counts = counts + 1
                ends = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[a:b],
                        pa.array(counts),
                        pa.array(first + ends - counts),
                        pa.array(np.full(b - a, shard, np.int32)),
                        pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(ids)),
                    ],
                    ["doc_id", "n_tokens", "first", "shard", "ids"],
                )
                first += int(ends[-1]) if len(ends) else 0
        pa.default_memory_pool().release_unused()

    return encode


def write_token_ids(documents: DataFrame, path: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encodes every text, appends ``end_id``, and writes ORC files in ascending id order.

    Shards are ranges of ids, so file order is id order. A null or empty text is the end id alone; a null
    id comes first; rows of equal id are ordered by a hash of the text (rows equal in both are
    interchangeable); other columns are left out; an empty table gives files without rows.
    """
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), text_key(F.col(text)).alias("tie"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    ordered.mapInArrow(_encoder(tokenizer, end_id), SCHEMA).write.options(**ORC_OPTIONS).orc(path)


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows. Filters on ``doc_id`` reach the files' statistics, row indexes and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """The number of ids before each shard: one row per shard, from two small columns."""
    totals = read_token_ids(spark, path).groupBy("shard").agg(F.sum("n_tokens").alias("held"))
    before = F.sum("held").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return totals.select("shard", F.coalesce(before, F.lit(0)).alias("before"))


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(4)
        raw = memoryview(lists.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes())
        ends = 4 * np.cumsum([0, *lists.value_lengths().to_numpy(zero_copy_only=False)])
        sums = [zlib.crc32(raw[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sums, pa.int64())], ["doc_id", "n_tokens", "first", "shard", "ids_crc32"])


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """From the files: each document's place in the whole sequence, length, and CRC-32 of its ids."""
    sums = read_token_ids(spark, path).mapInArrow(_checksums, "doc_id long, n_tokens long, first long, shard int, ids_crc32 long")
    return sums.join(shard_starts(spark, path), "shard").select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def store(documents: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> str:
    """Writes to a fresh folder below the shared root and returns its path."""
    path = shared_path(documents.sparkSession, "token-ids")
    write_token_ids(documents, path, tokenizer, end_id, doc_id, text)
    return path
