"""Benchmark decontamination: training windows that occur in a broadcast set of benchmark n-grams.

Benchmark items are cut into windows of ``n`` normalised words (an item of fewer words is one window).
The set is broadcast up to ``max_set_bytes``; a larger benchmark is taken in slices of at most that size,
one scan of the documents per slice, so nothing that grows is ever broadcast. Hash hits are verified
word for word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.llm import words
from kinelake.llm.frames import settled



def _gram(w: words.Words, first: int, n: int) -> bytes:
    return b" ".join(w.data[a:b].tobytes() for a, b in zip(w.starts[first : first + n], w.ends[first : first + n])).lower()


def _item_grams(n: int):
    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"item": [], "gram": []}
            for item, text in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                w = words.words_of(*words.text_bytes(pa.array([text], pa.string())), words.alphabet(alnum=True, lower=True))
                total = len(w.starts)
                size = min(n, total)
                found = {_gram(w, i, size) for i in range(total - size + 1)} if total else ()
                out["item"] += [item] * len(found)
                out["gram"] += found
            yield pa.RecordBatch.from_pydict(out, pa.schema([("item", pa.string()), ("gram", pa.binary())]))

    return grams


@dataclass
class GramSet:
    """Grams by length: sorted hashes, and for each hash its grams with their items."""

    hashes: dict[int, np.ndarray]
    grams: dict[int, dict[int, list[tuple[bytes, list[str]]]]]

    @classmethod
    def of(cls, rows: list[tuple[str, bytes]]) -> GramSet:
        items = defaultdict(list)
        for item, gram in rows:
            items[bytes(gram)].append(item)
        by: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for gram, own in items.items():
            w = words.words_of(*words.text_bytes(pa.array([gram.decode()])), words.alphabet(alnum=True, lower=True))
            size = len(w.starts)
            by[size][int(words.windows(w, size)[0][0])].append((gram, sorted(set(own))))
        return cls({k: np.sort(np.array(list(v), np.uint64)) for k, v in by.items()}, {k: dict(v) for k, v in by.items()})

    def hits(self, w: words.Words) -> Iterator[tuple[int, int, list[str]]]:
        """First word, length and items of every window of the texts that is in the set."""
        for size, known in self.hashes.items():
            found, place = words.windows(w, size)
            at = np.searchsorted(known, found)
            at[at == len(known)] = 0
            for i in np.flatnonzero(known[at] == found):
                first = int(place[i])
                seen = _gram(w, first, size)
                for gram, items in self.grams[size][int(found[i])]:
                    if gram == seen:
                        yield first, size, items


def _scan(grams, text: int, before: tuple[int, int] | None):
    """Adds the word count, merged hit intervals in bytes and words, and items; joins those of an earlier slice."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, kind = grams.value, words.alphabet(alnum=True, lower=True)
        for batch in batches:
            n_words, marks, items = [], [], []
            for a, b, data, at in words.pieces(batch.column(text)):
                w = words.words_of(data, at, kind)
                n_words.append(w.counts)
                hit = np.zeros(len(w.starts) + 1, np.int32)
                own: dict[int, set[str]] = defaultdict(set)
                for first, size, names in known.hits(w):
                    hit[first] += 1
                    hit[first + size] -= 1
                    own[int(np.searchsorted(w.first, first, "right")) - 1].update(names)
                covered = np.cumsum(hit[:-1]) > 0
                for d in range(b - a):
                    if d in own:
                        c = covered[w.first[d] : w.first[d + 1]]
                        starts, lengths = words.run_lengths(c)
                        keep = c[starts]
                        marks.append([(int(s), int(s + k), int(w.starts[w.first[d] + s] - at[d]), int(w.ends[w.first[d] + s + k - 1] - at[d])) for s, k in zip(starts[keep], lengths[keep])])
                    else:
                        marks.append([])
                    items.append(sorted(own[d]) if d in own else [])
            columns, names = list(batch.columns), list(batch.schema.names)
            if before:
                for i, (m, t) in enumerate(zip(*(batch.column(k).to_pylist() for k in before))):
                    if m:
                        marks[i] = _merged([*marks[i], *((x["word"], x["word_end"], x["byte"], x["byte_end"]) for x in m)])
                        items[i] = sorted({*items[i], *t})
                columns = [c for i, c in enumerate(columns) if i not in (*before, before[0] - 1)]
            fields = ("word", "word_end", "byte", "byte_end")
            lists = pa.array([[dict(zip(fields, x)) for x in m] for m in marks], pa.list_(pa.struct([(k, pa.int64()) for k in fields])))
            n_words = pa.array(np.concatenate([np.zeros(0, np.int64), *n_words]), pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, n_words, lists, pa.array(items, pa.list_(pa.string()))], [*names[: len(columns)], "n_words", "spans", "items"])

    return scan


def _merged(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    out: list[tuple[int, int, int, int]] = []
    for s in sorted(spans):
        if out and s[0] <= out[-1][1]:
            if s[1] > out[-1][1]:
                out[-1] = (out[-1][0], s[1], out[-1][2], s[3])
        else:
            out.append(s)
    return out


ADDED = "n_words long, spans array<struct<word: long, word_end: long, byte: long, byte_end: long>>, items array<string>"


def contamination(documents: DataFrame, benchmark: DataFrame, n: int = 10, max_set_bytes: int = 64 << 20, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents with ``n_words``, ``spans`` (maximal runs of hit words, in words and bytes) and ``items``.

    Words are runs of letters, digits and non-ASCII characters with A-Z lower-cased. Columns of those
    names are replaced; all others stay. Null or empty texts have no words; a null item text is no window,
    a null item id is named ''; repeated items and rows count alike; an empty benchmark hits nothing.
    """
    spark = documents.sparkSession
    grams = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("text")).mapInArrow(_item_grams(n), "item string, gram binary")
    size = grams.agg(F.sum(F.length("gram") + F.length("item") + 200)).first()[0] or 0
    slices = max(1, -(-size // max_set_bytes))
    frame = documents.drop("n_words", "spans", "items")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema) + ", " + ADDED
    at, before = frame.columns.index(text), None
    for i in range(slices):
        own = grams if slices == 1 else grams.where(F.pmod(F.xxhash64("gram"), F.lit(slices)) == i)
        known = spark.sparkContext.broadcast(GramSet.of([(r["item"], r["gram"]) for r in own.collect()]))
        frame = frame.mapInArrow(_scan(known, at, before), schema)
        if slices > 1:
            frame = settled(frame, "decontaminate")
        before = (len(frame.columns) - 2, len(frame.columns) - 1)
    return frame


def _cut(text: int, spans: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for i, found in enumerate(batch.column(spans).to_pylist()):
                if found:
                    raw = texts[i].encode()
                    for s in reversed(found):
                        raw = raw[: s["byte"]] + raw[s["byte_end"] :]
                    texts[i] = raw.decode()
            columns = list(batch.columns)
            columns[text] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return cut


def decontaminate(documents: DataFrame, benchmark: DataFrame, n: int = 10, remove: str = "documents", **options) -> DataFrame:
    """Drops documents with a hit, or only the hit ``remove="spans"`` from their texts. Columns stay as they are."""
    found = contamination(documents, benchmark, n, **options)
    if remove == "documents":
        kept = found.where(F.size("spans") == 0)
    elif remove == "spans":
        names = found.columns
        text = names.index(options.get("text", "text"))
        kept = found.mapInArrow(_cut(text, names.index("spans")), found.schema)
    else:
        raise ValueError(f"remove must be documents or spans, not {remove!r}")
    return kept.drop("n_words", "spans", "items")
