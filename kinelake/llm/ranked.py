"""Ranked lexical search by the Best Position Algorithm over impact lists.

Documents are cut into shards of bounded size. A shard's index holds, for each term that a query has, the list of
its documents with their counts; impacts follow once the corpus statistics are known, which come from the same
index. A search reads a shard's lists by descending impact, all of a query's lists side by side. For each document
it meets it looks the other lists up directly, and so learns the document's position in each of them too. The best
position of a list is the end of its run of seen positions from the top; no document unseen so far can score more
than the impacts at the best positions add up to. Reading stops once that sum is strictly below the k-th score, so
documents of equal score are never missed. The k-th score carries on from shard to shard within a task.

Queries come in blocks of bounded size: a block's terms are broadcast, and each block scans the documents once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinelake.llm import shared, words
from kinelake.llm.frames import settled

#: Terms in one shard, about, and bytes of text in one block of queries, about.
SHARD_TERMS, BLOCK_BYTES = 1 << 21, 32 << 20

#: Positions first read in every list; each further step reads twice as many.
FIRST_READ = 8

#: Stands for a missing document id, so that it comes last.
NO_ID = (1 << 63) - 1

_LISTS = "ids array<long>, sizes array<int>, keys binary, counts binary, seen array<int>, df array<long>, n_docs long, n_terms long"
_LISTS_ARROW = pa.schema(
    [("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("keys", pa.binary()), ("counts", pa.binary())]
    + [("seen", pa.list_(pa.int32())), ("df", pa.list_(pa.int64())), ("n_docs", pa.int64()), ("n_terms", pa.int64())]
)
_FOUND_ARROW = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])
_TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def terms_of(text: str | None) -> list[str]:
    """The terms of one query: runs of letters and digits, lower-cased in A-Z alone."""
    return [t.decode() for t in _TERM.findall((text or "").encode().lower())]


@dataclass
class Block:
    """Queries in one block: all their terms, and each one's term numbers and repeats."""

    terms: list[str]
    queries: list[tuple[np.ndarray, np.ndarray]]


def block_of(texts: list[str | None]) -> Block:
    counted = [Counter(terms_of(t)) for t in texts]
    terms = sorted(set().union(*counted))
    number = {t: i for i, t in enumerate(terms)}
    return Block(terms, [(np.array([number[t] for t in c], np.int64), np.array(list(c.values()), np.int64)) for c in counted])


def _shard(parts: list[tuple], n_terms: int) -> pa.RecordBatch:
    """One shard: ids and sizes of documents with a query term; keys (term number, document) ascending, and counts."""
    ids, sizes, of, term = (np.concatenate(c) for c in zip(*parts))
    key, tf = np.unique(term * len(ids) + of, return_counts=True)
    held = np.zeros(len(ids), bool)
    held[key % len(ids)] = True
    number = np.cumsum(held) - 1
    docs, term = number[key % len(ids)], key // len(ids)
    df = np.bincount(term, minlength=n_terms)
    seen = np.flatnonzero(df)
    row = {
        "ids": ids[held], "sizes": sizes[held], "keys": shared.packed_ints(np.diff(term * max(1, held.sum()) + docs, prepend=0)),
        "counts": shared.packed_ints(tf), "seen": seen, "df": df[seen], "n_docs": int((sizes > 0).sum()), "n_terms": int(sizes.sum()),
    }
    return pa.RecordBatch.from_pydict({k: [v] for k, v in row.items()}, _LISTS_ARROW)


def _indexer(block):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, alphabet = pa.array(block.value.terms, pa.large_string()), words.alphabet(alnum=True)
        parts, held, before = [], 0, 0
        for batch in batches:
            own = batch.column(0).fill_null(NO_ID).to_numpy()
            for a, b, data, at in words.pieces(batch.column(1)):
                data = _LOWER[data]
                word = alphabet.is_word[data]
                starts, ends = words.word_bounds(word, at)
                counts = np.diff(np.searchsorted(starts, at))
                bounds = np.concatenate([[0], np.cumsum(ends - starts)])
                text = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data[word])])
                term = pc.index_in(text, value_set=terms).fill_null(-1).to_numpy().astype(np.int64)
                hit = np.flatnonzero(term >= 0)
                of = np.repeat(np.arange(b - a), counts)[hit] + before
                parts.append((own[a:b], counts, of, term[hit]))
                held, before = held + len(starts), before + b - a
                if held >= SHARD_TERMS:
                    yield _shard(parts, len(terms))
                    parts, held, before = [], 0, 0
        if parts:
            yield _shard(parts, len(terms))

    return index


@dataclass
class Statistics:
    """Documents with a term, terms in all, and the weight of each of a block's terms."""

    documents: int
    total: int
    weights: np.ndarray


def statistics(lists: DataFrame, n_terms: int) -> Statistics:
    """From the stored lists; the driver receives one row per term of the block."""
    one = lists.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    n = one["n"] or 0
    each = lists.select(F.explode(F.arrays_zip("seen", "df")).alias("t")).groupBy("t.seen").agg(F.sum("t.df").alias("df"))
    weights = np.zeros(n_terms, np.int64)
    for row in each.toLocalIterator():
        weights[row["seen"]] = math.floor(1000 * math.log((2 * n + 2) / (2 * row["df"] + 1)))
    return Statistics(n, one["l"] or 0, weights)


class ImpactLists:
    """One shard in memory: postings by (term, document), and the same by (term, impact descending)."""

    def __init__(self, row: dict, stats: Statistics):
        self.ids = np.asarray(row["ids"], np.int64)
        self.keys, tf = np.cumsum(shared.opened_ints(row["keys"])), shared.opened_ints(row["counts"])
        term, doc = np.divmod(self.keys, max(1, len(self.ids)))
        size = np.asarray(row["sizes"], np.int64)
        m = 100 - 25 + np.array([25 * n * stats.documents // stats.total for n in size.tolist()], np.int64)
        self.impact = stats.weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
        order = np.lexsort((doc, -self.impact, term))
        self.by_impact_doc, self.by_impact = doc[order], self.impact[order]
        self.start = np.searchsorted(term, np.arange(len(stats.weights)))
        self.size = np.bincount(term, minlength=len(stats.weights))
        self.position = np.empty(len(order), np.int64)
        self.position[order] = np.arange(len(order)) - self.start[term]

    def direct(self, terms: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Postings of every document in every list (terms x docs), and whether there is one."""
        wanted = terms[:, None] * len(self.ids) + docs
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return at, self.keys[at] == wanted

    def search(self, terms: np.ndarray, repeats: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (numbers and scores) among which are the k best; ``floor`` is the k-th score known from elsewhere."""
        use = (self.size[terms] > 0) & (self.by_impact[np.minimum(self.start[terms], len(self.keys) - 1)] > 0)
        terms, repeats = terms[use], repeats[use]
        start, size = self.start[terms], self.size[terms]
        seen = [np.zeros(n + 1, bool) for n in size]  # one more, never seen, ends every run
        best = np.zeros(len(terms), np.int64)
        met = np.zeros(len(self.ids), bool)
        docs, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        read, step = 0, FIRST_READ
        while (read < size).any():
            spans = [np.arange(s + min(read, n), s + min(read + step, n)) for s, n in zip(start, size)]
            fresh = np.unique(self.by_impact_doc[np.concatenate(spans)])
            fresh = fresh[~met[fresh]]
            met[fresh] = True
            at, hit = self.direct(terms, fresh)
            docs.append(fresh)
            scores.append((self.impact[at] * hit * repeats[:, None]).sum(axis=0))
            for i, flags in enumerate(seen):
                flags[self.position[at[i][hit[i]]]] = True
                best[i] += int(np.argmin(flags[best[i] :]))
            read, step = read + step, step * 2
            open_lists = best < size
            bound = int((self.by_impact[(start + best - 1)[open_lists]] * repeats[open_lists]).sum())
            held = np.concatenate(scores)
            kth = int(np.partition(held, len(held) - k)[len(held) - k]) if len(held) >= k else 0
            if max(kth, floor) > bound:
                break
        return np.concatenate(docs), np.concatenate(scores)


def _searcher(block, stats: Statistics, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = block.value.queries
        none = np.zeros(0, np.int64)
        found = [(none, none)] * len(queries)  # the k best so far: ids and scores, best first
        for batch in batches:
            for row in batch.to_pylist():
                lists = ImpactLists(row, stats)
                if not len(lists.keys):
                    continue
                for i, (terms, repeats) in enumerate(queries):
                    ids, scores = found[i]
                    floor = int(scores[-1]) if len(scores) == k else 0
                    docs, new = lists.search(terms, repeats, k, floor)
                    good = new >= max(floor, 1)
                    if good.any():
                        ids, scores = np.append(ids, lists.ids[docs[good]]), np.append(scores, new[good])
                        order = np.lexsort((ids, -scores))[:k]
                        found[i] = ids[order], scores[order]
        item = np.repeat(np.arange(len(queries)), [len(s) for _, s in found])
        if len(item):
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.int32()), pa.array(np.concatenate([i for i, _ in found])), pa.array(np.concatenate([s for _, s in found]))], schema=_FOUND_ARROW
            )

    return search


def _blocks(queries: DataFrame) -> Iterator[list]:
    """Rows (id, text) in blocks of about BLOCK_BYTES, dealt by a hash."""
    size = queries.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, math.ceil(size / BLOCK_BYTES))
    for i in range(n):
        yield queries.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i).collect()


def ranked_search(
    documents: DataFrame, queries: DataFrame, k: int = 20, doc_id: str = "doc_id", text: str = "text", query_id: str = "item_id", query_text: str = "text"
) -> DataFrame:
    """The ``k`` documents of highest score for each row of ``queries``: query_id, rank, doc_id, score.

    Terms are runs of ASCII letters and digits and all characters above ASCII, lower-cased in A-Z. With N documents
    that have a term, L terms in all, n terms in a document, df documents with a term and tf of it in a document, a
    term weighs w = floor(1000 ln((2N + 2) / (2 df + 1))), a document has m = 75 + 25 n N div L, and scores the sum of
    w * (10**9 tf div (1000 tf + 12 m)) over the query's terms, repeats included. Only scores above 0 are returned,
    equal ones by ascending doc_id.

    Defined cases: null and empty texts have no terms, so such documents are never found and such queries find
    nothing; repeated rows are documents, or queries, of their own; a null doc_id comes after all others and stays
    null; other columns do not matter; with an empty table on either side the result is empty.
    """
    spark: SparkSession = documents.sparkSession
    base = documents.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    id_type = queries.schema[query_id].dataType.simpleString()
    out = None
    for rows in _blocks(queries.select(F.col(query_id).alias("id"), F.coalesce(query_text, F.lit("")).alias("text"))):
        block = block_of([r["text"] for r in rows])
        sent = spark.sparkContext.broadcast(block)
        lists = settled(base.mapInArrow(_indexer(sent), _LISTS), "impact-lists")
        stats = statistics(lists, len(block.terms))
        found = settled(lists.mapInArrow(_searcher(sent, stats, k), "item int, doc_id long, score long"), "ranked")
        names = spark.createDataFrame([(i, r["id"]) for i, r in enumerate(rows)], f"item int, `{query_id}` {id_type}")
        real = F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id"))
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best = best.join(F.broadcast(names), "item").select(query_id, "rank", real, "score")  # a block of bounded size
        out = best if out is None else out.unionByName(best)
    return out
