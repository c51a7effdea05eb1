"""Substring dedup: removal of word windows that an earlier document already starts.

Rabin-Karp hashes of every window of ``n`` consecutive words are counted in Spark by bucket of the hash
(see ``shared``); windows that also start in a document with a smaller id are flagged, and the flagged
windows of a document merge into maximal removal intervals.

Windows are told apart by 64 bits of a hash over random word values: among N distinct windows about
N**2 / 2**65 pairs collide by chance (3e-4 for 1e8 windows).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.llm import shared, words
from kinelake.llm.frames import partitions, text_key, unused

#: Stands for a missing id: later than all others.
NO_ID = 2**63 - 1

SPANS = "owner long, key long, starts array<int>, ends array<int>"
_SPANS = pa.schema([("owner", pa.int64()), ("key", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])


def _packer(n: int, bits: int):
    def flush(batch, ids, keys, n_words, hashes):
        ids, keys, n_words, hashes = map(np.concatenate, (ids, keys, n_words, hashes))
        counts = np.maximum(n_words - n + 1, 0)
        order = np.argsort(ids, kind="stable")  # the first place of a hash is then in its smallest document
        begin = np.cumsum(counts) - counts
        hashes = hashes[np.repeat(begin[order], counts[order]) + words.spans(counts[order])]
        ids, keys, n_words = ids[order], keys[order], n_words[order]
        owners = np.repeat(ids, counts[order])
        found = shared.distinct(hashes)
        body = shared.packed_body(ids=ids.tobytes(), keys=keys.tobytes(), n_words=n_words.tobytes(), repeats=shared.packed_runs(found.later, found.repeats))
        first = found.first
        return shared.packed_rows(batch, hashes[first], owners[first], first, bits, body)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, held, size, names = words.alphabet(), ([], [], [], []), 0, shared.batch_names()
        for batch in batches:
            owner, key = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for a, b, data, at in words.pieces(batch.column(2)):
                text = words.words_of(data, at, kind)
                hashes, _ = words.windows(text, n)
                if size and size + len(hashes) > shared.BATCH_HASHES:
                    yield flush(next(names), *held)
                    held, size = ([], [], [], []), 0
                for part, value in zip(held, (owner[a:b], key[a:b], text.counts, hashes)):
                    part.append(value)
                size += len(hashes)
        if held[0]:
            yield flush(next(names), *held)

    return pack


def _earlier(table: pa.Table) -> pa.Table:
    """Within a bucket: the places of hashes that a smaller owner holds, for each batch."""
    rows = table.to_pylist()
    has = shared.opened(rows)
    order = np.lexsort((has.owners, has.hashes))
    at, n = words.run_lengths(has.hashes[order])
    least = np.repeat(has.owners[order][at], n)
    late = np.zeros(len(order), bool)
    late[order] = has.owners[order] > least
    edges = np.searchsorted(has.row, np.arange(len(has.rows) + 1))
    out = [r for r in rows if r["body"] is not None]
    for r, a, b in zip(has.rows, edges[:-1], edges[1:]):
        if late[a:b].any():
            places = np.sort(has.places[a:b][late[a:b]])
            out.append(dict.fromkeys(shared.PACKED_ARROW.names) | {"bucket": r["bucket"], "batch": r["batch"], "places": shared.packed_runs(places)})
    return pa.Table.from_pylist(out, shared.PACKED_ARROW)


def _merger(n: int):
    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        body = shared.opened_body(rows)
        ids, keys, n_words = (shared.array(body[k], np.int64) for k in ("ids", "keys", "n_words"))
        counts = np.maximum(n_words - n + 1, 0)
        late = np.zeros(counts.sum(), bool)
        for r in rows:
            if r["places"] is not None:
                late[shared.opened_runs(r["places"])[0]] = True
        owners = np.repeat(ids, counts)
        later, repeats = shared.opened_runs(body["repeats"], 2)
        late[later] = late[repeats] | (owners[later] > owners[repeats])
        place = np.flatnonzero(late)
        doc = np.repeat(np.arange(len(ids)), counts)[place]
        before, windows_before = np.cumsum(n_words) - n_words, np.cumsum(counts) - counts
        change = np.zeros(n_words.sum() + 1, np.int32)
        word = before[doc] + place - windows_before[doc]
        np.add.at(change, word, 1)
        np.add.at(change, word + n, -1)
        covered = np.concatenate([[False], np.cumsum(change[:-1]) > 0])
        opens = covered[1:] & ~covered[:-1]
        edge = before[n_words > 0]
        opens[edge] |= covered[1:][edge]
        closes = covered[1:].copy()
        closes[:-1] &= ~covered[2:]
        last = edge - 1
        closes[last[last >= 0]] |= covered[1:][last[last >= 0]]
        opens, closes = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        of = np.searchsorted(before, opens, "right") - 1
        at, k = words.run_lengths(of)
        lists = lambda v: pa.ListArray.from_arrays(np.append(at, len(v)).astype(np.int32), (v - before[of]).astype(np.int32))
        return pa.Table.from_arrays([pa.array(ids[of[at]]), pa.array(keys[of[at]]), lists(opens), lists(closes)], schema=_SPANS)

    return merge


def repeated_spans(documents: DataFrame, n: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Maximal word intervals of each document covered by windows that also start in a smaller ``doc_id``.

    Words are maximal runs of anything but ASCII white space. Returns ``owner`` (the id, or the largest
    long for a missing one), ``key`` (of the text), and the intervals; documents without any have no row.

    Defined cases: a null or empty text and a text shorter than ``n`` words have no window; a null id
    comes after all others; rows with equal ids never remove each other's words; other columns do not
    matter; an empty table gives an empty result. ``documents`` must read the same when read again.
    """
    bits = max(4, (partitions(documents) - 1).bit_length())
    own = F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))
    return (
        documents.select(own.alias("owner"), text_key(F.col(text)).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
        .mapInArrow(_packer(n, bits), shared.PACKED)
        .groupBy("bucket")
        .applyInArrow(_earlier, shared.PACKED)
        .groupBy("batch")
        .applyInArrow(_merger(n), SPANS)
        .dropDuplicates(["owner", "key"])
    )


def _kept(text: int, starts: int, ends: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"n_words": [], "n_removed": [], "kept_text": []}
            for value, a, b in zip(*(batch.column(i).to_pylist() for i in (text, starts, ends))):
                found = value.encode().split() if value else []
                out["n_words"].append(len(found))
                out["n_removed"].append(sum(b) - sum(a) if a else 0)
                for i, j in zip(reversed(a or ()), reversed(b or ())):
                    del found[i:j]
                out["kept_text"].append(b" ".join(found).decode())
            kept = [c for i, c in enumerate(batch.columns) if i not in (starts, ends)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept_text"], pa.string())], [*(n for i, n in enumerate(batch.schema.names) if i not in (starts, ends)), *out])

    return keep


def remove_repeats(documents: DataFrame, n: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with ``n_words``, ``n_removed`` and ``kept_text`` (kept words joined by one space).

    Every row stays, also one that keeps no word. Columns of these names are replaced. See
    ``repeated_spans`` for nulls, ties and short texts.
    """
    base = documents.drop("n_words", "n_removed", "kept_text")
    own, key, starts, ends = unused(base, "owner", "key", "starts", "ends")
    found = repeated_spans(documents, n, doc_id, text).toDF(own, key, starts, ends)
    left = base.withColumns({own: F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)), key: text_key(F.col(text))})
    joined = left.join(found, [own, key], "left").select(*base.columns, starts, ends)
    names = joined.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + ", n_words long, n_removed long, kept_text string"
    return joined.mapInArrow(_kept(names.index(text), names.index(starts), names.index(ends)), schema)
