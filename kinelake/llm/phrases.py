"""Phrase collocations by set-oriented mining (SETM): relations of occurrences, one level of length after another.

A relation holds where each frequent phrase of one length occurs, sorted by place. It is stored in the shared
folder as one row per batch of documents: ascending places, and for each the number of its phrase in the batch's
list of phrase ids. Places run on by one inside a piece and skip one between pieces, so two occurrences are
neighbours in one piece exactly when their places differ by one. A level

1. merge-joins the relation with itself at neighbouring places: a phrase at p and one at p + 1 that share all but
   their outer words make a phrase longer by one word, named by the pair of their ids;
2. group-counts: each batch sends every distinct pair once, with its count, to the bucket of its hash; the bucket
   adds the counts up and gives an id to each pair that is frequent;
3. semi-joins: buckets answer each batch with the ids of its frequent pairs, and only their occurrences go into the
   next relation.

Words themselves are level one, with (lang, word) in place of the pair. Ids stand for exact words and pairs, so no
hash is ever taken for a phrase. A bucket's share of the work falls with the number of shuffle partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake.llm import shared, words
from kinelake.llm.frames import bucketed, partitions, settled

#: Words in one batch, about; a longer text is a batch of its own.
BATCH_WORDS = 1 << 21

_FIRST = "batch string, buckets binary, codes binary, langs array<string>, words array<string>, n array<long>, places binary, numbers binary"
_RELATION = "batch string, ids array<long>, places binary, numbers binary"
_FIRST_ARROW = pa.schema(
    [("batch", pa.string()), ("buckets", pa.binary()), ("codes", pa.binary()), ("langs", pa.list_(pa.string())), ("words", pa.list_(pa.string()))]
    + [("n", pa.list_(pa.int64())), ("places", pa.binary()), ("numbers", pa.binary())]
)
_RELATION_ARROW = pa.schema([("batch", pa.string()), ("ids", pa.list_(pa.int64())), ("places", pa.binary()), ("numbers", pa.binary())])


#: Pairs on their way to a bucket: packed ids, or words joined by spaces and runs of their languages.
_SENT = "bucket int, batch string, langs array<string>, runs array<long>, x binary, y binary, n binary"
_SENT_ARROW = pa.schema(
    [("bucket", pa.int32()), ("batch", pa.string()), ("langs", pa.list_(pa.string())), ("runs", pa.list_(pa.int64()))]
    + [(c, pa.binary()) for c in ("x", "y", "n")]
)


def _counted(kind: str) -> str:
    """Rows without a batch are frequent pairs; others tell a batch which of its pairs (``at``) these are."""
    return f"batch string, bucket int, at array<int>, id array<long>, x array<{kind}>, y array<{kind}>, n array<long>"


def _arrow(kind: str) -> pa.DataType:
    return pa.list_(pa.string() if kind == "string" else pa.int64())


# What parts words, and what parts pieces as well.
_SPACE = np.isin(np.arange(256), [0x20, 0x09])
_MARK = np.isin(np.arange(256), [ord(c) for c in ".,;:!?\n\v\f\r"])
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)


def _pack_places(places: np.ndarray) -> bytes:
    return zstandard.compress(shared.small(np.diff(places, prepend=0)))


def _open_places(value: bytes, n: int) -> np.ndarray:
    return np.cumsum(shared.opened_small(zstandard.decompress(value), n))


def _by_frequency(numbers: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts frequent ones first, and the occurrences' numbers in that order: they compress better."""
    order = np.argsort(-n, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return order, rank[numbers]


def _flat_words(data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of the texts ``data[at[d]:at[d + 1]]``, whether each opens a piece, and how many each text has."""
    data = _LOWER[data]
    word = ~(_SPACE | _MARK)[data]
    starts, ends = words.word_bounds(word, at)
    marks = np.concatenate([[0], np.cumsum(_MARK[data])])
    opens = np.ones(len(starts), bool)
    opens[1:] = marks[starts[1:]] != marks[ends[:-1]]
    first = np.searchsorted(starts, at)
    opens[first[:-1][first[:-1] < len(starts)]] = True
    bounds = np.concatenate([[0], np.cumsum(ends - starts)])
    text = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data[word])])
    return text, opens, np.diff(first)


def _first_row(batch: str, parts: list[tuple], buckets: int) -> pa.RecordBatch:
    """One batch's words as the relation of level zero: its distinct (lang, word), frequent ones first, and all occurrences."""
    text = pa.chunked_array([p[0] for p in parts], pa.large_string()).combine_chunks().dictionary_encode()
    text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
    opens = np.concatenate([p[1] for p in parts])
    lang = pa.chunked_array([p[2] for p in parts], pa.string()).combine_chunks().dictionary_encode()
    names, known = lang.dictionary.to_pylist(), text.dictionary.to_pylist()
    of = np.repeat(lang.indices.to_numpy(), np.concatenate([p[3] for p in parts]))
    key, number, n = np.unique(text.indices.to_numpy().astype(np.int64) * len(names) + of, return_inverse=True, return_counts=True)
    order, number = _by_frequency(number, n)
    key, n = key[order], n[order]
    langs, found = [names[i] for i in key % len(names)], [known[i] for i in key // len(names)]
    bucket = np.array([zlib.crc32(w.encode(), zlib.crc32(x.encode())) % buckets for x, w in zip(langs, found)], np.int64)
    row = {"batch": batch, "buckets": shared.packed_ints(bucket), "codes": shared.packed_ints(key % len(names)), "langs": langs, "words": found, "n": n}
    row |= {"places": _pack_places(np.arange(len(opens)) + np.cumsum(opens)), "numbers": shared.packed_ints(number)}
    return pa.RecordBatch.from_pydict({k: [v] for k, v in row.items()}, _FIRST_ARROW)


def _occurrences(buckets: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, parts, held = shared.batch_names(), [], 0
        for batch in batches:
            for a, b, data, at in words.pieces(batch.column(1)):
                text, opens, counts = _flat_words(data, at)
                if not len(text):
                    continue
                parts.append((text, opens, batch.column(0)[a:b], counts))
                held += len(text)
                if held >= BATCH_WORDS:
                    yield _first_row(next(names), parts, buckets)
                    parts, held = [], 0
        if parts:
            yield _first_row(next(names), parts, buckets)

    return read


def _neighbours(row: dict, buckets: int) -> dict:
    """The merge join: pairs of phrases at neighbouring places, distinct ones sorted by bucket, and their occurrences."""
    numbers = shared.opened_ints(row["numbers"])
    places = _open_places(row["places"], len(numbers))
    ids = np.asarray(row["ids"], np.int64)
    at = np.flatnonzero(places[1:] == places[:-1] + 1)
    key, number, n = np.unique(numbers[at] * max(1, len(ids)) + numbers[at + 1], return_inverse=True, return_counts=True)
    x, y = ids[key // max(1, len(ids))], ids[key % max(1, len(ids))]
    mixed = words.mix(words.mix(x.astype(np.uint64)) + y.astype(np.uint64))
    bucket = (mixed % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return {"buckets": bucket[order], "x": x[order], "y": y[order], "n": n[order], "places": places[at], "numbers": rank[number]}


def _sender(first: bool, buckets: int):
    """Each batch's distinct pairs and counts, one row per bucket."""

    def rows(row: dict) -> Iterator[dict]:
        if not first:
            row |= _neighbours(row, buckets)
            at, n = words.run_lengths(row["buckets"])
            for a, b in zip(at, at + n):
                packed = {c: shared.packed_ints(row[c][a:b]) for c in ("x", "y")}
                yield {"bucket": int(row["buckets"][a]), "langs": None, "runs": None, **packed, "n": zstandard.compress(shared.small(row["n"][a:b]))}
            return
        of, count = shared.opened_ints(row["buckets"]), np.asarray(row["n"], np.int64)
        lang = shared.opened_ints(row["codes"])
        order = np.lexsort((lang, of))
        at, n = words.run_lengths(of[order])
        for a, b in zip(at, at + n):
            some = order[a:b]
            begin, runs = words.run_lengths(lang[some])
            yield {
                "bucket": int(of[some[0]]), "langs": [row["langs"][some[i]] for i in begin], "runs": runs, "x": None,
                "y": zstandard.compress(" ".join([row["words"][i] for i in some]).encode()), "n": zstandard.compress(shared.small(count[some])),
            }

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if found := list(rows(row)):
                    yield pa.RecordBatch.from_pylist([{"batch": row["batch"], **r} for r in found], _SENT_ARROW)

    return send


def _counter(kind: str, least: int, buckets: int):
    """Adds up the pairs of one bucket; gives ids to frequent ones and answers the batches that hold them."""
    schema = pa.schema(
        [("batch", pa.string()), ("bucket", pa.int32()), ("at", pa.list_(pa.int32())), ("id", pa.list_(pa.int64()))]
        + [("x", _arrow(kind)), ("y", _arrow(kind)), ("n", pa.list_(pa.int64()))]
    )

    def opened(rows: list[dict]) -> tuple[pa.Array, pa.Array]:
        if kind != "string":
            return tuple(pa.array(np.concatenate([shared.opened_ints(r[c]) for r in rows])) for c in ("x", "y"))
        lang = pa.array([x for r in rows for x in r["langs"]], pa.string())
        of = np.repeat(np.arange(len(lang)), [k for r in rows for k in r["runs"]])
        return lang.take(pa.array(of)), pa.array([w for r in rows for w in zstandard.decompress(r["y"]).decode().split(" ")], pa.string())

    def coded(values: pa.Array) -> np.ndarray:
        return (values if kind != "string" else values.dictionary_encode().indices).to_numpy()

    def count(table: pa.Table) -> pa.Table:
        rows = table.sort_by("batch").to_pylist()
        bucket = rows[0]["bucket"]
        x, y = opened(rows)
        parts = [zstandard.decompress(r["n"]) for r in rows]
        sizes = [len(zstandard.decompress(r["x"])) // 8 if r["x"] is not None else sum(r["runs"]) for r in rows]
        n = np.concatenate([shared.opened_small(p, k) for p, k in zip(parts, sizes)])
        a, b = coded(x), coded(y)
        order = np.lexsort((b, a))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)
        at = np.flatnonzero(fresh)
        sums = np.add.reduceat(n[order], at)
        frequent = sums >= least
        ids = np.where(frequent, (np.cumsum(frequent) - 1) * buckets + bucket, -1)
        own = np.empty(len(order), np.int64)
        own[order] = np.repeat(ids, np.diff(np.append(at, len(order))))
        first = pa.array(order[at[frequent]])
        out = {"batch": [None], "bucket": [bucket], "at": [None], "id": [ids[frequent]], "x": [x.take(first)], "y": [y.take(first)], "n": [sums[frequent]]}
        ends = np.cumsum(sizes)
        for row, begin, end in zip(rows, np.append(0, ends[:-1]), ends):
            hit = np.flatnonzero(own[begin:end] >= 0)
            for c, v in zip(out, (row["batch"], bucket, hit, own[begin:end][hit], None, None, None)):
                out[c].append(v)
        return pa.Table.from_pydict(out, schema)

    return count


def _keeper(first: bool, buckets: int):
    """The semi-join: a batch's occurrences of frequent pairs, with the new ids."""

    def keep(relation: pa.Table, answers: pa.Table) -> pa.Table:
        none = _RELATION_ARROW.empty_table()
        if not relation.num_rows or not answers.num_rows:
            return none
        row = relation.to_pylist()[0]
        if first:
            numbers = shared.opened_ints(row["numbers"])
            of = shared.opened_ints(row["buckets"])
            order = np.lexsort((shared.opened_ints(row["codes"]), of))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            row = {"batch": row["batch"], "buckets": of[order], "places": _open_places(row["places"], len(numbers)), "numbers": rank[numbers]}
        else:
            row |= _neighbours(row, buckets)
        known = np.full(len(row["buckets"]), -1, np.int64)
        start = np.searchsorted(row["buckets"], np.arange(buckets))
        for bucket, at, found in zip(*(answers[c].to_pylist() for c in ("bucket", "at", "id"))):
            known[start[bucket] + np.asarray(at, np.int64)] = found
        found = known[row["numbers"]]
        kept = found >= 0
        if not kept.any():
            return none
        ids, numbers, n = np.unique(found[kept], return_inverse=True, return_counts=True)
        order, numbers = _by_frequency(numbers, n)
        packed = {"ids": [ids[order]], "places": [_pack_places(row["places"][kept])], "numbers": [shared.packed_ints(numbers)]}
        return pa.Table.from_pydict({"batch": [row["batch"]], **packed}, _RELATION_ARROW)

    return keep


def _groups(counted: DataFrame) -> DataFrame:
    """Frequent pairs as rows: id, x, y, n."""
    rows = counted.where(F.col("batch").isNull()).select(F.explode(F.arrays_zip("id", "x", "y", "n")).alias("g"))
    return rows.select("g.id", "g.x", "g.y", "g.n")


def _level(relation: DataFrame, kind: str, least: int, buckets: int) -> DataFrame:
    sent = relation.mapInArrow(_sender(kind == "string", buckets), _SENT)
    return settled(sent.groupBy("bucket").applyInArrow(_counter(kind, least, buckets), _counted(kind)), "phrase-counts")


def _next(relation: DataFrame, counted: DataFrame, kind: str, buckets: int) -> DataFrame:
    slim = relation.select("batch", *(["buckets", "codes"] if kind == "string" else ["ids"]), "places", "numbers")
    answers = counted.where(F.col("batch").isNotNull() & (F.size("at") > 0)).select("batch", "bucket", "at", "id")
    kept = slim.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_keeper(kind == "string", buckets), _RELATION)
    return bucketed(kept, "phrase-relation", "batch", buckets)


def _score(a: Column, parts: Column) -> Column:
    """floor(2000000 * a / parts), in decimals: the product may pass 64 bits."""
    exact = F.lit(2_000_000).cast("decimal(10,0)") * a.cast("decimal(20,0)")
    return F.call_function("div", exact, parts.cast("decimal(20,0)"))


def frequent_phrases(documents: DataFrame, least: int = 30, longest: int = 4, lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Phrases of 2 to ``longest`` words that occur ``least`` times in a language, and the words of each language.

    The first frame has length, id, lang, phrase (space-joined), a (occurrences), ``cuts`` (for each cut: after how
    many words, l, r), and the ids of the phrases one word shorter that it holds (x without its last word, y without
    its first). The second has lang and n, the number of all its words. See ``collocations`` for defined cases.
    """
    if longest < 2:
        raise ValueError("a phrase has two words or more")
    buckets = max(1, partitions(documents))
    rows = documents.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    relation, kind = settled(rows.mapInArrow(_occurrences(buckets), _FIRST), "phrase-words"), "string"
    sizes = relation.select(F.explode(F.arrays_zip("langs", "n")).alias("w")).groupBy(F.col("w.langs").alias("lang")).agg(F.sum("w.n").alias("n"))
    counted = _level(relation, kind, least, buckets)
    # heads[i]: occurrences of the first i + 1 words; tails[i]: of all words from the one after those on.
    shorter = _groups(counted).select("id", F.col("x").alias("lang"), F.col("y").alias("phrase"), F.array("n").alias("heads"), F.array("n").alias("tails"))
    levels = []
    for length in range(2, longest + 1):
        relation = _next(relation, counted, kind, buckets)
        kind = "long"
        counted = _level(relation, kind, least, buckets)
        left = shorter.select(F.col("id").alias("x"), "lang", F.col("phrase").alias("left"), "heads")
        right = shorter.select(F.col("id").alias("y"), F.substring_index("phrase", " ", -1).alias("last"), "tails")
        # heads: of the left part, then this one; tails: this one, then those of the right part.
        named = _groups(counted).join(left, "x").join(right, "y").select(
            "id", "x", "y", "lang", F.concat_ws(" ", "left", "last").alias("phrase"), F.col("n").alias("a"),
            F.concat("heads", F.array("n")).alias("heads"), F.concat(F.array("n"), "tails").alias("tails"),
        )
        shorter = settled(named, "phrases")
        cut = [F.struct(F.lit(k).alias("k"), F.get("heads", F.lit(k - 1)).alias("l"), F.get("tails", F.lit(k)).alias("r")) for k in range(1, length)]
        levels.append(shorter.select(F.lit(length).alias("length"), "id", "x", "y", "lang", "phrase", "a", F.array(*cut).alias("cuts")))
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    return found, sizes


def collocations(
    documents: DataFrame, least: int = 30, longest: int = 4, absorb: int = 80, top: int = 2000, lang: str = "lang", text: str = "text"
) -> DataFrame:
    """The ``top`` phrases of each language by how much more they are than their parts.

    Texts are lower-cased in A-Z, cut into pieces at ``.,;:!?`` and line ends, and pieces into words at spaces and
    tabs. A phrase of 2 to ``longest`` words inside a piece with a >= ``least`` occurrences (overlaps included) is a
    candidate; cut after k words, its parts occur l and r times, and its score is floor(2000000 a / (l + r)) at
    the cut where that is least, the first of equal ones. A candidate goes if a longer candidate that holds it has
    ``absorb`` percent of its occurrences or more. (It is enough to look one word up: what lies between occurs at
    least as often as the longest.) Returns lang, rank, phrase, a, l, r, n (words of the language), score.

    Defined cases: a null or empty text has no words; a null language is ``und``; repeated rows count each; equal
    scores go by a, descending, then by the bytes of the phrase; languages without candidates have no row; an empty
    table gives an empty result; other columns do not matter.
    """
    found, sizes = frequent_phrases(documents, least, longest, lang, text)
    held = found.select("length", "a", F.explode(F.array_distinct(F.array("x", "y"))).alias("id")).where("length > 2")
    longer = held.groupBy((F.col("length") - 1).alias("length"), "id").agg(F.max("a").alias("most"))
    left = found.join(longer, ["length", "id"], "left")
    exact = [F.lit(f).cast("decimal(10,0)") * F.col(c).cast("decimal(20,0)") for f, c in ((100, "most"), (absorb, "a"))]
    left = left.where(F.col("most").isNull() | (exact[0] < exact[1]))
    scored = F.transform("cuts", lambda c: F.struct(_score(F.col("a"), c["l"] + c["r"]).alias("score"), c["k"].alias("k"), c["l"].alias("l"), c["r"].alias("r")))
    left = left.select("lang", "phrase", "a", F.array_min(scored).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").cast("long").alias("score")
    )
