"""N-gram Jaccard join: T-occurrence search over inverted lists, by DivideSkip.

1. Every text becomes its set of distinct word n-gram hashes; equal sets form one class.
2. Shingles of only one class cannot lie in any overlap. They are found by counting all shingles by bucket
   (see ``shared``); a class that keeps fewer shared shingles than the least overlap T has no partner.
3. A partner shares one of the rarest shingles of a class (all but the T - 1 most frequent). Classes that
   meet there, directly or through others, form a family; families are packed into cells of bounded size.
4. Within a cell every class is a query against the inverted lists: the short lists are merged and counted,
   the T - 1 long ones are probed by binary search for those candidates that can still reach the required
   overlap. Pairs that are already connected are skipped; any link between unconnected classes is found.

A family beyond one cell is searched in chunks that share a few of its sets; what its chunks left
unconnected is searched again, in cells for every pair of blocks if need be. So no cell grows with the data,
and no link is lost. Sets are told apart by 64-bit signatures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.llm import shared, words
from kinelake.llm.components import components
from kinelake.llm.frames import partitions, settled, text_key, unused

#: Owner of a hash that several classes of a batch hold.
MANY = -1

#: Shingles in one cell, at most.
CELL = 3_000_000

SETS = "doc_id long, n int, sig long, tokens array<long>, shingles binary"
_SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("sig", pa.int64()), ("tokens", pa.list_(pa.int64())), ("shingles", pa.binary())])


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, their number, and the signature of the set (0 if empty).

    A text with fewer words than ``size``, but some, has its whole word sequence as the one shingle.
    """
    w = words.words_of(data, at, words.alphabet(lower=True))
    found, _ = words.windows(w, size)
    counts = np.maximum(w.counts - size + 1, 0)
    short = (w.counts > 0) & (counts == 0)
    if short.any():
        found = np.insert(found, np.cumsum(counts)[short], words.sequence_hashes(w)[short])
        counts = counts + short
    doc = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((found, doc))
    found, doc = found[order], doc[order]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
    found, doc = found[fresh], doc[fresh]
    n = np.bincount(doc, minlength=len(counts)).astype(np.int64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(words.mix(found + np.uint64(1)))])
    ends = np.cumsum(n)
    sig = words.mix(sums[ends] - sums[ends - n] + n.astype(np.uint64)).view(np.int64)
    return found, n, np.where(n > 0, np.where((sig == MANY) | (sig == 0), 1, sig), 0)


def _packer(size: int, bits: int):
    def flush(batch: str, held: list[list]) -> pa.RecordBatch:
        hashes, n, sig, ids = (np.concatenate(h) for h in held[:4])
        null = np.concatenate(held[4])
        _, first = np.unique(sig, return_index=True)  # one document for each class of the batch
        first = np.sort(first[n[first] > 0])
        begin = np.cumsum(n) - n
        hashes = hashes[np.repeat(begin[first], n[first]) + words.spans(n[first])]
        owners = np.repeat(sig[first], n[first])
        found = shared.distinct(hashes)
        weights = np.ones(len(hashes), np.int64)
        np.add.at(weights, found.repeats, 1)
        owners = np.where(weights > 1, MANY, owners)
        body = shared.packed_body(n=n.tobytes(), sig=sig.tobytes(), ids=ids.tobytes(), null=null.tobytes(), first=first.tobytes(), repeats=shared.packed_runs(found.later, found.repeats))
        f = found.first
        return shared.packed_rows(batch, hashes[f], owners[f], f, bits, body, weights[f])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, names = [[] for _ in range(5)], 0, shared.batch_names()
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy()
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for a, b, data, at in words.pieces(batch.column(1)):
                hashes, n, sig = shingle_sets(data, at, size)
                if total and total + len(hashes) > shared.BATCH_HASHES:
                    yield flush(next(names), held)
                    held, total = [[] for _ in range(5)], 0
                for part, value in zip(held, (hashes, n, sig, ids[a:b], null[a:b])):
                    part.append(value)
                total += len(hashes)
        if held[0]:
            yield flush(next(names), held)

    return pack


def _met(table: pa.Table) -> pa.Table:
    """Within a bucket: the hashes that more than one class holds, with their number of holders, for each batch."""
    rows = table.to_pylist()
    has = shared.opened(rows)
    weights = np.concatenate([np.zeros(0, np.int64), *(shared.opened_small(r["weights"], len(r["hashes"]) // 8) for r in has.rows)])
    order = np.argsort(has.hashes, kind="stable")
    at, n = words.run_lengths(has.hashes[order])
    if len(at):
        owners = has.owners[order]
        met = (np.minimum.reduceat(owners, at) != np.maximum.reduceat(owners, at)) | (owners[at] == MANY)
        held = np.add.reduceat(weights[order], at)
        shared_here, holders = np.zeros(len(order), bool), np.zeros(len(order), np.int64)
        shared_here[order], holders[order] = np.repeat(met, n), np.repeat(held, n)
    edges = np.searchsorted(has.row, np.arange(len(has.rows) + 1))
    out = [r for r in rows if r["body"] is not None]
    for r, a, b in zip(has.rows, edges[:-1], edges[1:]):
        k = np.flatnonzero(shared_here[a:b]) + a
        if len(k):
            answer = {"bucket": r["bucket"], "batch": r["batch"], "hashes": has.hashes[k].tobytes(), "places": shared.small(np.diff(has.places[k], prepend=0)), "weights": shared.small(holders[k])}
            out.append(dict.fromkeys(shared.PACKED_ARROW.names) | answer)
    return pa.Table.from_pylist(out, shared.PACKED_ARROW)


def _merger(percent: int):
    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        body = shared.opened_body(rows)
        n, sig, ids, first = (shared.array(body[k], np.int64) for k in ("n", "sig", "ids", "first"))
        null = shared.array(body["null"], bool)
        sizes = n[first]
        hashes, holders = np.zeros(sizes.sum(), np.uint64), np.zeros(sizes.sum(), np.int64)
        for r in rows:
            if r["body"] is None:
                k = len(r["hashes"]) // 8
                place = np.cumsum(shared.opened_small(r["places"], k))
                hashes[place], holders[place] = shared.array(r["hashes"], np.uint64), shared.opened_small(r["weights"], k)
        later, repeats = shared.opened_runs(body["repeats"], 2)
        hashes[later], holders[later] = hashes[repeats], holders[repeats]
        ends = np.cumsum(sizes)
        columns: dict[str, list] = {"doc_id": [None if z else i for i, z in zip(ids.tolist(), null)], "n": n.tolist(), "sig": sig.tolist(), "tokens": [None] * len(n), "shingles": [None] * len(n)}
        least = -(-percent * sizes // 100)
        met = np.add.reduceat(np.append(holders > 0, False), np.append(ends - sizes, len(holders)))[:-1] if len(sizes) else sizes
        for c in np.flatnonzero((met >= least) & (sizes > 0)):
            own, held = hashes[ends[c] - sizes[c] : ends[c]], holders[ends[c] - sizes[c] : ends[c]]
            own, held = own[held > 0], held[held > 0]
            own = own[np.lexsort((own, held))]
            columns["doc_id"].append(None)
            columns["n"].append(int(sizes[c]))
            columns["sig"].append(int(sig[first[c]]))
            columns["tokens"].append(own[: len(own) - int(least[c]) + 1].view(np.int64).tolist())
            columns["shingles"].append(np.sort(own).tobytes())
        return pa.Table.from_pydict(columns, _SETS)

    return merge


def search(sizes: np.ndarray, sets: list[np.ndarray], known: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect the sets (indexes) of one cell, beyond those whose ``known`` label is equal.

    ``sizes``: of the whole sets; ``sets``: their shared shingles, sorted. Every pair with enough overlap is
    connected by the links returned and the labels given.
    """
    rank = np.argsort(sizes, kind="stable")
    sizes, sets = sizes[rank], [sets[i] for i in rank]
    _, root = np.unique(known[rank], return_inverse=True)
    lengths = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), lengths)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    token = token.astype(np.int32)
    spread = np.bincount(token)
    by_list = np.argsort(token, kind="stable")
    lists, list_at = owner[by_list].astype(np.int32), np.concatenate([[0], np.cumsum(spread)])
    full = np.concatenate([[0], np.cumsum(lengths)])
    by_rarity = np.lexsort((spread[token], owner))
    rare = token[by_rarity]
    needed = -(-percent * sizes // 100)
    links = []

    def rest() -> tuple[int, np.ndarray, np.ndarray]:
        """The largest component, and the lists without its members."""
        big = int(np.bincount(root).argmax())
        keep = root[lists] != big
        return big, lists[keep], np.concatenate([[0], np.cumsum(keep)])[list_at]

    big, others, others_at, fresh_at = *rest(), 1
    for q in range(len(sets)):
        if q >= fresh_at:
            big, others, others_at = rest()
            fresh_at = q + max(1, min(q, len(sets) // 16))
        own = rare[full[q] : full[q + 1]]
        own = own[spread[own] > 1]
        cut = len(own) - needed[q] + 1
        if cut <= 0:
            continue
        short, long = own[:cut], own[cut:]
        held, at = (others, others_at) if root[q] == big else (lists, list_at)
        parts = [held[at[t] : at[t + 1]] for t in short]
        merged = np.sort(np.concatenate(parts))
        merged = merged[np.searchsorted(merged, q, "right") :]
        merged = merged[root[merged] != root[q]]
        if not len(merged):
            continue
        start, count = words.run_lengths(merged)
        candidate = merged[start].astype(np.int64)
        need = -(-percent * (sizes[q] + sizes[candidate]) // (100 + percent))
        fit = (count + len(long) >= need) & (100 * sizes[q] >= percent * sizes[candidate])
        candidate, count, need = candidate[fit], count[fit], need[fit]
        if len(candidate) <= len(long):
            probe = np.sort(long)
            for i, c in enumerate(candidate):
                theirs = token[full[c] : full[c + 1]]  # sorted, as equal shingles keep their order
                spot = np.minimum(np.searchsorted(theirs, probe), len(theirs) - 1)
                count[i] += np.count_nonzero(theirs[spot] == probe)
        else:
            for left, t in zip(range(len(long) - 1, -1, -1), long):
                one = lists[list_at[t] : list_at[t + 1]]
                spot = np.minimum(np.searchsorted(one, candidate), len(one) - 1)
                count = count + (one[spot] == candidate)
                alive = count + left >= need
                candidate, count, need = candidate[alive], count[alive], need[alive]
                if not len(candidate):
                    break
        linked = candidate[count >= need]
        if len(linked):
            new, which = np.unique(root[linked], return_index=True)
            links += [(int(rank[q]), int(rank[c])) for c in linked[which]]
            root[np.isin(root, new)] = root[q]
    return links


def _searcher(percent: int):
    def run(table: pa.Table) -> pa.Table:
        sig = table.column("sig").to_numpy()
        _, once = np.unique(sig, return_index=True)
        table = table.take(pa.array(once))
        sig = sig[once]
        sets = [np.frombuffer(b, np.uint64) for b in table.column("shingles").to_pylist()]
        found = search(table.column("n").to_numpy().astype(np.int64), sets, table.column("known").to_numpy(), percent)
        a, b = (np.array([sig[p[i]] for p in found], np.int64) for i in (0, 1))
        return pa.table({"a": a, "b": b})

    return run


def _families(rows: DataFrame) -> DataFrame:
    """(sig, family) for the (sig, token) rows that share tokens."""
    hubs = rows.groupBy("token").agg(F.min("sig").alias("hub"), F.max("sig").alias("top")).where("hub <> top").select("token", "hub")
    met = rows.join(hubs, "token").where("sig <> hub").select(F.col("sig").alias("a"), F.col("hub").alias("b"))
    return components(met).select(F.col("node").alias("sig"), F.col("root").alias("family"))


def _links(classes: DataFrame, percent: int, cell: int) -> DataFrame:
    """(a, b): links between class signatures that connect all similar classes."""
    size = F.octet_length("shingles") / 8
    tokens = classes.select("sig", F.explode("tokens").alias("token"))
    known = classes.select("sig", F.col("sig").alias("known"))
    links, last = None, None
    while True:
        families = settled(_families(tokens), "families")
        members = settled(classes.join(families, "sig").join(known, "sig"), "members")
        held = members.groupBy("family").agg(F.sum(size).alias("held"), F.min("sig").alias("h1"), F.max("sig").alias("h2"), F.max_by("sig", "n").alias("h3"), F.min_by("sig", "n").alias("h4"))
        held = settled(held, "held")
        total, beyond = held.agg(F.sum("held"), F.sum(F.when(F.col("held") > cell, F.col("held")))).first()
        bins = max(1, int(2 * (total or 0) // cell))
        placed = members.join(held, "family")
        named = [F.col(c) for c in ("sig", "n", "shingles", "known")]
        binned = placed.where(F.col("held") <= cell).select(F.concat(F.lit("bin-"), F.pmod(F.xxhash64("family"), F.lit(bins))).alias("cell"), *named)
        chunks = F.ceil(F.col("held") * 2 / cell)
        large = placed.where(F.col("held") > cell)
        block = F.pmod(F.xxhash64("sig"), chunks)
        if beyond is None or last is None or beyond <= last / 2:
            is_hub = F.col("sig").isin(F.col("h1"), F.col("h2"), F.col("h3"), F.col("h4"))
            blocks = F.when(is_hub, F.sequence(F.lit(0).cast("long"), chunks - 1)).otherwise(F.array(block))
            own = F.explode(F.transform(blocks, lambda b: F.concat_ws("-", F.lit("chunk"), "family", b)))
            done = beyond is None
        else:  # chunks no longer help: every pair of blocks, which is exact
            pairs = F.transform(F.sequence(F.lit(0).cast("long"), chunks - 1), lambda b: F.concat_ws("-", F.lit("pair"), "family", F.least(b, block), F.greatest(b, block)))
            own, done = F.explode(pairs), True
        found = binned.unionByName(large.select(own.alias("cell"), *named)).groupBy("cell").applyInArrow(_searcher(percent), "a long, b long")
        links = settled(found if links is None else links.unionByName(found), "links")
        if done:
            return links
        last = beyond
        joined = components(links).select(F.col("node").alias("sig"), F.col("root").alias("known"))
        known = settled(classes.select("sig").join(joined, "sig", "left").select("sig", F.coalesce("known", "sig").alias("known")), "known")
        of_large = large.select("sig", F.explode("tokens").alias("token")).join(known, "sig")
        mixed = of_large.groupBy("token").agg(F.min("known").alias("lo"), F.max("known").alias("hi")).where("lo <> hi").select("token")
        tokens = settled(of_large.join(mixed, "token", "left_semi").select("sig", "token"), "tokens")


def near_duplicates(documents: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", cell: int = CELL) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Two documents are linked when ``100 * intersection >= percent * union`` of their sets of ``size``-word
    shingles (A-Z lower-cased, words free of ASCII white space). ``component_id`` is the smallest id that
    links reach. Null and blank texts have no shingle and are linked with nothing; texts with fewer words
    are one shingle; a null id is never the smallest unless all are null; rows of equal id are separate
    documents; other columns do not matter; an empty table gives an empty result.
    """
    bits = max(4, (partitions(documents) - 1).bit_length())
    sets = (
        documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        .mapInArrow(_packer(size, bits), shared.PACKED)
        .groupBy("bucket").applyInArrow(_met, shared.PACKED)
        .groupBy("batch").applyInArrow(_merger(percent), SETS)
    )
    sets = settled(sets, "shingle-sets")
    classes = settled(sets.where("shingles IS NOT NULL").dropDuplicates(["sig"]).drop("doc_id"), "classes")
    roots = components(_links(classes, percent, cell)).select(F.col("node").alias("sig"), "root")
    docs = sets.where("shingles IS NULL").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "sig")
    least = docs.where("n_shingles > 0").groupBy("sig").agg(F.min("doc_id").alias("least")).join(roots, "sig", "left")
    least = settled(least.select("sig", "least", F.coalesce("root", "sig").alias("root")), "class-roots")
    reached = least.join(least.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("sig", "component_id")
    found = docs.join(reached, "sig", "left")
    return found.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(documents: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of near duplicates, and every text without a shingle. Columns stay.

    Of a group the row of the smallest id stays, of equal ids that of the smallest hash of the text, and of
    rows equal in id and text any one. A null id comes last, so it stays only where all ids of its group are
    null. Rows are told apart by 64 bits of (id, text): other rows of an id that goes are not touched.
    """
    mark, salt, named = unused(documents, "mark", "salt", "named")
    key = text_key(F.col(text))
    row = documents.withColumn(mark, F.xxhash64(F.col(doc_id).isNull(), F.col(doc_id), key))
    found = near_duplicates(row.select(mark, text), size, percent, mark, text).where("n_shingles > 0")
    groups = settled(found.select(F.col("doc_id").alias(mark), F.col("component_id").alias("group")).distinct(), "near-groups")
    order = F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id"), key.alias("key"), F.col(mark).alias("mark"))
    best = row.select(mark, order.alias(named)).join(groups, mark).groupBy("group").agg(F.min(named)["mark"].alias("best"))
    gone = groups.join(best, "group").where(F.col(mark) != F.col("best")).select(mark)
    # texts without a word are in no group, so their equal rows stay
    worded = F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    left = row.join(gone, mark, "left_anti").withColumn(salt, F.when(worded, F.lit(0).cast("long")).otherwise(F.monotonically_increasing_id()))
    return left.dropDuplicates([mark, salt]).select(*documents.columns)
