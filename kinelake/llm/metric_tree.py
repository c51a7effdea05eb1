"""Exact search for the largest inner products by a paged M-tree and best-first search.

Components are floored to integers, so scores are exact. Ordering by inner product becomes ordering by distance with
one more coordinate: with M the largest squared length, x gains sqrt(M - x.x) and a query 0, and the squared distance
is q.q + M - 2 q.x. All triangle-inequality bounds are on these distances, with a margin for rounding; a bound only
ever spares work, and ties are kept.

The root of the tree holds up to ``ROOTS`` routing vectors, a sample by a hash of the id. Every vector goes to the
nearest one; what goes to one root is a subtree, or several when it is large (dealt by a hash, so no task gets more
than a subtree). A subtree is a row of pages: each entry has a vector, its distance to the page's routing vector, and
in inner pages a covering radius and the child page. Of equal vectors only the k + 1 smallest ids (and a missing one) enter the tree, since
a query can use no more; so any number of copies costs nothing.

A search reads all subtrees. For each query it keeps the k best scores so far. Queries go down a subtree together: pages
are visited by the least distance they can hold for one of them, each page once, with the queries that cannot rule it
out, and one matrix product gives the scores of its entries, but for those that the stored distances rule out for all.
Queries come in blocks of bounded size, one pass over the stored tree for each.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinelake.llm import shared
from kinelake.llm.frames import settled

#: Routing vectors of the root; entries of a page; vectors of a subtree, about; bytes of one block of queries.
ROOTS, PAGE, SUBTREE, BLOCK_BYTES = 256, 256, 8192, 16 << 20

#: Queries that go down a subtree together.
TOGETHER = 1024

#: Stands for a missing id, so that it comes last.
NO_ID = (1 << 63) - 1

#: The score of a place among the best that is still free.
FREE = -NO_ID

#: Share of a distance that rounding may be off by.
MARGIN = 1e-9

_TREE = "root int, radius double, first array<int>, ids array<long>, child array<int>, parent array<double>, cover array<double>, vectors binary"
_TREE_ARROW = pa.schema(
    [("root", pa.int32()), ("radius", pa.float64()), ("first", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64())), ("child", pa.list_(pa.int32()))]
    + [("parent", pa.list_(pa.float64())), ("cover", pa.list_(pa.float64())), ("vectors", pa.binary())]
)
_FOUND = "item int, query_id long, vec_id long, score long"
_FOUND_ARROW = pa.schema([("item", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """id and v, floor(256 x) of each component x, of the vectors that are whole and finite."""
    whole = F.forall(embedding, lambda c: F.abs(c.cast("double")) < float("inf"))  # null of a null, false of NaN
    rows = vectors.where(F.coalesce(whole, F.lit(False)))
    return rows.select(F.col(vec_id).cast("long").alias("id"), F.transform(embedding, lambda c: F.floor(c.cast("double") * 256)).alias("v"))


def collapsed(rows: DataFrame, k: int) -> DataFrame:
    """Of equal vectors the k + 1 smallest ids, and a missing one; repeated rows once.

    Each task leaves out repeated rows before one shuffle, and larger ids before the other, so neither meets in one task.
    """
    same = Window.partitionBy("v").orderBy("id")
    return rows.distinct().withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 2).drop("copy")


@dataclass
class Space:
    """Length of the vectors (shorter ones end in zeros), the largest squared length, and a type for exact products.

    No sum of products of two vectors is larger than the largest squared length, whatever its order.
    """

    size: int
    most: int
    dtype: type

    def matrix(self, lists: pa.ListArray) -> np.ndarray:
        out = np.zeros((len(lists), self.size), self.dtype)
        out[np.arange(self.size) < pc.list_value_length(lists).to_numpy()[:, None]] = lists.flatten().to_numpy()
        return out

    def packed(self, flat: np.ndarray, n: int) -> np.ndarray:
        return flat.reshape(n, self.size).astype(self.dtype)

    def lifted(self, v: np.ndarray) -> np.ndarray:
        """With the coordinate that makes all lengths equal."""
        v = v.astype(float)
        return np.column_stack([v, np.sqrt(np.maximum(0.0, self.most - (v * v).sum(axis=1)))])


def distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, ((points - to) ** 2).sum(axis=1)))


def space_of(rows: DataFrame) -> Space | None:
    """From one aggregate over the vectors; None without any."""
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda a, c: a + c * c)
    found = rows.agg(F.max(F.size("v")).alias("size"), F.max(norm).alias("most")).first()
    if found["size"] is None:
        return None
    dtype = np.float32 if found["most"] < 2**24 else np.float64 if found["most"] < 2**53 else np.int64
    return Space(found["size"], found["most"], dtype)


def _assigner(space: Space, roots):
    """The nearest root of each vector."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = roots.value
        square = (to * to).sum(axis=1)
        for batch in batches:
            if batch.num_rows:
                x = space.lifted(space.matrix(batch.column(1)))
                nearest = np.argmin(square - 2 * x @ to.T, axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest, pa.int32())], ["id", "v", "root"])

    return assign


class _Builder:
    """Pages of one subtree, loaded from the top: page 0 is its root."""

    def __init__(self, points: np.ndarray, size: int):
        self.points, self.size = points, size
        self.pages: list[tuple] = []

    def page(self, members: np.ndarray, far: np.ndarray) -> int:
        """A page for the members, given their distances to its routing vector."""
        number = len(self.pages)
        self.pages.append(())
        if len(members) <= self.size:
            self.pages[number] = (members, np.full(len(members), -1), far, np.zeros(len(members)))
            return number
        seeds, nearest, away = self.seeds(members, min(self.size, 2 * math.ceil(len(members) / self.size)))
        child, cover = [], []
        for s in range(len(seeds)):
            own = nearest == s
            child.append(self.page(members[own], away[own]))
            cover.append(away[own].max())
        self.pages[number] = (members[seeds], np.array(child), far[seeds], np.array(cover))
        return number

    def seeds(self, members: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Members far from each other, each member's nearest one, and the distance to it."""
        points = self.points[members]
        chosen, nearest = [0], np.zeros(len(members), np.int64)
        away = distances(points, points[0])
        while len(chosen) < n and away.max() > 0:
            chosen.append(int(np.argmax(away)))
            new = distances(points, points[chosen[-1]])
            closer = new < away
            nearest[closer], away[closer] = len(chosen) - 1, new[closer]
        if len(chosen) == 1:  # all alike: cut evenly
            nearest = np.arange(len(members)) * n // len(members)
            chosen = np.searchsorted(nearest, np.arange(n)).tolist()
        return np.array(chosen), nearest, away


def _subtree(space: Space, roots, page: int):
    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        root = rows["root"][0].as_py()
        v = space.matrix(rows["v"].combine_chunks())
        ids = rows["id"].combine_chunks().fill_null(NO_ID).to_numpy()
        points = space.lifted(v)
        far = distances(points, roots.value[root])
        builder = _Builder(points, page)
        builder.page(np.arange(len(v)), far)
        members, child, parent, cover = (np.concatenate(c) for c in zip(*builder.pages))
        first = np.cumsum([0, *(len(p[0]) for p in builder.pages)])
        row = {"root": root, "radius": float(far.max()), "first": first, "ids": ids[members], "child": child, "parent": parent, "cover": cover}
        row["vectors"] = shared.packed_ints(v[members].astype(np.int64).ravel())
        return pa.Table.from_pydict({k: [x] for k, x in row.items()}, _TREE_ARROW)

    return build


@dataclass
class MetricTree:
    """The stored subtrees, the root's routing vectors (lifted) and their ids; finds up to ``k`` neighbours exactly."""

    subtrees: DataFrame
    space: Space
    roots: np.ndarray
    root_ids: np.ndarray
    k: int


def build_tree(rows: DataFrame, space: Space, k: int, n_roots: int = ROOTS, page: int = PAGE, subtree: int = SUBTREE) -> MetricTree:
    """Writes the tree over ``rows`` (id, v) to the shared folder; they are ``collapsed`` for up to ``k`` neighbours, and read twice."""
    sc = rows.sparkSession.sparkContext
    sample = rows.where(F.col("id").isNotNull()).orderBy(F.xxhash64("id"), "id").limit(n_roots).toArrow()
    sample = sample if len(sample) else rows.limit(1).toArrow()
    roots = space.lifted(space.matrix(sample["v"].combine_chunks()))
    sent = sc.broadcast(roots)  # at most n_roots vectors
    placed = settled(rows.mapInArrow(_assigner(space, sent), "id long, v array<long>, root int"), "placed")
    parts = placed.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / subtree).alias("parts"))  # at most n_roots rows
    dealt = placed.join(F.broadcast(parts), "root").withColumn("part", F.pmod(F.xxhash64("v", "id"), F.col("parts")))
    trees = dealt.select("id", "v", "root", "part").groupBy("root", "part").applyInArrow(_subtree(space, sent, page), _TREE)
    return MetricTree(settled(trees, "metric-tree"), space, roots, sample["id"].fill_null(NO_ID).to_numpy(), k)


class Best:
    """The k best (score, id) of each query, best first, and the distances that bound what may still enter."""

    def __init__(self, own, square, k: int, floor=None):
        """Ids of the queries, squares that turn scores into distances, and k-th scores known before: arrays, or values of one query."""
        self.own, self.square, self.k = np.atleast_1d(own), np.atleast_1d(square), k
        self.scores, self.ids = np.full((len(self.own), k), FREE), np.full((len(self.own), k), NO_ID)
        self.floor = np.full(len(self.own), FREE if floor is None else floor)
        self.least, self.reach = self.floor.copy(), np.zeros(len(self.own))
        self.bound(np.arange(len(self.own)))

    def distances(self, scores: np.ndarray, rows=slice(None)) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, self.square[rows] - 2.0 * scores))

    def bound(self, rows: np.ndarray) -> None:
        """Scores below ``least`` and distances above ``reach`` cannot enter any more."""
        self.least[rows] = least = np.maximum(self.floor[rows], self.scores[rows, -1])
        reach = self.distances(least, rows) * (1 + MARGIN) + MARGIN * (1 + np.sqrt(self.square[rows]))
        self.reach[rows] = np.where(least > FREE, reach, np.inf)

    def add(self, ids: np.ndarray, scores: np.ndarray, rows: np.ndarray | None = None) -> None:
        """The scores of the vectors ``ids``, in a line for each query, or for those numbered in ``rows`` (ascending)."""
        rows = np.arange(len(self.own)) if rows is None else rows
        line, column = np.divmod(np.flatnonzero(scores >= self.least[rows, None].astype(scores.dtype)), len(ids))
        other = ids[column] != self.own[rows[line]]
        line, column = line[other], column[other]
        if not len(line):
            return
        changed = rows[np.unique(line)]
        query = np.append(np.repeat(changed, self.k), rows[line])
        ids = np.append(self.ids[changed], ids[column])
        scores = np.append(self.scores[changed], scores[line, column].astype(np.int64))
        order = np.lexsort((ids, -scores, query))
        first = order[np.searchsorted(query[order], changed)[:, None] + np.arange(self.k)]
        self.ids[changed], self.scores[changed] = ids[first], scores[first]
        self.bound(changed)


class Subtree:
    """One stored row in memory."""

    def __init__(self, row: dict, space: Space):
        self.root, self.radius, self.space = row["root"], row["radius"], space
        self.first, self.child = np.asarray(row["first"], np.int64), np.asarray(row["child"], np.int64)
        self.ids = np.asarray(row["ids"], np.int64)
        self.parent, self.cover = np.asarray(row["parent"]), np.asarray(row["cover"])
        self.vectors = space.packed(shared.opened_ints(row["vectors"]), len(self.ids))

    def search(self, q: np.ndarray, away, best: Best) -> None:
        """Best-first, one query or a row for each: pages by the least distance they can hold for one of them.

        ``away`` has the distances to the root's vector. Each page is visited once, with the queries that cannot rule it out.
        """
        q, away = np.atleast_2d(q), np.atleast_1d(away)
        heap = [(0.0, 0, self.radius, np.arange(len(q)), away)]
        while heap:
            _, page, cover, rows, d = heapq.heappop(heap)
            able = d - cover <= best.reach[rows]
            rows, d = rows[able], d[able]
            if not len(rows):
                continue
            reach = best.reach[rows]
            a, b = self.first[page], self.first[page + 1]
            parent, cover = self.parent[a:b], self.cover[a:b]
            near = a + np.flatnonzero((parent + cover >= (d - reach).min()) & (parent - cover <= (d + reach).max()))
            if not len(near):
                continue
            whole = len(rows) == len(q)
            scores = (q if whole else q[rows]) @ self.vectors[near].T
            if self.child[a] >= 0:
                self.push(heap, near, scores, rows, best)
            elif whole:
                best.add(self.ids[near], scores)
            else:
                best.add(self.ids[near], scores, rows)

    def push(self, heap: list, entries: np.ndarray, scores: np.ndarray, rows: np.ndarray, best: Best) -> None:
        """The pages below the entries, each with the queries that cannot rule it out."""
        for entry, score in zip(entries, scores.T):
            d, cover = best.distances(score, rows), self.cover[entry]
            able = d - cover <= best.reach[rows]
            if able.any():
                least = max(0.0, float(d[able].min() - cover))
                heapq.heappush(heap, (least, int(self.child[entry]), cover, rows[able], d[able]))


def _searcher(space: Space, block, roots, root_ids: np.ndarray, k: int):
    def groups(ids: np.ndarray, q: np.ndarray, to: np.ndarray) -> Iterator[tuple[np.ndarray, Best]]:
        for at in range(0, len(ids), TOGETHER):
            own, some = ids[at : at + TOGETHER], q[at : at + TOGETHER]
            sample = (some @ to.T).astype(np.int64)  # scores of the roots, which are vectors too
            sample[own[:, None] == root_ids] = FREE
            floor = np.partition(sample, len(to) - k, axis=1)[:, len(to) - k] if len(to) > k else None
            yield some, Best(own, (some.astype(float) ** 2).sum(axis=1) + space.most, k, floor)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = roots.value[:, :-1].astype(space.dtype)
        searched = list(groups(*block.value, to))
        for batch in batches:
            for row in batch.to_pylist():
                tree = Subtree(row, space)
                for some, best in searched:
                    tree.search(some, best.distances(some @ to[tree.root]), best)
        for at, (_, best) in enumerate(searched):
            line, place = np.nonzero(best.scores > FREE)
            columns = (at * TOGETHER + line).astype(np.int32), best.own[line], best.ids[line, place], best.scores[line, place]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_FOUND_ARROW)

    return search


def nearest(tree: MetricTree, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` best vectors for each row (id, v) of ``queries``, own id left out."""
    if k > tree.k:
        raise ValueError(f"the tree holds the copies that {tree.k} neighbours need, not {k}")
    sc, space = queries.sparkSession.sparkContext, tree.space
    roots = sc.broadcast(tree.roots)
    queries = settled(queries, "queries")
    subtrees = tree.subtrees.repartition(2 * sc.defaultParallelism)  # a file may hold any number of them
    n = max(1, math.ceil(queries.count() * (space.size + 2) * 8 / BLOCK_BYTES))
    out = None
    for i in range(n):
        rows = queries.where(F.pmod(F.xxhash64("id", "v"), F.lit(n)) == i).toArrow()  # BLOCK_BYTES, about
        ids, q = rows["id"].to_numpy(), space.matrix(rows["v"].combine_chunks())
        alike = np.argsort(np.argmax(q @ tree.roots[:, :-1].T, axis=1), kind="stable")  # queries of one root go down together
        block = sc.broadcast((ids[alike], q[alike]))
        found = settled(subtrees.mapInArrow(_searcher(space, block, roots, tree.root_ids, k), _FOUND), "nearest")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("vec_id"))
        top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        top = top.select("query_id", "rank", F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score")
        out = top if out is None else out.unionByName(top)
    return out


def exact_top_k(vectors: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """For each vector whose id is divisible by ``every``: the ``k`` others of largest integer inner product.

    Components x count as floor(256 x). Returns query_id, rank (from 1), vec_id, score; equal scores by smaller id.

    Defined cases: vectors that are null or hold a null or non-finite component take no part; rows of equal id and
    equal vector count once, rows of equal id and other vectors are vectors and queries of their own that never
    find each other; a null id asks nothing, loses every tie, and stays null; vectors of unequal length count as if the
    shorter ended in zeros, an empty one as all zeros; scores must fit 64 bits; other columns do not matter; without
    vectors, or with one alone, the result is empty. ``vectors`` is read twice: for the tree, and for the queries.
    """
    rows = settled(collapsed(quantised(vectors, vec_id, embedding), k), "vectors")
    space = space_of(rows)
    if space is None:
        none = F.lit(None).cast("long")
        return rows.select(none.alias("query_id"), none.cast("int").alias("rank"), none.alias("vec_id"), none.alias("score")).limit(0)
    asked = vectors.where(F.col(vec_id).cast("long") % every == 0)
    return nearest(build_tree(rows, space, k), quantised(asked, vec_id, embedding).distinct(), k)
