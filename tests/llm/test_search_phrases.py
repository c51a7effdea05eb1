"""Exact top-k, phrases and ranked search against plain restatements on odd tables."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from kinelake.llm.metric_tree import Best, Subtree, build_tree, exact_top_k, nearest, quantised, space_of
from kinelake.llm.phrases import collocations, frequent_phrases
from kinelake.llm.ranked import Statistics, block_of, ranked_search


def plain_top_k(rows, k, every):
    ok = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = Counter()
    for i, q in ok:
        if i is not None and i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v)), j is None, j or 0) for j, v in ok if j != i)
            out.update((i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(found[:k]))
    return out


def top_k(frame, **more):
    return Counter(map(tuple, exact_top_k(frame, **more).select("query_id", "rank", "vec_id", "score").collect()))


def test_top_k_on_odd_vectors(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(400)]
    copy = rows[7][1]
    rows += [(1000 + i, copy) for i in range(60)] + [(1000, copy), (None, copy), (None, rows[3][1])]  # a hot vector, repeated rows, no id
    rows += [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (2010, []), (2020, [0.5, -0.25]), (2030, [0.0] * 8)]
    rows += [(50, [rng.gauss(0, 1) for _ in range(8)]), (-50, [9.0] * 8)]  # an id with two vectors; a negative one
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("mine")).withColumn("root", F.lit(1))
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    assert top_k(frame, k=5, every=10) == plain_top_k(rows, 5, 10)
    assert top_k(frame.limit(0), k=5) == Counter()
    assert top_k(frame.where("vec_id = 50").limit(1), k=5) == Counter()
    assert top_k(frame.where("vec_id IN (50, 51)"), k=5, every=50) == plain_top_k([r for r in rows if r[0] in (50, 51)], 5, 50)


def test_pages_of_many_levels(spark):
    """Small pages and subtrees, so that the tree is deep; and big components, beyond what doubles multiply exactly."""
    rng = np.random.default_rng(5)
    for scale in (1.0, 3e5):
        v = rng.normal(size=(600, 6)) * scale
        frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
        rows = quantised(frame)
        space = space_of(rows)
        assert (space.dtype is np.int64) == (scale > 1)
        tree = build_tree(rows, space, 5, n_roots=6, page=4, subtree=60)
        assert tree.subtrees.agg(F.max(F.size("first"))).first()[0] > 20 and tree.subtrees.count() > 6
        got = Counter(map(tuple, nearest(tree, rows.where("id % 20 = 0"), 5).select("query_id", "rank", "vec_id", "score").collect()))
        assert got == plain_top_k([(i, x.tolist()) for i, x in enumerate(v)], 5, 20)


def test_bounds_spare_distances(spark):
    """With clusters far apart, most pages are never opened."""
    rng = np.random.default_rng(6)
    v = (rng.normal(size=(40, 1, 8)) * 20 + rng.normal(size=(40, 50, 8)) * 0.05).reshape(-1, 8)
    rows = quantised(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>"))
    space = space_of(rows)
    tree = build_tree(rows, space, 5, n_roots=1, page=16, subtree=4000)
    sub = Subtree(tree.subtrees.collect()[0].asDict(), space)
    leaves = [sub.vectors[a:b] for a, b in zip(sub.first, sub.first[1:]) if sub.child[a] < 0]
    opened = []

    class Watched(Best):
        def add(self, ids, scores):
            opened.append(len(ids))
            super().add(ids, scores)

    q = sub.vectors[np.argmax((sub.vectors**2).sum(axis=1))]
    square = float((q * q).sum()) + space.most
    away = math.sqrt(max(0.0, square - 2.0 * float(q @ tree.roots[0, :-1])))
    sub.search(q, away, Watched(-1, square, 5, None))
    assert sum(map(len, leaves)) == len(v) and sum(opened) < len(v) / 4


def plain_phrases(rows, least, longest, absorb, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(brute.LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    cand = {g: a for g, a in f.items() if len(g) > 2 and a >= least}
    out = {}
    for g, a in cand.items():
        lang, w = g[0], g[1:]
        cuts = [(2000000 * a // (f[(lang, *w[:k])] + f[(lang, *w[k:])]), k, f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w))]
        score, _, l, r = min(cuts)
        longer = (b for h, b in cand.items() if h[0] == lang and len(h) > len(g) and any(h[1 + i : 1 + i + len(w)] == w for i in range(len(h))))
        if not any(100 * b >= absorb * a for b in longer):
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return {(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])}


@pytest.mark.parametrize("absorb", [80, 101])
def test_phrases_on_odd_texts(spark, absorb):
    rng = random.Random(8)
    vocabulary = ["a", "B", "ñ", "漢字", "x" * 300, "\x1c", "\x00", "it's", "z-"]
    rows = [(rng.choice(["en", "de", None, "und", ""]), "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\t ", ", ", ".", "\n", "\r\n", " \x0b"]) for _ in range(80))) for _ in range(120)]
    rows += [("en", None), ("en", ""), (None, " .,;\n"), ("one", "word"), ("hot", "go go go stop " * 4000), ("hot", "go go"), ("hot", "go go")]
    frame = spark.createDataFrame(rows, "lang string, text string").withColumn("phrase", F.lit(1)).withColumn("n", F.lit(2)).repartition(5)
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = {tuple(r[c] for c in columns) for r in collocations(frame, least=5, longest=4, absorb=absorb, top=40).collect()}
    assert got == plain_phrases(rows, 5, 4, absorb, 40)
    assert collocations(frame.limit(0)).count() == 0
    assert collocations(spark.createDataFrame([("en", "one word. only")], "lang string, text string")).count() == 0
    with pytest.raises(ValueError):
        frequent_phrases(frame, longest=1)


def plain_ranks(docs, items, k):
    term = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(brute.LOWER))
    bags = [(i, Counter(term(t))) for i, t in docs]
    whole = sum(b.total() > 0 for _, b in bags)
    total = sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = Counter()
    for item, text in items:
        found = []
        for i, b in bags:
            if b:
                m = 75 + 25 * b.total() * whole // total
                s = sum(c * math.floor(1000 * math.log((2 * whole + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 12 * m)) for t, c in Counter(term(text)).items() if t in b)
                if s > 0:
                    found.append((-s, i is None, i or 0))
        out.update((item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k]))
    return out


def test_ranks_on_odd_texts(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "é", "漢字", "A1"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 60)))) for i in range(300)]
    docs += [(5, docs[5][1]), (None, docs[6][1]), (None, None), (700, ""), (701, " -- "), (702, "w1 " * 50_000), (-3, docs[9][1])] + [(1000 + i, docs[9][1]) for i in range(80)]
    items = [(str(i), " ".join(rng.choices(vocabulary, k=rng.randint(1, 25)))) for i in range(12)] + [("same", docs[9][1]), ("same", "w3 W3 w3"), (None, "É!é"), ("none", None), ("empty", "-"), ("unknown", "nowhere")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit(1)).repartition(6)
    asked = spark.createDataFrame(items, "item_id string, text string").withColumn("rank", F.lit("mine"))
    got = Counter(map(tuple, ranked_search(frame, asked, k=7).select("item_id", "rank", "doc_id", "score").collect()))
    assert got == plain_ranks(docs, items, 7)
    assert ranked_search(frame.limit(0), asked).count() == 0 and ranked_search(frame, asked.limit(0)).count() == 0


def test_best_positions_stop_early():
    """A list is not read to its end once the k-th score is above what its best position allows."""
    import pyarrow as pa
    from kinelake.llm import ranked

    rng = np.random.default_rng(3)
    n = 4000
    tf = 1 + (rng.pareto(1.0, size=(2, n)) * 3).astype(np.int64)
    of, term = np.concatenate([np.repeat(np.arange(n), tf[0]), np.repeat(np.arange(n), tf[1])]), np.concatenate([np.zeros(tf[0].sum(), int), np.ones(tf[1].sum(), int)])
    row = ranked._shard([(np.arange(n), np.full(n, 100), of, term)], 2).to_pylist()[0]
    lists = ranked.ImpactLists(row, Statistics(n * 1000, n * 100_000, np.array([5000, 4000])))
    terms, repeats = block_of(["a b b"]).queries[0]
    docs, scores = lists.search(terms, repeats, 5, 0)
    every = lists.impact.reshape(2, n)[0] + 2 * lists.impact.reshape(2, n)[1]
    assert sorted(scores)[-5:] == sorted(every)[-5:] and len(docs) < n / 4
    assert isinstance(row["keys"], bytes) and pa.types.is_binary(ranked._LISTS_ARROW.field("keys").type)
