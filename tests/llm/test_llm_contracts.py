"""Queries of the contract against SQL or plain restatements, on the smallest tables."""

import math
import zlib

import pytest

import brute
from check_oracle import compare, connect
from kinelake.llm.queries import ORACLES, QUERIES, tokenizer_path


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.fixture(scope="module")
def docs(con):
    return con.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


def rows(spark, sf_dir, name):
    return {r["doc_id"]: r for r in QUERIES[name](spark, sf_dir).collect()}


@pytest.mark.parametrize("name", list(ORACLES))
def test_agrees_with_sql(spark, con, sf_dir, name):
    assert compare(QUERIES[name](spark, sf_dir), con, ORACLES[name]) is None


def test_substring(spark, sf_dir, docs):
    got = rows(spark, sf_dir, "op1_substring_dedup")
    for (i, _), (n, gone, kept) in zip(docs, brute.substring(docs)):
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (n, gone, brute.sha(kept))


def test_lm(spark, sf_dir, docs):
    from kinelake.llm.ngram_lm import discounts

    got = rows(spark, sf_dir, "op2_lm_scoring")
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    train = [t for i, t in docs if not held[i]]
    total = sum(len(brute.split(t)) + 1 for t in train)
    for (i, _), (n, known, score, base) in zip(docs, brute.lm(docs, train, 2, discounts)):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], n, known, total)
        assert math.isclose(r["score"], score, rel_tol=1e-9) and math.isclose(r["base_score"], base, rel_tol=1e-9)
    out = [got[i] for i in held if held[i]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_lm_of_trigrams(spark, sf_dir, docs):
    from kinelake.llm.ngram_lm import discounts

    got = rows(spark, sf_dir, "op2_lm_scoring_trigram")
    train = [t for i, t in docs if zlib.crc32(str(i).encode()) % 7 != 2]
    for (i, _), (n, known, score, base) in zip(docs, brute.lm(docs, train, 3, discounts)):
        assert (got[i]["n_tokens"], got[i]["n_known"]) == (n, known)
        assert math.isclose(got[i]["score"], score, rel_tol=1e-9) and math.isclose(got[i]["base_score"], base, rel_tol=1e-9)


def test_secrets(spark, sf_dir, docs):
    got = rows(spark, sf_dir, "op5_secret_scan")
    names = ("assign", "access", "hex")
    for i, text in docs:
        base = brute.base_secrets(text)
        joined = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in base)
        assert [got[i][c] for c in ("n_assign", "n_access", "n_hex")] == [sum(b[1] == k for b in base) for k in range(3)]
        assert got[i]["base_sha256"] == brute.sha(joined) and set(joined.split(",")) <= set(got[i]["spans"].split(","))


def test_token_ids(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    got = rows(spark, sf_dir, "op6_token_ids_orc")
    for want in brute.token_rows(docs, Tokenizer.from_file(tokenizer_path()), 2):
        assert tuple(got[want[0]][c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) == want


def test_near_duplicates(spark, sf_dir, docs):
    got = rows(spark, sf_dir, "op7_ngram_jaccard_join")
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i, _ in docs] == brute.components(docs)


def test_decontamination(spark, con, sf_dir, docs):
    got = rows(spark, sf_dir, "op8_decontamination")
    items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    for (i, _), (n, hit, own) in zip(docs, brute.contamination(docs, items)):
        want = (n, hit, len(own), brute.sha(",".join(own)), hit > 0)
        assert tuple(got[i][c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) == want


def test_classifier_on_held_out_labels(spark, con, sf_dir, docs):
    got = rows(spark, sf_dir, "op10_quality_classifier")
    assert len(got) == len(docs)
    labels = [(i, q) for i, q in con.execute("SELECT doc_id, quality FROM labels").fetchall() if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] and got[i]["predicted"] == (got[i]["score"] >= 0.7) for i, _ in labels)
    assert sum(got[i]["predicted"] == q for i, q in labels) >= 0.9 * len(labels)


def test_pipeline(spark, con, sf_dir, docs):
    import corpus_pipeline as p

    from kinelake.llm.frames import settled

    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, text = frame.columns, dict(docs)
    kept = []
    for name, stage in p.STAGES[:-1]:
        frame = settled(stage(spark, frame, sf_dir), "stage")
        assert frame.columns == columns
        kept.append([r["doc_id"] for r in frame.select("doc_id").collect()])
    good, single, clean, mixed = map(sorted, kept)
    label = dict(con.execute("SELECT doc_id, quality FROM labels").fetchall())
    fine = {i for i, q in label.items() if q == 1}
    assert len(fine & set(good)) >= 0.97 * len(fine)
    own = [(i, text[i]) for i in good]
    assert single == [i for (i, _), (_, c) in zip(own, brute.components(own)) if c == i]
    items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    own = [(i, text[i]) for i in single]
    assert clean == [i for (i, _), (_, hit, _) in zip(own, brute.contamination(own, items)) if not hit]
    assert set(mixed) <= set(clean)
    stored = p.STAGES[-1][1](spark, frame, sf_dir).collect()
    assert sorted(r["doc_id"] for r in stored) == mixed
    ends = sorted((r["start"], r["start"] + r["n_tokens"], r["doc_id"]) for r in stored)
    assert ends[0][0] == 0 and all(a[1] == b[0] and a[2] <= b[2] for a, b in zip(ends, ends[1:]))


def test_quality_stage_drops_bad_documents(spark, con, sf_dir):
    import corpus_pipeline as p

    kept = {r["doc_id"] for r in p.quality(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir).select("doc_id").collect()}
    bad = {i for i, q in con.execute("SELECT doc_id, quality FROM labels").fetchall() if q == 0}
    assert bad and len(bad & kept) <= 0.05 * len(bad)
