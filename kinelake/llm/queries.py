"""The dealt operators over the given tables: one query each, with the columns its contract names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_substring_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of each document once windows that start in an earlier one are removed."""
    from kinelake.llm.substring import remove_repeats

    kept = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), n=50)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op8_decontamination")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in each document."""
    from kinelake.llm.decontaminate import contamination

    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), n=10)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["word_end"] - s["word"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


@query(
    "op9_exact_dedup",
    r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS size, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents
), k AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY size DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
""",
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the copy that stays in its place."""
    from kinelake.llm.exact import mark_duplicates

    marked = mark_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return marked.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op6_token_ids_orc")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text through ORC files: place, length and checksum."""
    from kinelake.llm.token_ids import store, token_index

    return token_index(spark, store(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), end_id=2))


@query(
    "op3_source_mixing",
    """
WITH held AS (SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS held FROM documents GROUP BY 1),
weight AS (SELECT source, held, CASE WHEN held > 0 THEN pow(held, 0.5) ELSE 0 END AS weight FROM held),
rate AS (SELECT source, CASE WHEN held > 0 THEN sum(held) OVER () * weight / sum(weight) OVER () / held ELSE 0 END AS rate FROM weight),
cdf AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
        FROM rate, range(0, 160) r(k) WHERE rate > 0),
drawn AS (SELECT d.doc_id, d.source, d.text, r.rate,
                 (SELECT count(*) FROM cdf c WHERE c.source IS NOT DISTINCT FROM d.source
                  AND c.cdf <= ('0x' || substr(md5('7:' || d.doc_id || ':1'), 1, 13))::BIGINT / 4503599627370496.0) AS n
          FROM documents d JOIN rate r ON r.source IS NOT DISTINCT FROM d.source),
copies AS (SELECT *, unnest(range(1, n + 1))::INT AS copy FROM drawn)
SELECT doc_id, source, copy, round(rate, 9) AS rate,
       ('0x' || substr(md5('7:order:' || doc_id || ':' || copy), 1, 13))::BIGINT AS order_key, text FROM copies
""",
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with source shares evened out by their square root, as replicated and shuffled documents."""
    from kinelake.llm.mixing import replicate

    mixed = replicate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), seed=7, power=0.5)
    return mixed.select("doc_id", "source", "copy", F.round("rate", 9).alias("rate"), "order_key", "text")


@query(
    "op4_line_dedup",
    r"""
WITH lines AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
runs AS (SELECT doc_id, l, n, s, l[s:s + n - 1] AS w FROM (SELECT *, unnest(range(1, len(l) - n + 2)) AS s FROM lines, (VALUES (1), (2), (3)) v(n))),
counted AS (SELECT *, len(regexp_extract_all(array_to_string(w, chr(10)), '[^\x20\x09-\x0D]+')) AS words FROM runs),
win AS (SELECT doc_id, n, s, w FROM counted WHERE n = 3 OR words >= 50 OR n = len(l) AND words > 0),
late AS (SELECT doc_id, n, s FROM win QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS i FROM late),
each AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM lines)
SELECT e.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
       sha256(coalesce(string_agg(e.line, chr(10) ORDER BY e.i) FILTER (g.i IS NULL), '')) AS kept_sha256
FROM each e LEFT JOIN gone g USING (doc_id, i) GROUP BY e.doc_id
""",
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines left of each document once repeated runs of three lines, or of 50 words, or whole shorter texts are deleted."""
    from kinelake.llm.lines import remove_repeated_lines

    kept = remove_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), window=3, passage=50)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query(
    "op4_line_run_dedup",
    r"""
WITH lines AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
win AS (SELECT doc_id, s, l[s:s + 2] AS w FROM (SELECT *, unnest(range(1, len(l) - 1)) AS s FROM lines)),
late AS (SELECT doc_id, s FROM win QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, unnest([s, s + 1, s + 2]) AS i FROM late),
each AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM lines)
SELECT e.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
       sha256(coalesce(string_agg(e.line, chr(10) ORDER BY e.i) FILTER (g.i IS NULL), '')) AS kept_sha256
FROM each e LEFT JOIN gone g USING (doc_id, i) GROUP BY e.doc_id
""",
)
def op4_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The narrower rule alone: lines left once repeated runs of three lines or more are deleted."""
    from kinelake.llm.lines import remove_repeated_lines

    kept = remove_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), window=3)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op5_secret_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts of the base kinds, and all spans."""
    from kinelake.llm.secrets import find_secrets, span_names

    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] < 3)

    def count(kind: int, name: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(name)

    counts = [count(k, n) for k, n in enumerate(("n_assign", "n_access", "n_hex"))]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(span_names(base), 256).alias("base_sha256"), span_names(F.col("spans")).alias("spans"))


@query("op7_ngram_jaccard_join")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the smallest id among its near duplicates."""
    from kinelake.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), size=5, percent=80)


@query("op10_quality_classifier")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels that are not held out."""
    from kinelake.llm.classifier import fit, held_out, score

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(documents, table(spark, sf_dir, "labels").where(~held_out()))
    return score(documents, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def _lm_scores(spark: SparkSession, sf_dir: str, order: int) -> DataFrame:
    from kinelake.llm.ngram_lm import score, train

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    model = train(documents.where(~held_out), order=order)
    return score(documents, model).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.orders[1].tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


@query("op2_lm_scoring")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under a bigram model of those that are not held out."""
    return _lm_scores(spark, sf_dir, 2)


@query("op2_lm_scoring_trigram")
def op2_trigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under a trigram model of those that are not held out."""
    return _lm_scores(spark, sf_dir, 3)


_LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op12_phrase_collocations",
    rf"""
WITH doc AS (SELECT row_number() OVER () AS did, coalesce(lang, 'und') AS lang, string_split_regex({_LOWER_SQL}, '[.,;:!?\x0A-\x0D]') AS p FROM documents),
piece AS (SELECT did, lang, unnest(p) AS piece, generate_subscripts(p, 1) AS pid FROM doc),
listed AS (SELECT did, lang, pid, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM piece),
total AS (SELECT lang, sum(len(w)) AS n FROM listed GROUP BY 1),
gram AS (SELECT lang, k, array_to_string(w[s:s + k - 1], ' ') AS phrase
         FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS s FROM listed, (VALUES (1), (2), (3), (4)) v(k))),
f AS (SELECT lang, k, phrase, count(*) AS f FROM gram GROUP BY ALL),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND f >= 30),
part AS (SELECT *, array_to_string(w[1:j], ' ') AS p1, array_to_string(w[j + 1:], ' ') AS p2
         FROM (SELECT *, unnest(range(1, k)) AS j FROM cand)),
cut AS (SELECT c.lang, c.phrase, c.k, c.a, c.j, x.f AS l, y.f AS r, 2000000::HUGEINT * c.a // (x.f + y.f) AS score
        FROM part c JOIN f x ON x.lang = c.lang AND x.phrase = c.p1 AND x.k = c.j JOIN f y ON y.lang = c.lang AND y.phrase = c.p2 AND y.k = c.k - c.j),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
held AS (SELECT lang, k, a, m, array_to_string(w[s:s + m - 1], ' ') AS part
         FROM (SELECT *, unnest(range(1, k - m + 2)) AS s FROM cand, (VALUES (2), (3)) v(m) WHERE m < k)),
most AS (SELECT lang, part, max(a) AS most FROM held GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN most ON most.lang = low.lang AND most.part = low.phrase
         WHERE most IS NULL OR 100 * most < 80 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept QUALIFY rank <= 2000)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN total USING (lang)
""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language."""
    from kinelake.llm.phrases import collocations

    documents = table(spark, sf_dir, "documents").select("text", "lang")
    return collocations(documents, least=30, longest=4, absorb=80, top=2000).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@query(
    "op13_ranked_search",
    rf"""
WITH word AS (SELECT doc_id, row_number() OVER () AS did, regexp_extract_all({_LOWER_SQL}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
size AS (SELECT did, any_value(doc_id) AS doc_id, len(any_value(w)) AS n FROM word GROUP BY did),
whole AS (SELECT count(*) FILTER (n > 0) AS docs, sum(n) AS total FROM size),
tf AS (SELECT did, term, count(*) AS tf FROM (SELECT did, unnest(w) AS term FROM word) GROUP BY ALL),
weight AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY term),
asked AS (SELECT item_id, row_number() OVER () AS q, regexp_extract_all({_LOWER_SQL}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
term AS (SELECT item_id, q, term, count(*) AS again FROM (SELECT item_id, q, unnest(w) AS term FROM asked) GROUP BY ALL),
scored AS (SELECT term.item_id, q, tf.did, any_value(size.doc_id) AS doc_id,
                  sum(again * weight.w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs)::BIGINT // total::BIGINT))))::BIGINT AS score
           FROM term JOIN weight USING (term) JOIN tf USING (term) JOIN size ON size.did = tf.did, whole GROUP BY term.item_id, q, tf.did),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0 QUALIFY rank <= 20)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked
""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for each benchmark item."""
    from kinelake.llm.ranked import ranked_search

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ranked_search(documents, table(spark, sf_dir, "benchmark").select("item_id", "text"), k=20).select("item_id", "rank", "doc_id", "score")


@query(
    "op11_exact_top_k",
    """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
           FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scored QUALIFY rank <= 5
""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors of largest inner product for every fiftieth one."""
    from kinelake.llm.metric_tree import exact_top_k

    return exact_top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=5, every=50).select("query_id", "rank", "vec_id", "score")
