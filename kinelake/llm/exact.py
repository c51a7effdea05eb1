"""Exact dedup over an extendible-hash index, in DataFrame operations only.

The key of a text is a 64-bit hash of its normalised form; a bucket is a range of keys with a common bit prefix. The
directory starts with one bucket, and every doubling splits the overfull ones, until a bucket holds at most
``capacity`` different keys. Rows go through the directory to the task that owns their bucket. There, texts of one
key form a chain and are told apart by their bytes, and the chain's entries say which copy stays. Keys with more than
``HOT_ROWS`` rows are shared among several owners, whose entries are merged, by bytes again. Directory and entries are
files in the shared folder; documents find their entry through the directory, by bucket, key and digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.llm.frames import settled, unused

#: Directories finer than 2**LEAF_BITS prefixes are not kept; keys below one leaf share a bucket.
LEAF_BITS = 20

#: Keys with more rows are shared among several owners.
HOT_ROWS = 10_000


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def _leaf(key: Column) -> Column:
    return F.shiftrightunsigned(key, 64 - LEAF_BITS)


def directory(keys: DataFrame, capacity: int) -> DataFrame:
    """(leaf, depth, bucket): the directory of every occupied leaf, for different ``key`` values.

    A bucket is a local depth and a prefix of that many bits. Every doubling splits the overfull prefixes, so a leaf belongs
    one level below its deepest overfull one. Rows are leaves, 2**LEAF_BITS at most, and so are overfull prefixes.
    """
    leaves = keys.select("key").distinct().groupBy(_leaf(F.col("key")).alias("leaf")).agg(F.count(F.lit(1)).alias("n"))
    prefixes = F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), F.shiftright("leaf", LEAF_BITS - d).alias("prefix")) for d in range(LEAF_BITS))))
    overfull = leaves.select("n", prefixes.alias("p")).groupBy("p").agg(F.sum("n").alias("held")).where(F.col("held") > capacity)
    split = leaves.select("leaf", prefixes.alias("p")).join(F.broadcast(overfull), "p", "left_semi").groupBy("leaf").agg((F.max("p.depth") + 1).alias("depth"))
    placed = leaves.select("leaf").join(split, "leaf", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    return placed.select("leaf", "depth", F.expr(f"shiftright(leaf, {LEAF_BITS} - depth)").alias("bucket"))


def _routed(rows: DataFrame, key: str, found: DataFrame, bucket: str) -> DataFrame:
    """Rows with the bucket that the directory gives their key."""
    leaf = unused(rows, "leaf")[0]
    return rows.withColumn(leaf, _leaf(F.col(key))).join(F.broadcast(found.toDF(leaf, bucket)), leaf).drop(leaf)  # 2**LEAF_BITS rows at most


def build_index(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 4_000) -> tuple[DataFrame, DataFrame]:
    """Writes directory and index of different texts to the shared folder and returns them, read back.

    Directory: leaf, bucket. Index: bucket, key, digest (SHA-256 of the normalised text), keep_id, group_size.
    """
    rows = settled(documents.select(
        F.col(doc_id).alias("id"), F.char_length(F.coalesce(F.col(text), F.lit(""))).alias("size"), normalised(F.col(text)).alias("body"),
        F.monotonically_increasing_id().alias("seq"),
    ).withColumn("key", F.xxhash64("body")), "exact-rows")
    counts = settled(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "exact-keys")
    named = F.format_string("%02d-%d", "depth", "bucket").alias("bucket")
    found = settled(directory(counts, capacity).select("leaf", named), "exact-directory")
    hot = counts.where(F.col("n") > HOT_ROWS).select("key", F.ceil(F.col("n") / HOT_ROWS).alias("shares"))
    routed = _routed(rows, "key", found, "bucket").join(F.broadcast(hot), "key", "left")  # rows / HOT_ROWS at most
    routed = routed.withColumn("shares", F.coalesce("shares", F.lit(1))).withColumn("share", F.pmod("seq", "shares"))
    best = F.min(F.struct(-F.col("size"), F.col("id").isNull(), F.col("id"))).alias("best")
    owned = routed.repartition("bucket", "share").groupBy("bucket", "share", "shares", "key", "body")  # no further shuffle
    chained = owned.agg(best, F.count(F.lit(1)).alias("group_size")).withColumn("digest", F.sha2("body", 256))
    chained = settled(chained.withColumn("body", F.when(F.col("shares") > 1, F.col("body"))), "exact-entries")
    whole = chained.where("shares = 1").select("bucket", "key", "digest", "best", "group_size")
    parts = chained.where("shares > 1").groupBy("bucket", "key", "digest", "body").agg(F.min("best").alias("best"), F.sum("group_size").alias("group_size"))
    entries = whole.unionByName(parts.drop("body"))
    return found, settled(entries.select("bucket", "key", "digest", F.col("best.id").alias("keep_id"), "group_size"), "exact-index")


def mark_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 4_000) -> DataFrame:
    """The documents with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when they are identical without ASCII white space; of equal texts the one with the most
    code points stays, then the smallest id. Columns of those names are replaced, others stay. Null and
    empty texts are equal; a null id loses every tie; rows that share both id and text are one document and
    are marked alike; an empty table gives an empty result.
    """
    base = documents.drop("keep_id", "group_size", "kept", "text_sha256")
    found, index = build_index(documents, doc_id, text, capacity)
    key, body, bucket = unused(base, "key", "body", "bucket")
    keyed = base.withColumn(body, normalised(F.col(text))).withColumns({key: F.xxhash64(body), "text_sha256": F.sha2(body, 256)}).drop(body)
    entries = index.select(F.col("bucket").alias(bucket), F.col("key").alias(key), F.col("digest").alias("text_sha256"), "keep_id", "group_size")
    return _routed(keyed, key, found, bucket).join(entries, [bucket, key, "text_sha256"]).select(
        *base.columns, "keep_id", "group_size", F.col(doc_id).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def exact_dedup(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 4_000) -> DataFrame:
    """The documents that stay, with their own columns. See ``mark_duplicates``."""
    return mark_duplicates(documents, doc_id, text, capacity).where("kept").select(*documents.columns)
