"""The corpus pipeline: quality, near duplicates, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a frame that is
written as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.llm.classifier import fit, held_out, score
from kinelake.llm.decontaminate import decontaminate
from kinelake.llm.frames import settled
from kinelake.llm.jaccard import keep_one
from kinelake.llm.mixing import replicate
from kinelake.llm.queries import table, tokenizer_path
from kinelake.llm.token_ids import store, token_index

#: Documents with a lower probability of good quality go.
LEAST_QUALITY = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from labels outside the held-out fold, does not reject."""
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return score(docs, model).where(F.col("score") >= LEAST_QUALITY).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by 5-word shingles at 0.8."""
    return keep_one(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a 10-word window of the benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), n=10)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated so that sources have shares by the square root of their size, shuffled."""
    return replicate(docs, seed=7, power=0.5).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """ORC files of token ids in id order; one row per stored document, read back from them."""
    return token_index(spark, store(docs, tokenizer_path(), end_id=2))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixing),
    ("token ids", token_ids),
]

#: The classifier is a fitted network and the ids come from a tokenizer, so SQL cannot express the result.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
