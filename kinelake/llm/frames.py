"""Small helpers shared by the operators: column names that cannot clash, keys, folders."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.session import shared_path


def unused(frame: DataFrame, *names: str) -> list[str]:
    """The given names, each with underscores added until the frame has no such column."""
    taken = {c.lower() for c in frame.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(frame: DataFrame) -> int:
    """The session's number of shuffle partitions, which its user sets by the size of the data."""
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def settled(frame: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: a table that outlives lost executors."""
    path = shared_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def bucketed(frame: DataFrame, name: str, key: str, n: int) -> DataFrame:
    """Written to the shared folder in ``n`` buckets of ``key`` and read back, so that work by key needs no shuffle.

    The table is in the catalogue only until it has been looked up; its files stay like those of ``settled``.
    """
    spark = frame.sparkSession
    passing = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    frame.write.bucketBy(n, key).option("path", shared_path(spark, name)).saveAsTable(passing)
    found = spark.table(passing)
    spark.sql(f"DROP TABLE {passing}")
    return found


def text_key(text: Column) -> Column:
    """Tells apart rows that share an id; rows that share id and text have the same result anyway."""
    return F.xxhash64(F.coalesce(text, F.lit("")))
