"""Versioned folders (``name=0``, ``name=1``, ..): listed and pruned through Spark's own file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str, name: str) -> list[int]:
    """Complete versions below ``path`` in ascending order, from one listing."""
    fs, at = _file_system(spark, path)
    if not fs.exists(at(path)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at(path))]
    whole = [n for n in names if n.startswith(f"{name}=") and fs.exists(at(f"{path}/{n}/_SUCCESS"))]
    return sorted(int(n.removeprefix(f"{name}=")) for n in whole)


def drop_versions(spark: SparkSession, path: str, name: str, old: list[int]) -> None:
    fs, at = _file_system(spark, path)
    for v in old:
        fs.delete(at(f"{path}/{name}={v}"), True)
