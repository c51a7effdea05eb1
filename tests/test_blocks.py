"""Slicing of long series must not change any result."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinelake.operators import blocks


@pytest.fixture(scope="module")
def skewed(spark):
    """Four keys, one of them with a third of all rows and more."""
    rng = np.random.default_rng(0)
    key = np.repeat([0, 1, 2, 3], [400, 90, 60, 50])
    pdf = pd.DataFrame({"k": key, "t": rng.permutation(len(key)), "v": rng.integers(1, 9, len(key))})
    return pdf, spark.createDataFrame(pdf).repartition(5)


@pytest.mark.parametrize("hot_rows", [100, 10_000])
def test_number_rows(skewed, hot_rows):
    pdf, df = skewed
    got = blocks.number_rows(df, ["k"], ["t"], F.floor(F.col("t") / 37), "n", hot_rows).toPandas()
    want = pdf.assign(n=pdf.groupby("k")["t"].rank().astype(int) - 1)
    merged = got.merge(want, on=["k", "t", "v"], suffixes=("", "_w"))
    assert len(merged) == len(pdf) and (merged["n"] == merged["n_w"]).all()


@pytest.mark.parametrize("how", ["sum", "min", "max"])
@pytest.mark.parametrize("hot_rows", [100, 10_000])
def test_prefix(skewed, how, hot_rows):
    pdf, df = skewed
    got = blocks.prefix(df, ["k"], ["t"], F.floor(F.col("t") / 37), "p", F.col("v"), how, hot_rows).toPandas()
    ordered = pdf.sort_values(["k", "t"])
    running = {"sum": "cumsum", "min": "cummin", "max": "cummax"}[how]
    before = ordered.groupby("k")["v"].transform(lambda s: getattr(s, running)().shift())
    want = ordered.assign(w=before.fillna(0) if how == "sum" else before)
    merged = got.merge(want, on=["k", "t", "v"])
    assert len(merged) == len(pdf)
    assert np.array_equal(merged["p"].astype(float), merged["w"].astype(float), equal_nan=True)


def test_prefix_without_keys(skewed):
    pdf, df = skewed
    got = blocks.number_rows(df, [], ["t"], F.floor(F.col("t") / 37), "n").toPandas()
    assert (got["n"] == got["t"]).all()


def test_fill_forward(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": np.arange(300) % 3, "t": np.arange(300), "c": [str(i) if rng.random() < 0.1 else None for i in range(300)]})
    df = spark.createDataFrame(pdf, "k long, t long, c string")
    got = blocks.fill_forward(df, ["k"], ["t"], ["c"], F.floor(F.col("t") / 20)).toPandas().sort_values("t")
    want = pdf.groupby("k")["c"].ffill()
    assert [x if isinstance(x, str) else None for x in got["c"]] == [x if isinstance(x, str) else None for x in want]


def test_with_blocks_gives_each_block_its_context(spark):
    df = spark.range(95).withColumnRenamed("id", "frame")
    got = blocks.with_blocks(df, before=3, after=2, size=10).toPandas()
    for b, rows in got.groupby("block"):
        core = set(range(b * 10, min(b * 10 + 10, 95)))
        context = set(range(max(0, b * 10 - 3), min(b * 10 + 12, 95)))
        if core:
            assert set(rows.loc[rows["core"], "frame"]) == core
            assert set(rows["frame"]) == context
    assert got["core"].sum() == 95
