"""Motion data as derived from the driver's tables.

* trial samples: ``lineitem``, one trial per supplier, six scaled channels in shipping order
* trial catalogue: ``supplier``, with onset and impact frames worked out from the key
* short series: ``events``, one series per user in time order

Divisors are odd so that rounding to six places never meets a tie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.operators.blocks import number_rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SAMPLE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trial samples: trial, frame, six channels."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("trial"),
        *SAMPLE_ORDER,
        (F.col("l_quantity") / 23).alias("acc_x"),
        (F.col("l_discount") * 10).alias("acc_y"),
        (F.col("l_extendedprice") / 41231).alias("acc_z"),
        (F.col("l_tax") * 100).alias("gyro_x"),
        (F.col("l_quantity") - 25).alias("gyro_y"),
        (F.col("l_discount") * 50).alias("gyro_z"),
    )
    slices = F.struct(F.col("l_shipdate"), F.floor(F.col("l_orderkey") / 1_000_000))
    return number_rows(lines, ["trial"], SAMPLE_ORDER, slices).drop(*SAMPLE_ORDER)


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of samples per trial."""
    counted = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("trial"))
    return counted.agg(F.count("*").alias("n_frames"))


SAMPLES_SQL = """
s AS (
  SELECT l_suppkey AS trial,
         row_number() OVER (PARTITION BY l_suppkey
           ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS frame,
         l_quantity / 23 AS acc_x, l_discount * 10 AS acc_y, l_extendedprice / 41231 AS acc_z,
         l_tax * 100 AS gyro_x, l_quantity - 25 AS gyro_y, l_discount * 50 AS gyro_z
  FROM lineitem),
n AS (SELECT l_suppkey AS trial, count(*) AS n_frames FROM lineitem GROUP BY 1)"""


def windows_sql(length: int, stride: int, source: str = "n", keys: str = "trial") -> str:
    """CTE ``w``: window boundaries of the series in ``source``."""
    return f"""
grid AS (
  SELECT {keys}, n_frames,
         CASE WHEN n_frames > {length} THEN (n_frames - {length}) // {stride} + 1 ELSE 1 END AS n_full
  FROM {source} WHERE n_frames > 0),
w AS (
  SELECT {keys}, n_frames, i AS window_index, i * {stride} AS start_frame,
         least(i * {stride} + {length}, n_frames) AS end_frame
  FROM (SELECT *, unnest(generate_series(0, n_full - 1)) AS i FROM grid)
  UNION ALL
  SELECT {keys}, n_frames, n_full, (n_full - 1) * {stride} + {length}, n_frames
  FROM grid WHERE n_frames > {length} AND (n_full - 1) * {stride} + {length} < n_frames)"""


def window_samples_sql(length: int) -> str:
    """CTE ``x``: ``length`` samples per window of ``w``, padded with the last real one."""
    return f"""
x AS (
  SELECT o.trial, o.window_index, o.start_frame, o.off AS "offset", s.*  EXCLUDE (trial),
         o.start_frame + o.off >= o.end_frame AS is_pad
  FROM (SELECT *, unnest(generate_series(0, {length - 1})) AS off FROM w) o
  JOIN s ON s.trial = o.trial AND s.frame = least(o.start_frame + o.off, o.end_frame - 1))"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trial catalogue: one row per supplier in manifest form."""
    key = F.col("s_suppkey")
    fall = key % 3 != 0
    onset = F.when(fall & (key % 17 != 0), (100 + key % 150).cast("int"))
    impact = F.when(fall & (key % 17 != 0), (160 + key % 150 + key % 40).cast("int"))
    return table(spark, sf_dir, "supplier").select(
        F.when(key % 4 == 0, "sisfall").otherwise("kfall").alias("dataset"),
        F.format_string("SA%02d", key % 32).alias("subject_id"),
        F.format_string("T%02d", (key % 36 + 1)).alias("activity_code"),
        F.format_string("R%05d", key).alias("trial_id"),
        F.when(fall, "fall").otherwise("adl").alias("label"),
        (F.lit(3.0) + (key % 50) * 0.125).alias("duration_s"),
        F.lit(100.0).alias("sample_rate_hz"),
        (key % 13 != 0).alias("accepted"),
        F.when(key % 5 == 0, "auto_detected").otherwise("T01").alias("calibration_source"),
        F.format_string("trials/%d", key).alias("harmonized_path"),
        onset.alias("fall_onset_frame"),
        impact.alias("fall_impact_frame"),
        key.alias("trial"),
    )


CATALOG_SQL = """
c AS (
  SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'sisfall' ELSE 'kfall' END AS dataset,
         printf('SA%02d', s_suppkey % 32) AS subject_id,
         printf('T%02d', s_suppkey % 36 + 1) AS activity_code,
         printf('R%05d', s_suppkey) AS trial_id,
         CASE WHEN s_suppkey % 3 <> 0 THEN 'fall' ELSE 'adl' END AS label,
         3.0::DOUBLE + (s_suppkey % 50) * 0.125::DOUBLE AS duration_s, 100.0::DOUBLE AS sample_rate_hz,
         s_suppkey % 13 <> 0 AS accepted,
         CASE WHEN s_suppkey % 5 = 0 THEN 'auto_detected' ELSE 'T01' END AS calibration_source,
         printf('trials/%d', s_suppkey) AS harmonized_path,
         CASE WHEN s_suppkey % 3 <> 0 AND s_suppkey % 17 <> 0
              THEN (100 + s_suppkey % 150)::INTEGER END AS fall_onset_frame,
         CASE WHEN s_suppkey % 3 <> 0 AND s_suppkey % 17 <> 0
              THEN (160 + s_suppkey % 150 + s_suppkey % 40)::INTEGER END AS fall_impact_frame,
         s_suppkey AS trial
  FROM supplier)"""


def rounded(df: DataFrame, *keep: str, places: int = 6) -> DataFrame:
    """Round every column but ``keep`` for comparison across engines."""
    return df.select(*[F.col(c) if c in keep else F.round(c, places).alias(c) for c in df.columns])


def longs(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]
