"""The live scorer replayed over the events table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from kinelake.queries.registry import query
from kinelake.queries.review import smoother_sql
from kinelake.session import shared_path
from kinelake.streaming import live

LENGTH, STRIDE = 20, 5
_CHANNEL_EXPR = {
    "acc_x": "value / 53",
    "acc_y": "event_id % 17 / 31.0D",
    "acc_z": "user_id % 11 / 19.0D - event_id % 7 / 13.0D",
    "gyro_x": "value / 7",
    "gyro_y": "event_id % 5 * 1.0D",
    "gyro_z": "user_id % 3 * 1.0D",
}


def mean_scorer(batch: np.ndarray) -> np.ndarray:
    """Logits from window means of magnitude, steepest jerk and mean tilt."""
    mag, jerk, tilt = batch[:, :, 6], batch[:, :, 7], batch[:, :, 8]
    return np.column_stack([2.0 * mag.mean(axis=1), np.abs(jerk).max(axis=1) / 41.0, tilt.mean(axis=1) / 37.0])


_LIVE_SQL = f"""WITH RECURSIVE s AS (
  SELECT user_id AS device, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame,
         {", ".join(f"{e.replace('D', '::DOUBLE')} AS {c}" for c, e in _CHANNEL_EXPR.items())} FROM events),
m AS (SELECT *, sqrt(acc_x*acc_x + acc_y*acc_y + acc_z*acc_z) AS mag FROM s),
n AS (SELECT device, count(*) AS n FROM s GROUP BY device),
w AS (SELECT device, unnest(generate_series(0, (n - {LENGTH}) // {STRIDE})) AS window_index FROM n WHERE n >= {LENGTH}),
x AS (
  SELECT w.device, window_index, frame - window_index * {STRIDE} AS off, mag,
         degrees(acos(greatest(-1.0, least(1.0, acc_z / CASE WHEN mag = 0 THEN 1e-8 ELSE mag END)))) AS tilt,
         lag(mag) OVER q AS back, lead(mag) OVER q AS ahead
  FROM w JOIN m ON m.device = w.device AND frame >= window_index * {STRIDE} AND frame < window_index * {STRIDE} + {LENGTH}
  WINDOW q AS (PARTITION BY w.device, window_index ORDER BY frame)),
l AS (
  SELECT device, window_index, 2.0 * avg(mag) AS l0,
         max(abs(100 * CASE WHEN off = 0 THEN ahead - mag WHEN off = {LENGTH - 1} THEN mag - back ELSE (ahead - back) / 2 END)) / 41.0 AS l1,
         avg(tilt) / 37.0 AS l2
  FROM x GROUP BY device, window_index),
e AS (SELECT *, exp(l0 - greatest(l0, l1, l2)) AS e0, exp(l1 - greatest(l0, l1, l2)) AS e1, exp(l2 - greatest(l0, l1, l2)) AS e2 FROM l),
p AS (
  SELECT device, window_index, e0 / (e0 + e1 + e2) AS p0, e1 / (e0 + e1 + e2) AS p1, e2 / (e0 + e1 + e2) AS p2 FROM e),
{smoother_sql("p", "device")}"""


#: Event numbers that a sample may lag behind the newest of its user.
LATENESS = 500

#: How far the watermark lies behind the newest event, in milliseconds.
DELAY_MS = 3_600_000


def _stream(spark, sf_dir, ends: str):
    """Events as samples, and the end marks of their sessions, which come in a folder of their own."""
    live.use_rocksdb(spark)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # The glob takes the table as one file or as a folder of files.
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    samples = events.select(
        F.col("user_id").alias("device"),
        F.col("event_id").alias("seq"),
        *[F.expr(e).cast("double").alias(c) for c, e in _CHANNEL_EXPR.items()],
        F.lit(False).alias("ends"),
    )
    marks = spark.readStream.schema(samples.schema).parquet(ends)
    return live.score_stream(samples.unionByName(marks), mean_scorer, LENGTH, STRIDE, 100.0, lateness=LATENESS)


def _mark_ends(spark, sf_dir, ends: str, write: bool = True) -> None:
    """Writes one end mark per user, after the last of its events; or only makes the folder."""
    users = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("user_id").alias("device")).agg((F.max("event_id") + 1).alias("seq"))
    rows = users.select("device", "seq", *[F.lit(None).cast("double").alias(c) for c in _CHANNEL_EXPR], F.lit(True).alias("ends"))
    (rows if write else rows.limit(0)).write.mode("append").parquet(ends)


@query(
    "live_scores",
    f"""{_LIVE_SQL}
SELECT al.device, al.window_index::BIGINT AS window_index, s.seq, {LENGTH}::BIGINT AS buffered_samples, round(p0, 6) AS p_non_fall,
       round(p1, 6) AS p_pre_impact, round(p2, 6) AS p_fall,
       CASE least(code, 2) WHEN 0 THEN 'calm' WHEN 1 THEN 'pre_impact' ELSE 'fall' END AS state,
       true AS window_ready, {LENGTH}::BIGINT AS needed_samples
FROM al JOIN p ON p.device = al.device AND p.window_index = al.window_index
JOIN s ON s.device = al.device AND s.frame = al.window_index * {STRIDE} + {LENGTH - 1}
UNION ALL
SELECT device, NULL, seq, frame + 1, NULL, NULL, NULL, 'buffering', false, {LENGTH} FROM s WHERE frame < {LENGTH - 1}""",
)
def live_scores(spark, sf_dir):
    """Every event streamed through per-user buffers, scored and smoothed; then all sessions are ended."""
    out, checkpoint, ends = (shared_path(spark, n) for n in ("live", "live-checkpoint", "live-ends"))
    for last in (False, True):
        _mark_ends(spark, sf_dir, ends, write=last)
        table = live.run_to_table(_stream(spark, sf_dir, ends), out, checkpoint)
    probs = [F.round(c, 6).alias(c) for c in ("p_non_fall", "p_pre_impact", "p_fall")]
    return table.select("device", "window_index", "seq", "buffered_samples", *probs, "state", "window_ready", "needed_samples")


_DUE_SQL = f"""SELECT *, epoch_ms(ts) AS ms FROM events
  WHERE epoch_ms(ts) // {live.SLICE_MS} < ((SELECT max(epoch_ms(ts)) FROM events) - {DELAY_MS}) // {live.SLICE_MS}"""
_WATERMARK_SQL = _LIVE_SQL.replace("(PARTITION BY user_id ORDER BY event_id)", "(PARTITION BY user_id ORDER BY ms, event_id)").replace("FROM events)", f"FROM ({_DUE_SQL}))")


@query(
    "live_watermark",
    f"""{_WATERMARK_SQL}
SELECT al.device, al.window_index::BIGINT AS window_index, s.seq, round(p_fall, 6) AS p_fall,
       CASE least(code, 2) WHEN 0 THEN 'calm' WHEN 1 THEN 'pre_impact' ELSE 'fall' END AS state
FROM al JOIN (SELECT device, window_index, p2 AS p_fall FROM p) p ON p.device = al.device AND p.window_index = al.window_index
JOIN s ON s.device = al.device AND s.frame = al.window_index * {STRIDE} + {LENGTH - 1}
UNION ALL
SELECT device, NULL, seq, NULL, 'buffering' FROM s WHERE frame < {LENGTH - 1}""",
)
def live_watermark(spark, sf_dir):
    """Events in the order of their times, each scored once the watermark has passed its minute; no end marks."""
    live.use_rocksdb(spark)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    samples = events.select(
        F.col("user_id").alias("device"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        *[F.expr(e).cast("double").alias(c) for c, e in _CHANNEL_EXPR.items()],
    )
    scored = live.score_stream(samples, mean_scorer, LENGTH, STRIDE, 100.0, time="ts", delay=f"{DELAY_MS} milliseconds")
    table = live.run_to_table(scored, shared_path(spark, "live-watermark"), shared_path(spark, "live-checkpoint"))
    return table.select("device", "window_index", "seq", F.round("p_fall", 6).alias("p_fall"), "state")


@query(
    "live_state",
    f"""{_LIVE_SQL}
SELECT n.device, max(window_index)::BIGINT AS window_index, CASE WHEN any_value(n) < {LENGTH} THEN any_value(n) ELSE {LENGTH} END::BIGINT AS buffered_samples,
       CASE WHEN any_value(n) < {LENGTH} THEN 'buffering' ELSE
         CASE least(arg_max(code, window_index), 2) WHEN 0 THEN 'calm' WHEN 1 THEN 'pre_impact' ELSE 'fall' END END AS state
FROM n LEFT JOIN al USING (device) GROUP BY n.device""",
)
def live_state(spark, sf_dir):
    """The current state per user, rewritten batch by batch."""
    path, checkpoint, ends = (shared_path(spark, n) for n in ("live-state", "live-checkpoint", "live-ends"))
    for last in (False, True):
        _mark_ends(spark, sf_dir, ends, write=last)
        live.write_state(_stream(spark, sf_dir, ends), path, checkpoint, availableNow=True).awaitTermination()
    return live.read_state(spark, path).select("device", "window_index", "buffered_samples", "state")


#: Arrays of samples in one file, a line each.
ARRAYS_PER_FILE = 200


def _json_files(spark, sf_dir) -> str:
    """Events as JSON arrays of samples, ``ARRAYS_PER_FILE`` lines to a file: some samples lack a channel, hold text for
    a number, or are no object; some lines are no JSON. Numbers of every third event are strings."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    number = {c: F.expr(e).cast("double") for c, e in _CHANNEL_EXPR.items()}
    rest = [v.alias(c) for c, v in number.items() if c not in ("gyro_z", "gyro_y")]
    gyro_z = F.when(F.col("event_type") != "error", number["gyro_z"]).alias("gyro_z")

    def sample(gyro_y):
        return F.to_json(F.struct(F.concat(F.lit("u"), "user_id").alias("device"), F.col("event_id").alias("seq"), *rest, gyro_y.alias("gyro_y"), gyro_z))

    text = F.when(F.col("event_id") % 3 == 0, sample(number["gyro_y"].cast("string"))).otherwise(sample(number["gyro_y"]))
    text = F.when(F.col("event_id") % 101 == 0, sample(F.lit("high"))).otherwise(text)
    element = F.when(F.col("event_id") % 97 == 0, F.lit("7")).otherwise(text)
    part = F.floor(F.col("event_id") / 50).alias("part")
    files = events.groupBy(part).agg(F.concat(F.lit("["), F.array_join(F.collect_list(element), ","), F.lit("]")).alias("value"))
    broken = F.when(F.col("part") % 41 == 0, F.lit("[{not json")).otherwise(F.col("value"))
    folder = shared_path(spark, "json")
    files.select(broken.alias("value")).write.option("maxRecordsPerFile", ARRAYS_PER_FILE).text(folder)
    return folder


_JSON_STATE = """SELECT *, CASE WHEN event_id // 50 % 41 = 0 THEN 'unreadable file' WHEN event_id % 97 = 0 THEN 'not an object'
  WHEN event_id % 101 = 0 AND event_type = 'error' THEN 'gyro_y,gyro_z' WHEN event_id % 101 = 0 THEN 'gyro_y'
  WHEN event_type = 'error' THEN 'gyro_z' END AS problem FROM events"""


@query(
    "json_samples",
    f"""SELECT 'u' || user_id AS device, event_id AS seq, {", ".join(f"{e.replace('D', '::DOUBLE')} AS {c}" for c, e in _CHANNEL_EXPR.items())}
FROM ({_JSON_STATE}) WHERE problem IS NULL""",
)
def json_samples(spark, sf_dir):
    """Samples streamed back from JSON files; the good ones of a file stay beside bad ones."""
    stream = live.well_formed(live.read_sample_stream(spark, _json_files(spark, sf_dir), lines=True))
    columns = ["device", "seq", *_CHANNEL_EXPR]
    return live.run_to_table(stream, shared_path(spark, "samples"), shared_path(spark, "samples-checkpoint"), columns)


def last_sample(batch: np.ndarray) -> np.ndarray:
    """Logits that tell which sample came last."""
    return np.column_stack([batch[:, -1, 0], batch[:, -1, 1], np.zeros(len(batch))])


@query(
    "json_order",
    """WITH s AS (
  SELECT user_id % 3 || '' AS device, event_id % 97 / 50.0 AS a, event_id % 89 / 60.0 AS b,
         row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id // 100 % 7, event_id // 100, event_id) - 1 AS seq FROM events)
SELECT device, seq, CASE WHEN seq > 0 THEN round(exp(a) / (exp(a) + exp(b) + 1), 6) END AS p_non_fall,
       CASE WHEN seq > 0 THEN round(exp(b) / (exp(a) + exp(b) + 1), 6) END AS p_pre_impact FROM s""",
)
def json_order(spark, sf_dir):
    """Samples without numbers, from arrays in files whose order only their whole names tell: a letter, then digits."""
    value = {"acc_x": F.col("event_id") % 97 / 50.0, "acc_y": F.col("event_id") % 89 / 60.0}
    channels = [value.get(c, F.lit(1.0)).cast("double").alias(c) for c in _CHANNEL_EXPR]
    sample = F.struct("event_id", F.struct((F.col("user_id") % 3).cast("string").alias("device"), *channels).alias("sample"))
    part = F.floor(F.col("event_id") / 100).alias("part")
    files = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(part).agg(F.array_sort(F.collect_list(sample)).alias("all"))
    letter = F.substring(F.lit("abcdefg"), (F.col("part") % 7 + 1).cast("int"), F.lit(1))
    named = files.select(
        F.to_json(F.col("all.sample")).alias("value"), F.concat_ws("_", letter, F.lpad("part", 12, "0")).alias("source_file"), F.lit(None).cast("timestamp").alias("modified")
    )
    folder = shared_path(spark, "json-order")
    live.well_formed(live.parse_samples(named)).write.parquet(folder)
    live.use_rocksdb(spark)
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    scored = live.score_stream(stream, last_sample, 2, 1)
    table = live.run_to_table(scored, shared_path(spark, "json-numbers"), shared_path(spark, "live-checkpoint"))
    return table.select("device", "seq", *[F.round(c, 6).alias(c) for c in ("p_non_fall", "p_pre_impact")])


@query(
    "json_rejects",
    f"""SELECT problem, CASE problem WHEN 'unreadable file' THEN count(DISTINCT event_id // 50) ELSE count(*) END AS n
FROM ({_JSON_STATE}) WHERE problem IS NOT NULL GROUP BY problem""",
)
def json_rejects(spark, sf_dir):
    """Rejected samples and files by reason."""
    stream = live.rejects(live.read_sample_stream(spark, _json_files(spark, sf_dir), lines=True))
    found = live.run_to_table(stream, shared_path(spark, "rejects"), shared_path(spark, "rejects-checkpoint"), ["problem"])
    return found.groupBy("problem").agg(F.count("*").alias("n"))
