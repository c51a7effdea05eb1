"""File names, label sheets, raw lines, the trial catalogue and the store's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinelake.functions.units import RAW_COLUMNS
from kinelake.operators import catalog as trials_of
from kinelake.operators.blocks import number_rows
from kinelake.queries.registry import query
from kinelake.queries.standins import CATALOG_SQL, SAMPLES_SQL, catalog, samples, table
from kinelake.session import shared_path
from kinelake.sources import labels, naming, sensors, tables

_KFALL_NAME = """CASE o_orderkey % 10 WHEN 0 THEN 'notes.txt' WHEN 1 THEN concat('S', o_custkey % 40, 'T', o_orderkey % 37, 'R0', o_orderkey % 6, '.csv')
  WHEN 2 THEN concat('sa', o_custkey % 40, 't', o_orderkey % 37, 'r', o_orderkey % 6, '.CSV') WHEN 3 THEN concat('SA', o_custkey % 40, 'T', o_orderkey % 37, '.csv')
  ELSE concat('SA', o_custkey % 40, 'T', o_orderkey % 37, 'R0', o_orderkey % 6, '.csv') END"""


@query(
    "kfall_file_keys",
    f"""WITH f AS (SELECT o_orderkey, {_KFALL_NAME} AS name FROM orders),
r AS (SELECT *, regexp_extract(name, '(?i)^S(A)?(\\d+)T(\\d+)R(\\d+)\\.csv$', ['a', 's', 't', 'r']) AS g FROM f
      WHERE regexp_matches(name, '(?i)^S(A)?(\\d+)T(\\d+)R(\\d+)\\.csv$'))
SELECT o_orderkey, 'kfall' AS dataset, printf('SA%02d', g.s::INT) AS subject_id, printf('T%02d', g.t::INT) AS activity_code,
       'R' || g.r AS trial_id, g.t::BIGINT AS task_id, CASE WHEN g.t::INT BETWEEN 22 AND 36 THEN 'fall' ELSE 'adl' END AS label
FROM r""",
)
def kfall_file_keys(spark, sf_dir):
    path = F.concat(F.lit("/data/SA/"), F.expr(_KFALL_NAME))
    files = table(spark, sf_dir, "orders").select("o_orderkey", path.alias("path"))
    keyed = naming.with_kfall_keys(naming.trial_files(files, "path", naming.KFALL_FILE), "path")
    return keyed.withColumns({"label": naming.trial_label(), "task_id": F.col("task_id").cast("long")}).drop("path")


_SISFALL_NAME = """CASE o_orderkey % 10 WHEN 0 THEN 'Readme.txt' WHEN 1 THEN concat('f0', o_orderkey % 8 + 1, '_se', o_custkey % 40, '_r0', o_orderkey % 6, '.txt')
  WHEN 2 THEN concat('D', o_orderkey % 19 + 1, '_SA', o_custkey % 40, '.txt') ELSE concat(CASE WHEN o_orderkey % 2 = 0 THEN 'D' ELSE 'F' END, o_orderkey % 19 + 1, '_SA', o_custkey % 40, '_R0', o_orderkey % 6, '.txt') END"""


@query(
    "sisfall_file_keys",
    f"""WITH f AS (SELECT o_orderkey, {_SISFALL_NAME} AS name FROM orders),
r AS (SELECT *, regexp_extract(name, '(?i)^([DF])(\\d+)_([A-Z]{{2}}\\d+)_R(\\d+)\\.txt$', ['k', 't', 's', 'r']) AS g FROM f
      WHERE regexp_matches(name, '(?i)^([DF])(\\d+)_([A-Z]{{2}}\\d+)_R(\\d+)\\.txt$'))
SELECT o_orderkey, 'sisfall' AS dataset, upper(g.s) AS subject_id, printf('%s%02d', upper(g.k), g.t::INT) AS activity_code,
       'R' || g.r AS trial_id, g.t::BIGINT AS task_id, CASE WHEN upper(g.k) = 'F' THEN 'fall' ELSE 'adl' END AS label
FROM r""",
)
def sisfall_file_keys(spark, sf_dir):
    path = F.concat(F.lit("/data/SA01/"), F.expr(_SISFALL_NAME))
    files = table(spark, sf_dir, "orders").select("o_orderkey", path.alias("path"))
    keyed = naming.with_sisfall_keys(naming.trial_files(files, "path", naming.SISFALL_FILE), "path")
    return keyed.withColumns({"label": naming.trial_label(), "task_id": F.col("task_id").cast("long")}).drop("path")


_CODE = """CASE p_partkey % 6 WHEN 0 THEN concat('T', p_size) WHEN 1 THEN concat('F', p_size, ' (', p_size + 19, ')')
  WHEN 2 THEN concat(' t', p_size, ' ') WHEN 3 THEN concat('F', p_size, '(', p_size + 19, ')') WHEN 4 THEN concat('F', p_size, ' (', p_size + 20, ')')
  ELSE p_type END"""


@query(
    "task_codes",
    f"""WITH c AS (SELECT p_partkey, trim({_CODE}) AS code FROM part),
g AS (SELECT *, regexp_extract(code, '(?i)^F(\\d+)\\s*\\((\\d+)\\)$', ['f', 's']) AS m FROM c)
SELECT p_partkey, CASE WHEN regexp_matches(code, '(?i)^T\\d+$') THEN substr(code, 2)::BIGINT
                       WHEN try_cast(m.f AS INT) + 19 = try_cast(m.s AS INT) THEN try_cast(m.s AS BIGINT) + 2 END AS task_id,
       CASE WHEN regexp_matches(code, '(?i)^T\\d+$') THEN NULL WHEN m.s = '' THEN 'unknown task code'
            WHEN try_cast(m.f AS INT) + 19 <> try_cast(m.s AS INT) THEN 'fall number and sheet number disagree' END AS problem
FROM g""",
)
def task_codes(spark, sf_dir):
    codes = table(spark, sf_dir, "part").select("p_partkey", F.expr(_CODE).alias("code"))
    return codes.select(
        "p_partkey",
        labels.try_task_id(F.col("code")).cast("long").alias("task_id"),
        labels.task_code_problem(F.col("code")).alias("problem"),
    )


_SHEET_CODE = "CASE WHEN row_no % 3 = 0 THEN concat('F', 1 + (o_custkey + row_no) % 15, ' (', 20 + (o_custkey + row_no) % 15, ')') END"


def _sheet_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority")
    rows = number_rows(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], F.col("o_orderdate"), "row_no")
    return rows.select(
        F.col("o_custkey").alias("subject_id"),
        "row_no",
        F.expr(_SHEET_CODE).alias("Task Code (Task ID)"),
        F.expr("CASE WHEN row_no % 3 = 0 THEN o_orderpriority END").alias("Description"),
        (F.col("row_no") % 3 + 1).cast("string").alias("Trial ID"),
        (F.col("o_orderkey") % 300).cast("string").alias("Fall_onset_frame"),
        F.expr("CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE CAST(o_orderkey % 300 + 60 AS STRING) END").alias("Fall_impact_frame"),
    )


_SHEET_SQL = f"""
r AS (
  SELECT o_custkey, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS row_no FROM orders),
k AS (SELECT *, {_SHEET_CODE} AS code, CASE WHEN row_no % 3 = 0 THEN o_orderpriority END AS descr FROM r),
sheet AS (
  SELECT o_custkey AS subject_id, row_no, last_value(code IGNORE NULLS) OVER q AS code,
         last_value(descr IGNORE NULLS) OVER q AS description, row_no % 3 + 1 AS repetition, o_orderkey % 300 AS onset,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 300 + 60 END AS impact
  FROM k WINDOW q AS (PARTITION BY o_custkey ORDER BY row_no))"""


def _sheets(spark, sf_dir):
    return labels.fill_labels(_sheet_rows(spark, sf_dir), ["subject_id"], ["row_no"], F.floor(F.col("row_no") / 65_536))


@query(
    "label_sheets",
    f"""WITH {_SHEET_SQL}
SELECT subject_id, row_no, description, regexp_extract(code, '\\((\\d+)\\)', 1)::BIGINT + 2 AS task_id, repetition::BIGINT AS repetition,
       onset::BIGINT AS onset, impact::BIGINT AS impact
FROM sheet""",
)
def label_sheets(spark, sf_dir):
    """Merged cells carried down, task codes resolved, frames read as whole numbers."""
    filled = _sheets(spark, sf_dir)
    found = labels.standard_labels(filled)
    found = found.select(*[F.col(c).cast("long").alias(c) for c in found.columns])
    return found.join(filled.select("subject_id", "row_no", "description"), ["subject_id", "row_no"])


@query(
    "label_lookup",
    f"""WITH {_SHEET_SQL},
lb AS (SELECT *, regexp_extract(code, '\\((\\d+)\\)', 1)::BIGINT + 2 AS task_id FROM sheet),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, task_id, repetition ORDER BY row_no) AS nth FROM lb) WHERE nth = 1),
t AS (SELECT DISTINCT o_custkey AS subject_id, o_orderkey % 36 + 1 AS task_id, 'R0' || (o_orderkey % 4) AS trial_id FROM orders)
SELECT t.subject_id, t.task_id, t.trial_id, onset::BIGINT AS fall_onset_frame, impact::BIGINT AS fall_impact_frame
FROM t LEFT JOIN f ON f.subject_id = t.subject_id AND f.task_id = t.task_id AND f.repetition = substr(t.trial_id, 3)::INT""",
)
def label_lookup(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    trials = orders.select(
        F.col("o_custkey").alias("subject_id"),
        (F.col("o_orderkey") % 36 + 1).alias("task_id"),
        F.concat(F.lit("R0"), F.col("o_orderkey") % 4).alias("trial_id"),
    ).distinct()
    found = labels.attach_labels(trials, labels.standard_labels(_sheets(spark, sf_dir)))
    return found.select(
        "subject_id", "task_id", "trial_id",
        *[F.col(c).cast("long").alias(c) for c in ("fall_onset_frame", "fall_impact_frame")],
    )


_RAW_EXPR = [
    "l_partkey % 4096 - 2048", "l_orderkey % 4096 - 2048", "l_orderkey % 3001 - 1500", "l_partkey % 1237 - 600",
    "l_orderkey % 2111 - 1000", "l_linenumber * 37 - 100", "l_partkey % 8000 - 4000", "l_orderkey % 7001 - 3500",
    "l_linenumber * 211 - 700",
]


def _raw_lines(spark, sf_dir):
    """Sensor lines in text form, some of them blank."""
    text = F.concat(F.concat_ws(",", *[F.lpad(F.expr(e).cast("string"), 6, " ") for e in _RAW_EXPR]), F.lit(";"))
    name = F.format_string("/raw/SA%02d/%s%02d_SA%02d_R%02d.txt", F.col("l_suppkey") % 23, F.when(F.col("l_suppkey") % 3 == 0, "D").otherwise("F"), F.col("l_suppkey") % 19 + 1, F.col("l_suppkey") % 23, F.floor(F.col("l_suppkey") / 437))
    return table(spark, sf_dir, "lineitem").select(
        name.alias("source_path"), "l_orderkey", "l_partkey", "l_linenumber", F.col("l_suppkey").alias("trial"),
        F.when(F.col("l_linenumber") == 7, "  ").otherwise(text).alias("value"),
    )


@query(
    "sisfall_lines",
    f"""SELECT l_suppkey AS trial, l_orderkey, l_partkey, l_linenumber,
  {", ".join(f"({e})::BIGINT AS {c}" for c, e in zip(RAW_COLUMNS, _RAW_EXPR))}
FROM lineitem WHERE l_linenumber <> 7""",
)
def sisfall_lines(spark, sf_dir):
    parsed = sensors.parse_sisfall_lines(_raw_lines(spark, sf_dir)).drop("source_path")
    return parsed.withColumns({c: F.col(c).cast("long") for c in RAW_COLUMNS})


_RAW_TRIALS_SQL = """
t AS (
  SELECT 'sisfall' AS dataset, printf('SA%02d', l_suppkey % 23) AS subject_id,
         printf('%s%02d', CASE WHEN l_suppkey % 3 = 0 THEN 'D' ELSE 'F' END, l_suppkey % 19 + 1) AS activity_code,
         printf('R%02d', l_suppkey // 437) AS trial_id, l_suppkey % 19 + 1 AS task_id, count(*) AS n_frames,
         CASE WHEN l_suppkey % 3 = 0 THEN 'adl' ELSE 'fall' END AS label
  FROM lineitem WHERE l_linenumber <> 7 GROUP BY ALL)"""


def _raw_trials(spark, sf_dir):
    parsed = sensors.parse_sisfall_lines(_raw_lines(spark, sf_dir))
    numbered = number_rows(parsed, ["source_path"], ["l_orderkey", "l_partkey", "l_linenumber"], F.floor(F.col("l_orderkey") / 1_000_000))
    timed = numbered.withColumn("time_s", F.col("frame") / naming.SISFALL_RATE_HZ)
    return sensors.trial_metadata(naming.with_sisfall_keys(timed, "source_path"))


@query(
    "trial_metadata",
    f"""WITH {_RAW_TRIALS_SQL}
SELECT dataset, subject_id, activity_code, trial_id, task_id::BIGINT AS task_id, n_frames, label, 200.0::DOUBLE AS native_rate_hz,
       round((n_frames - 1) / 200.0, 6)::DOUBLE AS end_s, NULL::BIGINT AS fall_onset_frame, NULL::BIGINT AS fall_impact_frame
FROM t""",
)
def trial_metadata(spark, sf_dir):
    found = _raw_trials(spark, sf_dir)
    whole = ["task_id", "fall_onset_frame", "fall_impact_frame"]
    return found.select(
        "dataset", "subject_id", "activity_code", "trial_id", "n_frames", "label", "native_rate_hz",
        F.round("end_s", 6).alias("end_s"), *[F.col(c).cast("long").alias(c) for c in whole],
    )


@query(
    "reader_report",
    f"""WITH {_RAW_TRIALS_SQL},
x AS (SELECT DISTINCT printf('SA%02d', n_nationkey) AS subject_id FROM nation)
SELECT dataset, count(*) AS n_trials, count(DISTINCT subject_id) AS n_subjects, count(*) FILTER (label = 'fall') AS n_fall,
       count(*) FILTER (label = 'adl') AS n_adl, min(n_frames) AS min_rows, max(n_frames) AS max_rows, round(avg(n_frames), 6) AS mean_rows,
       (SELECT string_agg(subject_id, ',' ORDER BY subject_id) FROM x WHERE subject_id NOT IN (SELECT subject_id FROM t)) AS missing_subjects
FROM t GROUP BY dataset""",
)
def reader_report(spark, sf_dir):
    expected = table(spark, sf_dir, "nation").select(
        F.lit("sisfall").alias("dataset"), F.format_string("SA%02d", "n_nationkey").alias("subject_id")
    )
    report = sensors.reader_report(_raw_trials(spark, sf_dir), expected)
    return report.withColumns(
        {"mean_rows": F.round("mean_rows", 6), "missing_subjects": F.array_join("missing_subjects", ",")}
    )


_BROKEN = "l_linenumber = 5 AND l_partkey % 9 = 0"


@query(
    "unreadable_lines",
    f"""SELECT l_suppkey AS trial, count(*) AS n_bad FROM lineitem WHERE {_BROKEN} GROUP BY l_suppkey""",
)
def unreadable_lines(spark, sf_dir):
    """Lines with too few fields, counted per trial instead of stopping the read."""
    lines = _raw_lines(spark, sf_dir)
    broken = F.when(F.expr(_BROKEN), F.regexp_replace("value", ",[^,]*;$", ";")).otherwise(F.col("value"))
    lines = lines.withColumns({"value": broken, "source_path": F.col("trial").cast("string")})
    found = sensors.unreadable_lines(lines)
    return found.select(F.col("source_path").cast("long").alias("trial"), "n_bad")


def _flat(df):
    return df.select(*[F.col(n).cast("long").alias(n) if t == "int" else F.col(n) for n, t in df.dtypes if n != "trial"])


_MANIFEST = ", ".join(
    f"{c}::BIGINT AS {c}" if c.endswith("_frame") else c for c in trials_of.MANIFEST_COLUMNS
)


@query(
    "detection_trials",
    f"WITH {CATALOG_SQL} SELECT {_MANIFEST} FROM c WHERE accepted AND dataset IN ('kfall')",
)
def detection_trials(spark, sf_dir):
    return _flat(trials_of.detection_trials(catalog(spark, sf_dir), ["kfall"]))


@query(
    "prediction_trials",
    f"""WITH {CATALOG_SQL}
SELECT {_MANIFEST} FROM c WHERE accepted AND dataset = 'kfall' AND (fall_onset_frame IS NOT NULL OR label = 'adl')""",
)
def prediction_trials(spark, sf_dir):
    return _flat(trials_of.prediction_trials(catalog(spark, sf_dir)))


_UPSERT_SQL = f"""WITH {CATALOG_SQL},
o AS (SELECT {_MANIFEST} FROM c WHERE trial % 3 <> 1),
i AS (SELECT {_MANIFEST.replace("duration_s", "duration_s + 1 AS duration_s")} FROM c WHERE trial % 2 = 0)
SELECT * FROM o WHERE NOT EXISTS (
  FROM i WHERE i.dataset = o.dataset AND i.subject_id = o.subject_id AND i.activity_code = o.activity_code AND i.trial_id = o.trial_id)
UNION ALL SELECT * FROM i"""


def _old_and_new(spark, sf_dir):
    rows = catalog(spark, sf_dir)
    new = rows.filter(F.col("trial") % 2 == 0).withColumn("duration_s", F.col("duration_s") + 1)
    columns = trials_of.MANIFEST_COLUMNS
    return rows.filter(F.col("trial") % 3 != 1).select(*columns), new.select(*columns)


@query("manifest_upsert", _UPSERT_SQL)
def manifest_upsert(spark, sf_dir):
    return _flat(trials_of.upsert_manifest(*_old_and_new(spark, sf_dir)))


@query("manifest_table", _UPSERT_SQL)
def manifest_table(spark, sf_dir):
    """The same through the stored catalogue: two writes, one read of the newest version."""
    path = shared_path(spark, "manifest")
    for rows in _old_and_new(spark, sf_dir):
        tables.write_manifest(rows, path)
    return _flat(tables.load_manifest(spark, path).select(*trials_of.MANIFEST_COLUMNS))


@query(
    "harmonized_store",
    f"""WITH {SAMPLES_SQL}, {CATALOG_SQL}
SELECT dataset, accepted, count(*) AS n_samples, count(DISTINCT trial) AS n_trials, round(sum(acc_x), 3) AS sum_acc_x
FROM s JOIN c USING (trial) GROUP BY dataset, accepted""",
)
def harmonized_store(spark, sf_dir):
    """Samples written in two batches per dataset, the second repeating a part of the first, and read back."""
    trials = catalog(spark, sf_dir).select(*sensors.TRIAL_KEYS, "trial", "accepted")
    rows = samples(spark, sf_dir).join(trials.drop("accepted"), "trial").drop("trial")
    path, numbered = shared_path(spark, "store"), shared_path(spark, "samples")
    rows.write.partitionBy("dataset").parquet(numbered)  # numbered once for all four batches
    rows = spark.read.schema(rows.schema).parquet(numbered)
    for dataset in ("kfall", "sisfall"):
        for part in ("trial % 3 <> 1", "trial % 3 <> 2"):
            tables.write_harmonized(rows, trials.filter(part), path, dataset)
    both = [tables.read_harmonized(spark, path, flag, ["acc_x"]).withColumn("accepted", F.lit(flag)) for flag in (True, False)]
    per_trial = both[0].unionByName(both[1]).groupBy("dataset", "accepted", "trial_id").agg(
        F.count("*").alias("n"), F.sum("acc_x").alias("s")
    )
    return per_trial.groupBy("dataset", "accepted").agg(
        F.sum("n").alias("n_samples"), F.count("*").alias("n_trials"), F.round(F.sum("s"), 3).alias("sum_acc_x")
    )


@query(
    "provenance_records",
    f"""WITH {CATALOG_SQL},
v AS (SELECT *, CASE WHEN accepted THEN [] ELSE ['flatline', 'timing'] END::VARCHAR[] AS issues FROM c)
SELECT dataset, subject_id, activity_code, trial_id, accepted, to_json({{
  dataset: dataset, subject_id: subject_id, activity_code: activity_code, trial_id: trial_id, label: label,
  fall_onset_frame: fall_onset_frame, fall_impact_frame: fall_impact_frame, calibration_source: source, issues: issues,
  accepted: accepted, target_rate_hz: 100.0::DOUBLE, filter_low_hz: 0.5::DOUBLE, filter_order: 4}})::VARCHAR AS record
FROM v JOIN (SELECT dataset, subject_id, min(calibration_source) AS source FROM c GROUP BY ALL) USING (dataset, subject_id)""",
)
def provenance_records(spark, sf_dir):
    rows = catalog(spark, sf_dir)
    calibrations = rows.groupBy("dataset", "subject_id").agg(F.min("calibration_source").alias("source"))
    none = F.array().cast("array<string>")
    issues = F.when(F.col("accepted"), none).otherwise(F.array(F.lit("flatline"), F.lit("timing")))
    verdicts = rows.select(*sensors.TRIAL_KEYS, issues.alias("issues"))
    params = {"target_rate_hz": 100.0, "filter_low_hz": 0.5, "filter_order": 4}
    found = tables.provenance(rows.drop("accepted", "calibration_source"), calibrations, verdicts, params)
    return found.select(*sensors.TRIAL_KEYS, "accepted", "record")


@query(
    "run_tables",
    """SELECT 'mean_' || l_returnflag AS name, 'r1' AS run_id, 'trees' AS model, round(avg(l_quantity), 6) AS value
FROM lineitem GROUP BY l_returnflag""",
)
def run_tables(spark, sf_dir):
    """A report and its metrics appended to the run tables, then read together."""
    lines = table(spark, sf_dir, "lineitem")
    values = lines.groupBy(F.concat(F.lit("mean_"), "l_returnflag").alias("name")).agg(F.round(F.avg("l_quantity"), 6).alias("value"))
    runs, log = shared_path(spark, "runs"), shared_path(spark, "metrics")
    tables.append_run(values.select("name"), runs, "trees", "r1")
    tables.append_metrics(values.withColumn("step", F.lit(1)), log, "r1")
    stored = spark.read.parquet(log).filter(F.col("run_id") == "r1")
    return spark.read.parquet(runs).join(stored, ["name", "run_id"]).select("name", "run_id", "model", "value")


@query(
    "feature_cache",
    f"""WITH {CATALOG_SQL} SELECT dataset, count(*) AS n, round(sum(duration_s), 6) AS seconds FROM c GROUP BY dataset""",
)
def feature_cache(spark, sf_dir):
    """One dataset computed and kept, the other added on the second request; a third asks for one alone."""
    path = shared_path(spark, "features")
    rows = catalog(spark, sf_dir).select("duration_s", "trial_id", "dataset")
    tables.cache_features(rows.filter("dataset = 'kfall'"), path)
    both = tables.cache_features(rows, path)
    alone = tables.cache_features(rows.filter("dataset = 'sisfall'"), path)
    held = both.filter("dataset = 'kfall'").unionByName(alone)
    return held.groupBy("dataset").agg(F.count("*").alias("n"), F.round(F.sum("duration_s"), 6).alias("seconds"))


_CSV = {"acc_x": "AccX", "acc_y": "AccY", "acc_z": "AccZ", "gyro_x": "GyrX", "gyro_y": "GyrY", "gyro_z": "GyrZ"}


@query(
    "sensor_csv",
    f"""WITH {SAMPLES_SQL}
SELECT trial, frame::BIGINT AS frame, frame / 100.0::DOUBLE AS time_s, {", ".join(_CSV)} FROM s""",
)
def sensor_csv(spark, sf_dir):
    """All samples written as sensor CSV files, in order, then read and numbered by place in the file."""
    rows = samples(spark, sf_dir).select(
        "trial",
        "frame",
        (F.col("frame") / 100.0).alias("TimeStamp(s)"),
        (F.col("frame") + 1).alias("FrameCounter"),
        *[F.col(c).alias(n) for c, n in _CSV.items()],
        *[F.lit(0.0).alias(f"Euler{axis}") for axis in "XYZ"],
    )
    path = shared_path(spark, "csv")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(partitions, "trial", "frame").sortWithinPartitions("trial", "frame")
    ordered.drop("frame").write.option("header", True).csv(path)
    numbered = sensors.number_lines(sensors.read_sensor_csv(spark, path), ["trial"])
    return numbered.select(F.col("trial").cast("long").alias("trial"), "frame", "time_s", *_CSV)
