"""Queries of text logs and model tables: lines are written from the test tables and read back by the log sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyvane.functions.stats import shown
from skyvane.operators import history, ml
from skyvane.plans import sqltext as q
from skyvane.plans.history_queries import DIMS, SCORE, vectors
from skyvane.sources import logs
from skyvane.sources.observations import TRACK_EVENTS, burst_rows, events, spread, track_events

show = q.shown


def burst_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A burst log with markers, blank parts, unknown qualities and records without a session."""
    rows = spread(events(spark, sf).select("event_id", "ts", "at", "user_id", "event_type", "value"), 50_000)
    b = burst_rows(rows).withColumn("quality", F.when(F.col("event_id") % 13 == 0, "ODD").otherwise(F.col("quality"))).withColumn("session_id", F.when(F.col("event_id") % 17 != 0, F.col("session_id")).otherwise(""))
    fields = ["session_id", "time", "frequency_mhz", "bearing", "peak_power", "doa_width", "quality", "samples", "event_id"]
    lines = logs.kv_text(b.withColumn("time", F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss")).withColumn("bearing", F.col("bearing") - 360), fields)
    marker = spark.range(3).select(F.concat(F.lit("SESSION_START | id=S"), "id", F.lit(" | time=2026-01-01T00:00:00")).alias("value"))
    return lines.unionAll(marker)


def burst_log(spark: SparkSession, sf: str) -> DataFrame:
    out = logs.burst_log(burst_lines(spark, sf))
    return out.groupBy("session_id", "quality").agg(F.count("*").alias("n"), F.sum("bearing").alias("bearing_sum"), F.sum("samples").alias("samples_sum"), F.count("doa_width").alias("widths"), F.count("time").alias("times"))


BURST_LOG = f"""WITH {q.B} SELECT session_id, quality, count(*)::BIGINT AS n, sum(bearing) AS bearing_sum, sum(samples)::DOUBLE AS samples_sum, count(doa_width)::BIGINT AS widths, count(*)::BIGINT AS times
FROM bursts WHERE event_id % 13 <> 0 AND event_id % 17 <> 0 GROUP BY ALL"""


def event_log(spark: SparkSession, sf: str) -> DataFrame:
    t = track_events(spark, sf).withColumn("time", F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss")).withColumn("mean", F.col("event_id") % 360)
    out = logs.event_log(logs.kv_text(t, ["time", "session_id", "event", "mean"]), TRACK_EVENTS)
    return out.groupBy("session_id", "event").agg(F.count("*").alias("n"), F.sum(F.col("attrs")["mean"].cast("bigint")).alias("mean_sum"))


EVENT_LOG = f"WITH {q.T} SELECT session_id, event, count(*)::BIGINT AS n, sum(event_id % 360)::BIGINT AS mean_sum FROM track WHERE event NOT IN ('TRACK_SHIFT_DETECTED', 'TRACK_VARIABLE') GROUP BY ALL"


def marker_times(spark: SparkSession, sf: str) -> DataFrame:
    """Start and end by session where markers repeat: the last one with a time counts."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    minute = F.lpad((F.col("event_id") % 60).cast("string"), 2, "0")
    line = F.concat(F.when(F.col("event_id") % 2 == 0, "SESSION_START").otherwise("SESSION_END"), F.lit(" | id=S"), F.col("user_id"), F.lit(" | time="), F.when(F.col("event_id") % 7 == 0, "soon").otherwise(F.concat(F.lit("2026-01-01T00:"), minute, F.lit(":00"))))
    m = logs.markers(e.select(F.col("event_id").alias("line_no"), line.alias("value")))
    out = logs.session_times(m)
    return out.select("session_id", F.minute("start_time").alias("start_minute"), F.minute("end_time").alias("end_minute"))


MARKERS = """SELECT 'S' || user_id AS session_id, (max(event_id) FILTER (event_id % 2 = 0 AND event_id % 7 <> 0) % 60)::INT AS start_minute, (max(event_id) FILTER (event_id % 2 = 1 AND event_id % 7 <> 0) % 60)::INT AS end_minute FROM events GROUP BY 1"""


def latest_session(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    line = F.concat(F.lit("SESSION_START | id=S"), F.col("user_id"), F.lit(" | time=x"))
    return logs.latest_session(logs.markers(e.select(F.col("event_id").alias("line_no"), line.alias("value"))))


LATEST = "SELECT 'S' || arg_max(user_id, event_id) AS session_id FROM events"


def activation_log(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    line = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("note | "), "event_id")).otherwise(F.concat(F.lit("A"), "event_id", F.lit(" | wall=2026-01-01T00:00:00+00:00 | monotonic_ns="), F.col("event_id") * 1_000_000_007))
    return logs.activation_log(e.select(line.alias("value"))).select("label", "monotonic_ns", F.col("wall").isNotNull().alias("has_wall"))


ACTIVATIONS = "SELECT 'A' || event_id AS label, event_id * 1000000007 AS monotonic_ns, true AS has_wall FROM events WHERE event_id % 4 <> 0"


def hash_list(spark: SparkSession, sf: str) -> DataFrame:
    p = spark.read.parquet(f"{sf}/part.parquet")
    line = F.concat(F.sha2(F.col("p_name").cast("binary"), 256), F.when(F.col("p_partkey") % 9 == 0, " ").otherwise("  "), F.lit("files/"), F.col("p_partkey") % 1500)
    return logs.hash_list(p.select(line.alias("value")))


HASHES = """WITH h AS (SELECT sha256(p_name) AS sha256, 'files/' || p_partkey % 1500 AS path FROM part WHERE p_partkey % 9 <> 0) SELECT sha256, path, count(*) OVER (PARTITION BY path) > 1 AS repeated FROM h"""


def strict_errors(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id")
    line = F.concat(F.lit("a="), n, F.when(n % 3 == 0, ",b").otherwise(",b=1"), F.when(n % 5 == 0, ",=2").otherwise(""), F.when(n % 7 == 0, ",a=3").otherwise(""))
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", logs.strict_error(line).alias("problem"))


STRICT = "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'part without =' WHEN event_id % 5 = 0 THEN 'empty key' WHEN event_id % 7 = 0 THEN 'repeated key' END AS problem FROM events"


def trained(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    train = vectors(spark, sf).where("vec_id % 2 = 0")
    return train, ml.model_params(train, DIMS)


def model_params(spark: SparkSession, sf: str) -> DataFrame:
    return trained(spark, sf)[1].select("feature", *[shown(c).alias(c) for c in ("median", "mean", "scale")])


HEAD = SCORE[: SCORE.index("c AS (")].rstrip().rstrip(",")
PARAMS = HEAD + " " + " UNION ALL ".join(f"SELECT '{f}' AS feature, {show(f'm_{f}')} AS median, {show(f'a_{f}')} AS mean, {show(f's_{f}')} AS scale FROM m, p" for f in DIMS)


def freeze_model(spark: SparkSession, sf: str) -> DataFrame:
    train, params = trained(spark, sf)
    out = ml.freeze(ml.standardized(train, DIMS, params))
    return out.select("cluster", "ref_count", *[shown(c).alias(c) for c in ("ref_mean", "ref_median", "ref_max")], *[shown(F.col("centroid")[i]).alias(f"c{i}") for i in range(len(DIMS))])


FREEZE = HEAD + f""", c AS (SELECT cluster, {', '.join(f'avg({f}) AS {f}' for f in DIMS)} FROM x WHERE vec_id % 2 = 0 GROUP BY 1),
d AS (SELECT x.cluster, sqrt({' + '.join(f'pow(x.{f} - c.{f}, 2)' for f in DIMS)}) AS d FROM x JOIN c USING (cluster) WHERE vec_id % 2 = 0)
SELECT cluster, count(*)::BIGINT AS ref_count, {show('avg(d)')} AS ref_mean, {show('median(d)')} AS ref_median, {show('max(d)')} AS ref_max, {', '.join(show(f'any_value(c.{f})') + f' AS c{i}' for i, f in enumerate(DIMS))} FROM d JOIN c USING (cluster) GROUP BY cluster"""


def session_blocks(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet").select((F.col("event_id") % 20).cast("int").alias("n"))
    return e.groupBy(history.block_of(F.col("n")).alias("block")).agg(F.count("*").alias("sessions"))


SESSION_BLOCKS = "SELECT CASE WHEN event_id % 20 IN (5, 6, 7) THEN 'A' WHEN event_id % 20 IN (8, 9, 10) THEN 'B' WHEN event_id % 20 IN (11, 12, 13) THEN 'C' WHEN event_id % 20 IN (15, 16, 17) THEN 'D' END AS block, count(*)::BIGINT AS sessions FROM events GROUP BY 1"

QUERIES = {
    "burst_log": burst_log, "event_log": event_log, "marker_times": marker_times, "latest_session": latest_session, "activation_log": activation_log, "hash_list": hash_list, "strict_errors": strict_errors,
    "model_params": model_params, "freeze_model": freeze_model, "session_blocks": session_blocks,
}
SQL = {
    "burst_log": BURST_LOG, "event_log": EVENT_LOG, "marker_times": MARKERS, "latest_session": LATEST, "activation_log": ACTIVATIONS, "hash_list": HASHES, "strict_errors": STRICT,
    "model_params": PARAMS, "freeze_model": FREEZE, "session_blocks": SESSION_BLOCKS,
}
