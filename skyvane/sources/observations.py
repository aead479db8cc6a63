"""Burst, track-event and episode-event tables: from the test tables, and from text logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def with_instant(rows: DataFrame) -> DataFrame:
    """Rows of the events table with ``at``: their wall-clock ts as the same instant in UTC, whatever the session's zone."""
    return rows.withColumn("at", F.convert_timezone(F.lit("UTC"), F.current_timezone(), "ts").cast("timestamp"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_instant(spark.read.parquet(f"{sf_dir}/events.parquet"))


def spread(rows: DataFrame, size: int) -> DataFrame:
    """rows in tasks of about ``size``, at least one a core: for rows of few bytes that make much work."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // size)))


def as_double(c: Column) -> Column:
    return c.cast("double")


def burst_rows(rows: DataFrame) -> DataFrame:
    """events read as bursts: one session per user, bearings around a centre that moves with the day of the month."""
    e, u = F.col("event_id"), F.col("user_id")
    jitter = F.when(u % 7 == 0, e % 23 - 11).otherwise(e % 5 - 2)
    centre = 37 * u + 140 * F.floor(F.day("ts") / 10)
    kind = lambda pairs, rest: F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in pairs.items()], F.lit(rest))
    peak = F.col("value") / 10 - 50
    return rows.select(
        F.concat(F.lit("S"), u).alias("session_id"), F.col("at").alias("time"), "event_id",
        kind({"view": 433.05, "click": 433.42, "purchase": 433.92, "signup": 434.3}, 434.75).alias("frequency_mhz"),
        as_double(F.pmod(centre + jitter, F.lit(360))).alias("bearing"), as_double(peak).alias("peak_power"),
        as_double(2 + F.col("value") / 50).alias("max_confidence"), as_double(1.75 + F.col("value") / 50).alias("median_confidence"),
        F.when(e % 11 != 0, as_double(40 + e % 60)).alias("doa_width"), as_double(1 + F.when(e % 4 == 0, 1).otherwise(0)).alias("median_doa_peaks"),
        as_double(e % 17).alias("bearing_spread"), as_double(1 - (e % 4) / 8).alias("single_peak_ratio"),
        kind({"error": "MULTIPATH", "signup": "LOW_QUALITY"}, "STABLE").alias("quality"), (1 + e % 6).alias("samples"),
    )


def bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return burst_rows(events(spark, sf_dir))


TRACK_EVENTS = ["TRACK_ACQUIRED", "TRACK_REACQUIRED", "TRACK_SHIFT_CONFIRMED", "TRACK_DEGRADED", "TRACK_LOST", "TRACK_RECOVERED"]
IGNORED_EVENTS = ["TRACK_SHIFT_DETECTED", "TRACK_VARIABLE"]


def track_rows(rows: DataFrame) -> DataFrame:
    names = F.array(*map(F.lit, TRACK_EVENTS + IGNORED_EVENTS))
    kind = F.when(F.col("event_type") == "signup", "T").otherwise("S")  # sign-ups come from sessions without bursts
    return rows.select(F.concat(kind, "user_id").alias("session_id"), F.col("at").alias("time"), "event_id", F.element_at(names, (F.col("event_id") % 8 + 1).cast("int")).alias("event"))


def track_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track_rows(events(spark, sf_dir))


def episode_rows(rows: DataFrame) -> DataFrame:
    k = F.col("event_id")
    kind = F.when(F.col("event_type") == "error", "E").otherwise("S")  # errors come from sessions without bursts
    turn = k % 4
    closed = turn >= 2
    return rows.select(
        F.concat(kind, "user_id").alias("session_id"), F.col("at").alias("time"), "event_id",
        F.when(closed, "EPISODE_CLOSED").otherwise("EPISODE_STARTED").alias("event"), (k % 7 + 1).cast("int").alias("episode_id"),
        F.when(closed, F.when(turn == 2, "SHIFT_CONFIRMED").otherwise("TRACK_LOST")).alias("reason"),
        F.when(closed, F.struct((k % 50).alias("start_index"), (k % 50 + 9).alias("end_index"), as_double(k % 360).alias("start_mean"), as_double(k % 359).alias("latest_mean"), (k % 30).alias("max_support"), (k % 3 == 0).alias("degraded_seen"), F.when(turn == 2, "SHIFT_CONFIRMED").otherwise("TRACK_LOST").alias("end_reason"))).alias("summary"),
    )


def episode_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episode_rows(events(spark, sf_dir))


#: The same three tables for DuckDB, as common table expressions.
BURSTS_SQL = """
bursts AS (
  SELECT 'S' || user_id AS session_id, ts AS time, event_id,
    CASE event_type WHEN 'view' THEN 433.05::DOUBLE WHEN 'click' THEN 433.42::DOUBLE WHEN 'purchase' THEN 433.92::DOUBLE WHEN 'signup' THEN 434.3::DOUBLE ELSE 434.75::DOUBLE END AS frequency_mhz,
    ((((37 * user_id + 140 * floor(day(ts) / 10)::BIGINT + CASE WHEN user_id % 7 = 0 THEN event_id % 23 - 11 ELSE event_id % 5 - 2 END) % 360) + 360) % 360)::DOUBLE AS bearing,
    value / 10 - 50 AS peak_power, 2 + value / 50 AS max_confidence, 1.75::DOUBLE + value / 50 AS median_confidence,
    CASE WHEN event_id % 11 <> 0 THEN (40 + event_id % 60)::DOUBLE END AS doa_width,
    (1 + CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END)::DOUBLE AS median_doa_peaks, (event_id % 17)::DOUBLE AS bearing_spread,
    1 - (event_id % 4)::DOUBLE / 8 AS single_peak_ratio,
    CASE event_type WHEN 'error' THEN 'MULTIPATH' WHEN 'signup' THEN 'LOW_QUALITY' ELSE 'STABLE' END AS quality, 1 + event_id % 6 AS samples
  FROM events)"""
TRACK_SQL = """
track AS (
  SELECT CASE event_type WHEN 'signup' THEN 'T' ELSE 'S' END || user_id AS session_id, ts AS time, event_id,
    (['TRACK_ACQUIRED','TRACK_REACQUIRED','TRACK_SHIFT_CONFIRMED','TRACK_DEGRADED','TRACK_LOST','TRACK_RECOVERED','TRACK_SHIFT_DETECTED','TRACK_VARIABLE'])[event_id % 8 + 1] AS event
  FROM events)"""
EPISODES_SQL = """
episodes AS (
  SELECT CASE event_type WHEN 'error' THEN 'E' ELSE 'S' END || user_id AS session_id, event_id, CASE WHEN event_id % 4 >= 2 THEN 'EPISODE_CLOSED' ELSE 'EPISODE_STARTED' END AS event,
    (event_id % 7 + 1)::INT AS episode_id, CASE event_id % 4 WHEN 2 THEN 'SHIFT_CONFIRMED' WHEN 3 THEN 'TRACK_LOST' END AS reason,
    CASE WHEN event_id % 4 >= 2 THEN event_id % 3 = 0 END AS degraded
  FROM events)"""
