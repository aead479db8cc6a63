"""Session features by day, kept up to date with the observation files that arrive.

A file stream takes the files that no run has taken before, and its checkpoint remembers them. Each micro-batch is
landed by day in a folder of its own number; then the days it touches, late rows included, are computed anew from all
that has landed and replace their partitions. A batch that is repeated after a failure replaces itself.

    python -m jobs.session_dataset --observations IN --out OUT --checkpoint CHECKPOINT [--settings FILE]
"""

from __future__ import annotations

import logging
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobs.common import any_of, command, run_folder, settings, written
from skyvane.functions.stats import shown
from skyvane.operators.sessions import session_features
from skyvane.plans.report_queries import FEATURES, SESSION_FEATURES
from skyvane.sources import observations as o

NAME = "session_dataset"
log = logging.getLogger(f"jobs.{NAME}")


def day_of(time: str) -> Column:
    """The date of an instant in UTC, which is that of the observation's own clock, whatever the session's zone."""
    return F.to_date(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col(time).cast("timestamp_ntz")))


def day_features(landed: DataFrame, min_bursts: int, digits: int) -> DataFrame:
    """A row for each session and day with at least ``min_bursts`` bursts.

    Numbers have ``digits`` decimals, so that they do not depend on the order in which rows were added up. Rows without a
    time have the day null; rows alike in all columns are one, however often a file was delivered.
    """
    e = o.with_instant(landed.select("event_id", "ts", "user_id", "event_type", "value").dropDuplicates())
    of_day = lambda d: d.withColumn("session_id", F.concat_ws("@", "session_id", F.coalesce(day_of("time").cast("string"), F.lit(""))))
    f = session_features(of_day(o.burst_rows(e)), of_day(o.track_rows(e)), of_day(o.episode_rows(e)), min_bursts)
    numbers = [shown(c, digits).alias(c) if c in FEATURES else F.col(c) for c in f.columns if c != "session_id"]
    out = f.select(F.substring_index("session_id", "@", 1).alias("session_id"), *numbers, F.substring_index("session_id", "@", -1).try_cast("date").alias("day"))
    full = F.round(F.col("bearing_circular_mean_deg") % 360, digits)  # a rounded 360 is 0
    return out.withColumn("bearing_circular_mean_deg", full)


def schema(spark: SparkSession, kind: T.StructType) -> T.StructType:
    return day_features(spark.createDataFrame([], kind), 1, 4).schema


def run(spark: SparkSession, observations: str, out: str, checkpoint: str, min_bursts: int = 2, digits: int = 4, files_per_batch: int = 1000) -> dict:
    """Take what is new in ``observations`` (a Parquet file or a folder of them) into ``out``/features, by day.

    ``out``/landed keeps the rows taken, by batch and day. Returns the numbers of batches and rows taken and of the rows
    written. Nothing new changes nothing.
    """
    kind = spark.read.parquet(observations).schema
    by_day = T.StructType([*kind.fields, T.StructField("batch", T.LongType()), T.StructField("day", T.DateType())])
    did = {"batches": 0, "rows_read": 0, "rows_written": 0, "days": 0}

    def take(batch: DataFrame, number: int) -> None:
        mine = f"{out}/landed/batch={number}"
        batch.withColumn("day", F.to_date("ts")).hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(mine)
        landed = spark.read.schema(by_day).option("basePath", f"{out}/landed").parquet(f"{out}/landed")
        new = landed.where(F.col("batch") == number)
        counted = {r["day"]: r["n"] for r in new.groupBy("day").agg(F.count("*").alias("n")).collect()}  # a row a calendar day
        touched = F.col("day").isin([d for d in counted if d is not None]) | (F.col("day").isNull() if None in counted else F.lit(False))
        features = day_features(landed.where(touched), min_bursts, digits)
        features.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{out}/features")
        n = written(spark, f"{out}/features", schema(spark, kind)).where(touched).count()
        for k, v in {"batches": 1, "rows_read": sum(counted.values()), "rows_written": n, "days": len(counted)}.items():
            did[k] += v
        log.info("batch %d: read %d rows of %d days from %s, wrote %d sessions to %s/features", number, sum(counted.values()), len(counted), observations, n, out)

    source = spark.readStream.schema(kind).option("maxFilesPerTrigger", files_per_batch).parquet(any_of(observations))
    query = source.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("taken: %s", did)
    return did


def output(spark: SparkSession, observations: str, out: str) -> DataFrame:
    """All session features that stand in ``out``."""
    return written(spark, f"{out}/features", schema(spark, spark.read.parquet(observations).schema))


def job1_session_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job over the whole events table, twice into one new folder: the second run finds nothing new."""
    folder, events = run_folder(spark, "job1"), f"{sf_dir}/events.parquet"
    for _ in range(2):
        run(spark, events, f"{folder}/out", f"{folder}/checkpoint", **settings(NAME))
    out = output(spark, events, f"{folder}/out")
    return out.withColumn("start_time", F.unix_micros("start_time")).withColumn("end_time", F.unix_micros("end_time"))


JOB1_SQL = f"""SELECT * EXCLUDE (session_id), split_part(session_id, '@', 1) AS session_id, split_part(session_id, '@', 2)::DATE AS day
FROM ({SESSION_FEATURES.replace("user_id AS session_id", "user_id || '@' || strftime(ts, '%Y-%m-%d') AS session_id")})"""

if __name__ == "__main__":
    sys.exit(command(NAME, __doc__, {"observations": "Parquet file or folder of observations", "out": "folder of the output", "checkpoint": "folder of what was taken"}, run))
