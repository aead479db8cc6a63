"""Command line: reports and data sets from log files, capture checks, measurements of sample files.

Exit codes: 0 done, 2 bad input, 3 a check that found problems.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyvane.operators import capture, history, report, sessions
from skyvane.session import build_session
from skyvane.sources import logs, samples
from skyvane.sources.observations import TRACK_EVENTS



def burst_table(spark: SparkSession, path: str) -> DataFrame:
    return logs.burst_log(logs.numbered_lines(spark, path))


def tables(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame, DataFrame]:
    none = spark.createDataFrame([], "session_id string, time timestamp, event string, attrs map<string,string>")
    track = logs.event_log(logs.numbered_lines(spark, a.track_log), TRACK_EVENTS) if a.track_log else none
    episodes = logs.episode_log(spark, a.episode_log) if a.episode_log else spark.createDataFrame([], logs.EPISODE)
    return burst_table(spark, a.burst_log), track, episodes


def show(df: DataFrame, as_json: bool) -> int:
    n = 0
    for r in df.toJSON().toLocalIterator():
        print(r if as_json else "  ".join(f"{k}={v}" for k, v in json.loads(r).items()))
        n += 1
    return 0 if n else 2


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="skyvane", description=__doc__)
    p.add_argument("--json", action="store_true")
    sub = p.add_subparsers(dest="do", required=True)

    def command(name: str, **flags: str | None) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for f, default in flags.items():
            c.add_argument("--" + f.replace("_", "-"), default=default, required=default == "!")
        return c

    command("episode-report", log="!", session=None)
    command("session-summary", burst_log="!", track_log=None, episode_log=None, session=None)
    command("dataset", burst_log="!", track_log=None, episode_log=None, min_bursts="2", out="!")
    command("frequency-report", burst_log="!", session="!")
    command("session-shifts", burst_log="!")
    command("group-episodes", folder="!")
    command("verify-capture", folder="!", manifest="!")
    command("measure", folder="!", kernel="spectrum", out="!")
    command("transitions", ledger="!")
    a = p.parse_args(argv)
    spark = build_session("skyvane")
    spark.sparkContext.setLogLevel("ERROR")
    try:
        if a.do == "episode-report":
            return show(sessions.episode_report(logs.episode_log(spark, a.log, a.session)), a.json)
        if a.do == "session-summary":
            out = sessions.session_summary(*tables(spark, a))
            return show(out.where(F.col("session_id") == a.session) if a.session else out.orderBy("session_id"), a.json)
        if a.do == "dataset":
            sessions.session_features(*tables(spark, a), int(a.min_bursts)).orderBy("session_id").write.mode("errorifexists").parquet(a.out)
            return 0
        if a.do == "frequency-report":
            b = burst_table(spark, a.burst_log)
            return show(report.frequency_groups(b.where(F.col("session_id") == a.session), with_id(b)), a.json)
        if a.do == "session-shifts":
            return show(report.session_shifts(with_id(burst_table(spark, a.burst_log))), a.json)
        if a.do == "group-episodes":
            f = samples.sample_files(spark, a.folder).select(F.lit(a.folder).alias("capture"), "name", (F.unix_micros("modified") * 1000).alias("mtime_ns"))
            return show(capture.file_episodes(f, ["capture"]), a.json)
        if a.do == "verify-capture":
            manifest = spark.read.json(a.manifest, multiLine=True).select(F.explode("files").alias("f")).select(F.element_at(F.split("f.path", "/"), -1).alias("path"), F.col("f.size_bytes").cast("bigint").alias("size_bytes"), "f.sha256")
            disk = samples.receipts(samples.sample_files(spark, a.folder)).withColumn("path", F.element_at(F.split("path", "/"), -1))
            bad = capture.verify_files(manifest, disk).where("verdict <> 'OK'")
            return 3 if show(bad, a.json) == 0 else 0
        if a.do == "measure":
            samples.measured(samples.sample_files(spark, a.folder), a.kernel).write.mode("errorifexists").parquet(a.out)
            return 0
        led = logs.ledger(spark, a.ledger, "block string, n int, session_id string, cluster int, nearest double, second double, separation double, ratio double, novelty string")
        return show(history.cluster_transitions(led.withColumn("all", F.lit(1)), ["all"]), a.json)
    except Exception as why:  # a bad path or line is the caller's to mend
        print(f"error: {str(why).splitlines()[0]}", file=sys.stderr)
        return 2


def with_id(b: DataFrame) -> DataFrame:
    return b.withColumn("event_id", F.monotonically_increasing_id())


if __name__ == "__main__":
    sys.exit(main())
