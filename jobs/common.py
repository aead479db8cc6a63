"""What the jobs share: settings, paths, logging, a folder for a registered run."""

from __future__ import annotations

import argparse
import json
import logging
import sys
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from skyvane.session import build_session

HERE = Path(__file__).resolve().parent


def settings(name: str, changes: str | None = None) -> dict:
    """The settings in the file beside the job, with those in the text of another one instead; unknown names are refused."""
    own = json.loads((HERE / f"{name}.json").read_text())
    new = json.loads(changes) if changes else {}
    if unknown := sorted(set(new) - set(own)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return own | new


def text_of(spark: SparkSession, path: str) -> str:
    """A small text file, through the file system that its path names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def any_of(path: str) -> str:
    """The path as a pattern that only it matches: a file stream takes a single file or a folder that way."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def written(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """What a job wrote, with its declared types; an output without rows is empty, not an error."""
    return spark.read.schema(schema).parquet(path)


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; only a local session without that setting gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(base or tempfile.mkdtemp(prefix='skyvane-jobs-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def command(name: str, about: str | None, paths: dict[str, str], work: Callable[..., dict], argv: list[str] | None = None) -> int:
    """A job's command line: its paths, and a settings file. Makes the session and stops it; 0 if the work was done."""
    p = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=about)
    for flag, help_ in paths.items():
        p.add_argument(f"--{flag}", required=True, help=help_)
    p.add_argument("--settings", help="a JSON file with settings that differ from those beside the job")
    a = vars(p.parse_args(argv))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s", stream=sys.stderr)
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = build_session(name)
    try:
        given = a.pop("settings")
        print(json.dumps(work(spark, **a, **settings(name, text_of(spark, given) if given else None))))
    finally:
        spark.stop()
    return 0
