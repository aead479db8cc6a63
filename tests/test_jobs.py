"""The jobs: against DuckDB, run again, over growing input, after a failure, and from the command line."""

import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import session_dataset, text_audit
from jobs.common import settings
from jobs.registry import QUERIES, SQL
from tests.test_queries import TABLES, plain

ROOT = Path(__file__).resolve().parent.parent


def rows(df):
    cols = sorted(df.columns)
    return sorted(str([r[c] for c in cols]) for r in df.collect())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_duckdbs_rows(spark, small, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    before = {k: spark.conf.get(k) for k in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.shuffle.partitions")}
    df = QUERIES[name](spark, small)
    r = c.execute(SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    want = [dict(zip(names, x, strict=True)) for x in r.fetchall()]
    assert sorted([plain(x[n]) for n in sorted(names)] for x in df.collect()) == sorted([plain(x[n]) for n in sorted(names)] for x in want)
    assert len(want) and before == {k: spark.conf.get(k) for k in before}


def test_new_files_only_and_days_computed_anew(spark, small, tmp_path):
    """Files arrive one by one: late rows for days that are done, a file delivered again, rows without a time, nothing."""
    e = spark.read.parquet(f"{small}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    odd = e.where("event_id < 5").withColumn("ts", F.lit(None).cast(e.schema["ts"].dataType)).withColumn("event_id", F.col("event_id") + 5000)
    parts = [e.where("event_id % 3 = 0"), e.where("event_id % 3 = 1 and user_id % 2 = 0"), e.where("event_id % 3 = 0 and event_id < 300"), e.where("event_id % 3 = 1 and user_id % 2 = 1").unionAll(odd), e.where("event_id % 3 = 2")]
    given, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    run = lambda: session_dataset.run(spark, given, out, mark, **settings("session_dataset"))
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(str(tmp_path / f"made{i}"))
        os.makedirs(given, exist_ok=True)
        shutil.copy(next((tmp_path / f"made{i}").glob("part-*")), f"{given}/{i}.parquet")
        did = run()
        assert (did["batches"], did["rows_read"]) == (1, part.count())
        seen = spark.read.parquet(given)
        got = session_dataset.output(spark, given, out)
        assert rows(got) == rows(session_dataset.day_features(seen, 2, 4))
        files = sorted(Path(out, "features").rglob("*.parquet"))
        assert run() == {"batches": 0, "rows_read": 0, "rows_written": 0, "days": 0}
        assert sorted(Path(out, "features").rglob("*.parquet")) == files
    assert got.where("day is null").count() >= 0 and spark.read.parquet(f"{out}/landed").count() == sum(p.count() for p in parts)
    at_once = str(tmp_path / "at_once")
    session_dataset.run(spark, given, at_once, str(tmp_path / "mark2"), files_per_batch=2)
    assert rows(session_dataset.output(spark, given, at_once)) == rows(got)


def test_a_batch_that_failed_is_repeated(spark, small, tmp_path, monkeypatch):
    given, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    e = spark.read.parquet(f"{small}/events.parquet")
    e.where("event_id % 2 = 0").coalesce(1).write.parquet(given)
    session_dataset.run(spark, given, out, mark)
    e.where("event_id % 2 = 1").coalesce(1).write.mode("append").parquet(given)
    with monkeypatch.context() as m:
        m.setattr(session_dataset, "day_features", lambda *_: 1 / 0)  # after the rows have landed
        with pytest.raises(Exception, match="division"):
            session_dataset.run(spark, given, out, mark)
    assert session_dataset.run(spark, given, out, mark)["rows_read"] == e.where("event_id % 2 = 1").count()
    assert rows(session_dataset.output(spark, given, out)) == rows(session_dataset.day_features(e, 2, 4))
    assert spark.read.parquet(f"{out}/landed").count() == e.count()


def test_an_empty_table_and_a_hot_session(spark, small, tmp_path):
    e = spark.read.parquet(f"{small}/events.parquet")
    e.limit(0).write.parquet(str(tmp_path / "none"))
    assert session_dataset.run(spark, str(tmp_path / "none"), str(tmp_path / "o"), str(tmp_path / "m"))["rows_written"] == 0
    assert session_dataset.output(spark, str(tmp_path / "none"), str(tmp_path / "o")).count() == 0
    one = e.withColumn("user_id", F.lit(7).cast("bigint"))
    assert session_dataset.day_features(one, 1, 4).agg(F.sum("burst_count")).first()[0] == e.count()


def test_audit_of_odd_texts(spark, tmp_path):
    docs = [
        (1, "a=1,b=2\nno record\na=1,a=2\n=3\nb=,c", "s"), (2, "", "s"), (3, "", None), (4, None, "s"), (None, "x", "s"), (5, "x", "t"), (6, "The emitter is reliable.", "s"), (6, "The emitter is reliable.", "s"),
        (7, "k=v," * 50_000 + "z=1", "s"), (8, "é\r\n=", "s"), (9, " a = 1 ,b= ", "s"),
    ]
    spark.createDataFrame(docs, "doc_id bigint, text string, source string").selectExpr("*", "'u' as origin", "1 as copies").write.parquet(str(tmp_path / "d"))
    turns = [(1, 0, "user", "x"), (1, 1, "assistant", None), (1, 2, None, "The emitter is reliable.")]
    spark.createDataFrame(turns, "conv_id bigint, turn int, role string, text string").write.parquet(str(tmp_path / "c"))
    paths = [str(tmp_path / x) for x in "dc"]
    did = text_audit.run(spark, *paths, str(tmp_path / "out"), **settings("text_audit"))
    first = rows(text_audit.output(spark, str(tmp_path / "out")))
    assert did == {"texts": 14, "with_claims": 3, "with_broken_records": 3, "copied": 8}
    assert text_audit.run(spark, *paths, str(tmp_path / "out")) == did and rows(text_audit.output(spark, str(tmp_path / "out"))) == first
    got = {(r.origin, r.id, r.part, r.kind): r for r in text_audit.output(spark, str(tmp_path / "out")).collect()}
    of = lambda i, kind="s": got["documents", i, None, kind]
    assert (of(1).n_lines, of(1).n_records, of(1).n_broken) == (5, 1, 3) and (of(7).n_records, of(7).n_broken) == (0, 1) and of(9).n_records == 1
    assert (of(4).sha256, of(4).n_lines, of(4).copies, of(4).first_id, of(4).n_bytes) == (None, 0, None, None, 0) and (of(2).n_lines, of(2).copies, of(3, None).first_id) == (1, 2, 2)
    assert (of(None).copies, of(5, "t").first_origin, of(5, "t").first_id) == (3, "conversations", 1) and of(6).copies == 3 and of(6).claims == "physical source reliability or stability"
    c = duckdb.connect()
    for t, p in (("documents", "d"), ("conversations", "c")):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{p}/*.parquet'")
    r = c.execute(text_audit.JOB2_SQL)
    names = [d[0] for d in r.description]
    want = sorted(str([plain(dict(zip(names, x, strict=True))[n]) for n in sorted(names)]) for x in r.fetchall())
    assert sorted(str([plain(r[n]) for n in sorted(names)]) for r in text_audit.output(spark, str(tmp_path / "out")).collect()) == want


def test_audit_drops_partitions_that_are_gone(spark, tmp_path):
    make = lambda name, kinds: spark.createDataFrame([(i, "t", k) for i, k in enumerate(kinds)], "doc_id bigint, text string, source string").write.parquet(str(tmp_path / name))
    make("one", "ab")
    make("two", "b")
    spark.createDataFrame([], "conv_id bigint, turn int, role string, text string").write.parquet(str(tmp_path / "c"))
    for name, n in (("one", 2), ("two", 1)):
        assert text_audit.run(spark, str(tmp_path / name), str(tmp_path / "c"), str(tmp_path / "out"))["texts"] == n


def test_settings_and_command_line(small, tmp_path):
    assert settings("session_dataset")["min_bursts"] == 2 and settings("session_dataset", '{"min_bursts": 9}')["min_bursts"] == 9
    with pytest.raises(ValueError, match="min_burst"):
        settings("session_dataset", '{"min_burst": 9}')
    (tmp_path / "s.json").write_text('{"min_bursts": 1}')
    env = os.environ | {"PYTHONPATH": str(ROOT)}
    go = [sys.executable, "-m", "jobs.session_dataset", "--observations", f"{small}/events.parquet", "--out", f"{tmp_path}/o", "--checkpoint", f"{tmp_path}/m", "--settings", str(tmp_path / "s.json")]
    first = subprocess.run(go, cwd=ROOT, env=env, capture_output=True, text=True, check=True)
    did = json.loads(first.stdout.strip().split("\n")[-1])
    assert did["rows_read"] == 1000 and did["rows_written"] > 0 and "read 1000 rows" in first.stderr
    again = subprocess.run(go, cwd=ROOT, env=env, capture_output=True, text=True, check=True)
    assert json.loads(again.stdout.strip().split("\n")[-1])["batches"] == 0
