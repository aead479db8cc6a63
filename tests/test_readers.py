"""Line numbers over splits, the reader of one session's records, and live bursts against the batch form."""

import json

import pytest
from pyspark.sql import functions as F

from skyvane.operators.bursts import aggregate_bursts
from skyvane.sources import logs
from skyvane.streaming.live import append_once, burst_stream


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "700b")
    spark.conf.set(names[1], "1b")
    yield
    for n, v in old.items():
        spark.conf.set(n, v)


def test_line_numbers_in_a_file_of_many_splits(spark, tmp_path, small_splits):
    texts = {"a.log": [f"line {i} " + "x" * (i % 90) if i % 7 else "" for i in range(1, 400)], "b.log": ["", "one", "  ", "é" * 900, "last\rpart\r"]}
    for name, lines in texts.items():
        (tmp_path / name).write_text("\n".join(lines), newline="")
    df = logs.numbered_lines(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    got = sorted((r.path.rsplit("/", 1)[1], r.line_no, r.value) for r in df.collect())
    assert got == sorted((n, i, x.removesuffix("\r")) for n, lines in texts.items() for i, x in enumerate(lines, 1) if x.strip(" "))


def test_one_sessions_records(spark, tmp_path, small_splits):
    lines = [f"session_id={'AB'[i % 2]},event=E{i},n={i}" for i in range(200)]
    lines[10:10] = ["SESSION_START | id=A", "", "event=nobody"]
    (tmp_path / "track.log").write_text("\n".join(lines))
    event = lambda s, i: json.dumps({"session_id": s, "event": "EPISODE_STARTED", "episode_id": i})
    (tmp_path / "episodes.jsonl").write_text("\n".join(event("AB"[i % 2], i) for i in range(50)))
    paths = {"bursts": str(tmp_path / "none.log"), "track": str(tmp_path / "track.log"), "episodes": str(tmp_path / "episodes.jsonl")}
    got, missing = logs.session_records(spark, paths, "A")
    assert missing == ["bursts"] and set(got) == {"track", "episodes"}
    assert sorted(int(r.m["n"]) for r in got["track"].collect()) == list(range(0, 200, 2)) and sorted(r.r.episode_id for r in got["episodes"].collect()) == list(range(0, 50, 2))
    (tmp_path / "track.log").write_text("\n".join([*lines, "session_id=B,event"]))  # a bad line of another session
    with pytest.raises(Exception, match=r"track\.log: line 204: part without ="):
        logs.session_records(spark, paths, "A")[0]["track"].collect()
    for bad, why in (('{"event": "x"}', "no session"), ("{", "no episode event")):
        (tmp_path / "episodes.jsonl").write_text("\n".join([event("A", 1), "", bad]))
        with pytest.raises(Exception, match=rf"episodes\.jsonl: line 3: {why}"):
            logs.session_records(spark, paths, "A")[0]["episodes"].collect()


def test_live_bursts_are_those_of_the_batch(spark, tmp_path):
    """Gaps of exactly three seconds, just under and over; even and odd numbers of frames; frames under the gate."""
    at, rows = 0, []
    for i, gap in enumerate([0, 1_000_000, 2_999_999, 3_000_000, 500_000, 3_000_001, 3_000_000, 1, 1, 1, 2_999_999, 60_000_000]):
        at += gap
        rows += [(s, i, at + 7 * (s == "b"), 10.0 + 3 * i, -30.0 - i if i != 8 else -50.0, 3.0 + i % 4, 433.9, 40.0 + i, 1.0 + i % 2) for s in "ab"]
    frames = spark.createDataFrame(rows, "session_id string, event_id int, us bigint, bearing double, power double, confidence double, frequency_mhz double, width double, peaks double")
    frames = frames.select("session_id", "event_id", F.timestamp_micros(F.col("us") + 1_770_000_000_000_000).alias("time"), *frames.columns[3:])
    for part in ("event_id < 5", "event_id >= 5"):
        frames.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = burst_stream(spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), ["session_id"], late="1 hour")
    go = lambda s: s.writeStream.foreachBatch(append_once(str(tmp_path / "out"))).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    go(stream)
    late = frames.where("event_id = 11").withColumn("time", F.col("time") + F.expr("interval 2 hours"))
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    go(stream)
    names = ["samples", "peak_power", "max_confidence", "median_confidence", "doa_width", "median_doa_peaks", "single_peak_ratio", "quality", "end_time", "bearing", "bearing_spread"]
    seen = lambda df, start: sorted([r.session_id, r[start], *[round(r[n], 9) if isinstance(r[n], float) else r[n] for n in names]] for r in df.collect())
    got, want = seen(spark.read.parquet(str(tmp_path / "out")), "time"), seen(aggregate_bursts(frames), "start_time")
    assert got == want and len(want) == 10 and [r[2] for r in want if r[0] == "a"] == [3, 2, 1, 4, 1]


def test_a_snapshots_records_are_those_of_its_digest(spark, tmp_path):
    import hashlib

    from skyvane.operators.evidence import drifted, snapshot

    texts = {"a.jsonl": b'{"n": 1}\n\n{"n": 2}\r\nno json', "b.jsonl": b"\n", "c.jsonl": b'\xff\xfe{"n": 1}', "d.jsonl": '{"n": 3, "é": 1}'.encode()}
    for name, t in texts.items():
        (tmp_path / name).write_bytes(t)
    df = snapshot(spark, str(tmp_path), "n int")
    got = sorted((r.path.rsplit("/", 1)[1], r.n_bytes, r.sha256, r.line_no, r.r.n if r.r else None) for r in df.collect())
    row = lambda name, *x: (name, len(texts[name]), hashlib.sha256(texts[name]).hexdigest(), *x)
    assert got == [row("a.jsonl", 1, 1), row("a.jsonl", 3, 2), row("a.jsonl", 4, None), row("b.jsonl", None, None), row("c.jsonl", None, None), row("d.jsonl", 1, 3)]
    first = spark.createDataFrame(df.drop("r").collect(), df.drop("r").schema)
    (tmp_path / "d.jsonl").write_bytes(b'{"n": 4}')  # the frame is read again: digest and records change together
    (tmp_path / "b.jsonl").unlink()
    (tmp_path / "e.jsonl").write_bytes(b"x")
    now = snapshot(spark, str(tmp_path), "n int")
    changed = [r for r in now.collect() if r.path.endswith("d.jsonl")]
    assert [(r.r.n, r.sha256) for r in changed] == [(4, hashlib.sha256(b'{"n": 4}').hexdigest())]
    assert sorted((r.path.rsplit("/", 1)[1], r.drift) for r in drifted(first, now).collect()) == [("b.jsonl", "REMOVED"), ("d.jsonl", "CHANGED"), ("e.jsonl", "NEW")]
