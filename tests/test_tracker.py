import json
import time

from pyspark.sql import functions as F

from skyvane.sources.observations import bursts
from skyvane.streaming.tracker import State, episode_events, step, track, track_stream

# 26 recorded observations, bearing in degrees and quality, in order.
OBSERVED = [
    (282.3, "STABLE"), (287.8, "MULTIPATH"), (288.0, "MULTIPATH"), (290.0, "MULTIPATH"), (287.0, "STABLE"), (286.3, "STABLE"), (286.3, "STABLE"), (288.0, "STABLE"), (288.0, "MULTIPATH"),
    (290.3, "MULTIPATH"), (288.0, "MULTIPATH"), (169.9, "MULTIPATH"), (145.3, "STABLE"), (144.3, "STABLE"), (144.0, "STABLE"), (143.0, "STABLE"), (143.2, "STABLE"), (146.0, "STABLE"),
    (136.3, "MULTIPATH"), (131.0, "MULTIPATH"), (142.0, "MULTIPATH"), (148.0, "STABLE"), (151.0, "STABLE"), (155.7, "STABLE"), (159.0, "STABLE"), (147.3, "LOW_QUALITY"),
]


def replay(rows):
    s, out = State(), []
    for b, q in rows:
        s = State.loads(s.dumps())  # a restart between any two observations changes nothing
        out.append(step(s, b, q))
    return out


def test_recorded_observations():
    got = replay(OBSERVED)
    assert [i for i, r in enumerate(got, 1) if r["candidate"] == "CONFIRMED"] == [17]
    assert [r["candidate_count"] for r in got if r["candidate"] == "PENDING"] == [1, 2, 3, 4] and got[16]["candidate_count"] == got[16]["required"] == 5
    e = [x for r in got for x in r["episodes"]]
    assert [(x["event"], x["episode_id"]) for x in e] == [("EPISODE_STARTED", 1), ("EPISODE_CLOSED", 1), ("EPISODE_STARTED", 2)]
    assert (e[1]["start_index"], e[1]["end_index"], e[1]["reason"], round(e[1]["start_mean"])) == (8, 16, "SHIFT_CONFIRMED", 286)
    assert e[2]["start_index"] == 17 and round(e[2]["start_mean"]) == 144


def test_loss_closes_the_episode_and_keeps_the_mean():
    got = replay([(b, "STABLE") for b in (100.0, 100.5, 99.5, 100.2, 99.8)] + [(100.0, "MULTIPATH")] * 5 + [(100.0, "STABLE")] * 5 + [(None, "STABLE")])
    assert got[9]["health"] == "LOST" and got[9]["health_event"] == "TRACK_LOST" and got[7]["health_event"] == "TRACK_DEGRADED"
    close = got[9]["episodes"][0]
    assert (close["end_index"], close["reason"]) == (10, "TRACK_LOST")
    assert got[4]["track_event"] == "TRACK_ACQUIRED" and got[14]["track_event"] == "TRACK_REACQUIRED" and got[14]["episodes"][0]["episode_id"] == 2
    assert got[15]["rejected"] == 1


def test_batch_equals_the_step_and_the_stream(spark, small, tmp_path):
    b = bursts(spark, small).select("session_id", "time", "event_id", "bearing", "quality")
    out = track(b)
    got = {(r.session_id, r.event_id): r for r in out.collect()}
    by = {}
    for r in b.orderBy("session_id", "time", "event_id").collect():
        by.setdefault(r.session_id, []).append(r)
    for k, rows in by.items():
        s = State()
        for r in rows:
            want = step(s, r.bearing, r.quality, r.time.timestamp())
            mine = got[k, r.event_id]
            assert (mine.track_state, mine.support, mine.health, mine.candidate_count, mine.track_event) == tuple(want[n] for n in ("track_state", "support", "health", "candidate_count", "track_event"))
    assert episode_events(out).where("event = 'EPISODE_CLOSED'").count() == sum(x["event"] == "EPISODE_CLOSED" for r in got.values() for x in map(lambda e: e.asDict(), r.episodes))
    # Four files, out of order inside the watermark's delay, and a last burst that lets the watermark pass all others.
    ordered = b.withColumn("n", F.expr("row_number() over (order by time, event_id)"))
    span = ordered.agg(((F.max(F.unix_micros("time")) - F.min(F.unix_micros("time"))) / 1e6).cast("int")).first()[0]
    n = ordered.count()
    for i in range(4):
        mine = F.least(F.floor((F.col("n") - 1 + F.col("n") % 3 * (n // 20)) * 4 / n), F.lit(3))
        ordered.where(mine == i).drop("n").orderBy(F.desc("event_id")).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
        time.sleep(1.1)  # files are read in order of their times
    end = b.agg(F.max("time").alias("time")).select(F.lit("~end").alias("session_id"), F.expr("time + interval 30 days").alias("time"), F.lit(-1).cast(b.schema["event_id"].dataType).alias("event_id"), F.lit(1.0).alias("bearing"), F.lit("STABLE").alias("quality"))
    end.write.parquet(str(tmp_path / "in" / "p4"))
    time.sleep(1.1)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(b.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))

    def run():
        q = track_stream(stream, delay=f"{span // 4} seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    # A restart goes on from the state; a burst older than the watermark is dropped.
    b.limit(1).withColumn("event_id", F.lit(-2).cast(b.schema["event_id"].dataType)).coalesce(1).write.parquet(str(tmp_path / "in" / "p5"))
    run()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    seen = {(r.session_id, r.event_id): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert seen.keys() == got.keys()
    for k, r in seen.items():
        assert (r.track_state, r.support, r.health, r.candidate, r.observation_index, r.age_s) == (got[k].track_state, got[k].support, got[k].health, got[k].candidate, got[k].observation_index, got[k].age_s)
        assert [e.asDict() for e in r.episodes] == [e.asDict() for e in got[k].episodes]


def test_state_is_plain_json():
    s = State()
    step(s, 10.0, "STABLE", 5.0)
    assert json.loads(s.dumps())["window"] == [10.0]
