"""Work that must not grow faster than the input, seen in plans and partitions, with the same results."""

import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from skyvane.operators import association, families, report
from skyvane.operators.bursts import decode_frames
from skyvane.sources import logs
from skyvane.sources.observations import spread


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_frames_are_split_once(spark):
    bins = ["0"] * 360
    bins[7], bins[8], bins[200] = "10", "6", "5"
    line = ",".join(["t", "12", "5", "-3", "433920000", *["0"] * 12, *bins])
    df = decode_frames(spark.createDataFrame([(1, line), (2, line + ",1"), (3, line.replace(",6,", ",x,"))], "id int, value string").repartition(2), keep=["id"])
    assert [(r.id, r.width, r.peaks) for r in df.select("id", "width", "peaks").collect()] == [(1, 3.0, 2.0)]
    assert plan(df).count("split(value") == 1


def test_log_lines_are_read_once(spark):
    lines = spark.createDataFrame([("session_id=S1,quality=ODD,bearing=-90,samples=3,quality=STABLE,bearing=-80,samples=x",)], "value string").repartition(2)
    for drop, want in ((False, [(280.0, None)]), (True, [])):
        df = logs.burst_log(lines, drop_bad=drop)
        assert [(r.bearing, r.samples) for r in df.collect()] == want
        assert plan(df).count("split(value") == 1


def test_widest_centroids_by_degrees(spark):
    rng = random.Random(4)
    of = {1: [rng.uniform(0, 360) for _ in range(60)], 2: [10.0, 10.0], 3: [359.5, 0.25, 3.0], 4: [77.0], 5: [0.0, 180.0], 6: [120.5, 120.25, 300.9]}
    rows = [(f"S{i}", float(f), b) for f, bs in of.items() for i, b in enumerate(bs) for _ in range(5)]
    df = report.recurrence(spark.createDataFrame(rows, "session_id string, frequency_mhz double, bearing double"))
    got = {r.frequency_hz // 1_000_000: r.max_centroid_shift for r in df.collect()}
    apart = lambda a, b: 180 - abs(180 - abs(a - b))
    want = {f: max(apart(a, b) for a in bs for b in bs) if len(bs) > 1 else None for f, bs in of.items()}
    assert {f: v if v is None else round(v, 9) for f, v in got.items()} == {f: v if v is None else round(v, 9) for f, v in want.items()}
    assert "unboundedfollowing" not in plan(df)


def test_tasks_grow_with_rows(spark):
    assert [spread(spark.range(n), 100).rdd.getNumPartitions() for n in (10, 1000, 2001)] == [max(spark.sparkContext.defaultParallelism, k) for k in (1, 10, 21)]


def test_spacings_meet_centres_as_counts(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["S1", "S2"]), rng.randrange(3), rng.choice([*range(40), None]), float(rng.randrange(0, 60))) for _ in range(600)]
    df = families.recurrence(spark.createDataFrame(rows, "sensor string, capture int, event int, spacing_hz double"), 5.0)
    want = defaultdict(set)
    for s, c, e, d in rows:
        for centre in {r[3] for r in rows}:
            if e is not None and abs(d - centre) <= 5:
                want[s, c, centre].add(e)
    assert {(r.sensor, r.capture, r.centre): r.hits for r in df.collect()} == {k: len(v) for k, v in want.items()}
    assert "distinct spacing" not in plan(df) and plan(df).count("count(distinct event") == 1  # of captures only


def test_medians_of_tracks():
    rng = random.Random(2)
    for n in range(1, 9):
        x = [rng.uniform(-3, 3) for _ in range(n)]
        assert association.middle(x) == float(np.median(x))
