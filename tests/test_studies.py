"""Studies, texts, the tail source, strict logs and finalisation on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyvane.functions import spectral as sp
from skyvane.operators import ml, rollups, studies, texts
from skyvane.operators.capture import session_grid
from skyvane.sources import logs
from skyvane.sources.tail import TailReader, register


def test_synthetic_grid_and_rates(spark):
    assert studies.synthetic_specs(spark, 100).count() == 100_800
    some = studies.synthetic_specs(spark, 2).where("samples = 10923 and fwhm_hz = 40 and centre_hz = -5300 and (kind = 'single' or separation_hz = 400)")
    rates = studies.cell_rates(studies.synthetic_results(some, (None, 10.0), (200.0,)))
    got = {(r.representation, r.background, r.contrast_db): r for r in rates.where("kind = 'single'").collect()}
    assert all(r.trials == 2 for r in got.values()) and got["grid_sigma10", "constant", 20.0].recovered_rate == 1.0
    assert rates.where("kind = 'pair' and power_ratio_db = 0 and representation = 'grid_sigma10'").agg(F.min("recovered_rate")).first()[0] == 1.0


def test_matrix_finds_one_lasting_line(spark):
    rows = []
    for i in range(1, 5):
        f, p = sp.synthetic_spectrum(10_923, 40.0, 3000.0 + 5 * i, "constant", i, 20.0)
        rows.append(("E", i, f.tolist(), p.tolist()))
    df = spark.createDataFrame(rows, "episode string, fragment int, f array<double>, p array<double>")
    got = studies.matrix_statuses(df, ["episode"], (None, 0.0), (10.0, 200.0), (None, 0.25)).collect()
    assert len(got) == 8 and all(r.state == "COMPLETE" for r in got)
    assert {r.status for r in got if r.width_hz == 200} == {"UNIQUE_PERSISTENT_TRACK"} and {r.status for r in got if r.width_hz == 10} == {"NO_ELIGIBLE_COMPONENT"}
    f, p = np.array(rows[0][2]), np.array(rows[0][3])
    assert studies.region_share(f, p, []) == 0.0 and 0 < studies.region_share(f, p, [{"eligible": True, "low_hz": -5400.0, "high_hz": -5300.0}]) < 1


def test_rollups(spark):
    f = spark.createDataFrame([(1, 10**9, 1.0, 2.0, 0.5, 9.0, [-3.0, 5.0], [1.0, 4.0]), (1, 3 * 10**9, 3.0, 2.0, 0.5, 9.0, [], [])], "episode int, mtime_ns bigint, centroid_hz double, spread_hz double, entropy double, occupied_hz double, offsets_hz array<double>, spacings_hz array<double>")
    r = rollups.spectral_episodes(f, ["episode"]).first()
    assert (r.fragments, r.centroid_hz, r.nearest_offset_hz, r.spacing_hz, r.gap_s) == (2, 2.0, 3.0, 2.5, 2.0)
    s = spark.createDataFrame([(1, "A"), (2, "B")], "episode int, status string")
    assert [tuple(x) for x in rollups.status_transitions(s, s.where("episode = 1"), ["episode"]).collect()] == [("A", "A", 1)]
    want = spark.createDataFrame([("s1", 1), ("s1", 2)], "s string, k int")
    have = spark.createDataFrame([("s1", 1), ("s1", 1), ("s2", 1)], want.schema)
    assert sorted(map(tuple, session_grid(have, want, ["s", "k"]).collect())) == [("s1", 1, "REPEATED"), ("s1", 2, "MISSING"), ("s2", 1, "UNPLANNED")]


def test_texts():
    summary = {"bursts": 4, "stable": 2, "multipath": 1, "low_quality": 1, "track_acquired": 1, "track_degraded": 0, "track_lost": 0, "track_shift_confirmed": 1, "missing_logs": ["episodes"]}
    found = texts.regime_findings(summary, {"cluster": 1, "nearest": 1.0, "ratio": 1.5, "novelty": "OUTSIDE_OBSERVED_TRAINING_RANGE"})
    assert found["regime"].startswith("coherent") and len(found["warnings"]) == 2 and "2 of 4 bursts STABLE" in found["evidence"]
    assert texts.BOUNDARY in texts.evidence_prompt(found, "What next?")
    assert texts.table([{"a": 1, "b": None}, {"a": 0.5, "b": "x"}]).splitlines()[2:] == ["| 1 | n/a |", "| 0.5000 | x |"] and texts.table([]) == "no rows"
    assert texts.daq_failures({"daq_status": {"frame_sync": True, "sample_delay_sync": True, "iq_sync": True, "adc_overdrive": False}, "daq_ok": True, "daq_num_dropped_frames": 0}) == []
    assert texts.daq_failures({}) == ["frame_sync", "sample_delay_sync", "iq_sync", "adc_overdrive", "daq_ok", "dropped_frames"]
    assert texts.recorder_alive((1, 1), (2, 2)) and not texts.recorder_alive((1, 1), (2, 1))
    r = {"session_id": "A", "active_episode_ids": [3, 10], "event_count": 4, "episodes_started": 3, "episodes_closed": 1, "shift_boundaries": 0, "track_losses": 1, "degraded_closed_episodes": 1}
    assert "active: 3, 10" in texts.episode_text(r)


def test_tail_skips_the_backlog_and_goes_on_after_a_restart(spark, tmp_path):
    path = tmp_path / "live.csv"
    path.write_text("old\n")
    r = TailReader(str(path), backlog=False)
    start = r.initialOffset()
    with path.open("a") as f:
        f.write("one\r\ntwo\npart")
    rows, end = r.read(start)
    assert [x[1] for x in rows] == ["one", "two"] and [x[1] for x in r.readBetweenOffsets(start, end)] == ["one", "two"]
    path.write_text("")  # a file that shrinks gives nothing until it has grown again
    assert r.read(end)[1] == end and TailReader(str(tmp_path / "none"), False).initialOffset() == {"offset": 0}
    path.write_text("old\none\n")
    register(spark)
    q = spark.readStream.format("tail").option("path", str(path)).option("backlog", "true").load().writeStream.format("memory").queryName("tailed").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    with path.open("a") as f:
        f.write("two\n")
    q.processAllAvailable()
    q.stop()
    assert [x.value for x in spark.table("tailed").orderBy("line_offset").collect()] == ["old", "one", "two"]


def test_strict_records_name_the_line(spark, tmp_path):
    good, bad = tmp_path / "a.log", tmp_path / "b.log"
    good.write_text("SESSION_START | id=A\na=1,b=2\n")
    bad.write_text("a=1\n\nb\n")
    assert [r.m for r in logs.strict_records(logs.numbered_lines(spark, str(good))).collect()] == [{"a": "1", "b": "2"}]
    with pytest.raises(Exception, match="b.log: line 3: part without ="):
        logs.strict_records(logs.numbered_lines(spark, str(bad))).collect()
    assert logs.present(spark, [str(good), str(tmp_path / "none")]) == ([str(good)], [str(tmp_path / "none")])


def test_finalise_one_session(spark):
    names = ["u", "v"]
    train = spark.createDataFrame([(f"t{i}", float(i % 3), float(i), i % 2) for i in range(12)], "session_id string, u double, v double, cluster int")
    params = ml.model_params(train, names)
    model = ml.freeze(ml.standardized(train, names, params))
    new = spark.createDataFrame([("n1", 1.0, None), ("n2", 1.0, 2.0)], "session_id string, u double, v double")
    ledger = spark.createDataFrame([("n2",)], "session_id string")
    got = ml.finalize(new, "n1", names, params, model, ledger).collect()
    assert len(got) == 1 and got[0].cluster in (0, 1) and got[0].nearest <= got[0].second
    assert ml.finalize(new, "n2", names, params, model, ledger).count() == 0
    assert [r.session_id for r in ml.repeated_keys(new.unionAll(new.limit(1)), "session_id").collect()] == ["n1"]


def test_nearest_earlier_capture_and_history_by_brute_force(spark):
    import random

    from skyvane.operators.families import capture_delta
    from skyvane.operators.history import history_neighbours

    rng = random.Random(3)
    med = {c: float(rng.randint(0, 12)) for c in rng.sample(range(60), 30)}
    got = {r.capture: r for r in capture_delta(spark.createDataFrame([(c, 1, v) for c, v in med.items()], "capture bigint, episode int, value double")).collect()}
    for c, v in med.items():
        best = min(((abs(v - w), e) for e, w in med.items() if e < c), default=(None, None))
        assert (got[c].absolute, got[c].nearest_capture) == best
    rows = [("k", i // 2, rng.choice([None, 1.0, 2.5, 4.0]), 7.0) for i in range(40)] + [("one", 1, 1.0, 1.0)]
    out = {}
    for r in history_neighbours(spark.createDataFrame(rows, "k string, o int, a double, b double"), ["k"], "o", ["a", "b"]).collect():
        out.setdefault((r.k, r.target), []).append((r["rank"], r.prior, r.distance))
    assert not any(k == "one" for k, _ in out)
    for t in range(1, 20):
        prior = [(o, a) for k, o, a, _ in rows if k == "k" and o < t]
        known = [a for _, a in prior if a is not None]
        sd = float(np.std(known)) if len(set(known)) > 1 else 0.0
        for own in {a for k, o, a, _ in rows if k == "k" and o == t}:
            d = sorted((abs(own - a) / sd if sd and own is not None and a is not None else float("inf"), o) for o, a in prior)[:3]
            mine = out["k", t]
            assert any(x[2] == pytest.approx(d[0][0]) if d[0][0] < float("inf") else x[2] is None for x in mine)


def test_tail_reads_bounded_batches_from_the_last_line_end(tmp_path):
    path = tmp_path / "log.csv"
    path.write_bytes(b"a" * 200_000 + b"\n" + b"b\n" + b"c" * 150_000)
    assert TailReader(str(path), False).initialOffset() == {"offset": 200_003}
    path.write_bytes(b"".join(b"row %d\n" % i for i in range(100)) + b"long " + b"x" * 500 + b"\nend\nopen")
    reader, at, seen, batches = TailReader(str(path), True, most=64), {"offset": 0}, [], 0
    while True:
        rows, after = reader.read(at)
        rows = list(rows)
        if after == at:
            break
        assert list(reader.readBetweenOffsets(at, after)) == rows
        seen, at, batches = seen + [r for _, r in rows], after, batches + 1
    assert seen == [f"row {i}" for i in range(100)] + ["long " + "x" * 500, "end"] and batches > 10
    assert TailReader(str(tmp_path / "none"), False).initialOffset() == {"offset": 0}


def test_canonical_lines_sort_keys_at_every_depth(spark):
    import json

    schema = "b int, a struct<z:int,c:array<struct<y:string,x:int>>,m:map<string,int>>"
    rows = [(1, (2, [("q", None), ("r", 5)], {"k": 1, "a": 2})), (None, None), (3, (None, [], {}))]
    got = [r.value for r in logs.canonical_jsonl(spark.createDataFrame(rows, schema)).collect()]
    assert got[0] == '{"a":{"c":[{"x":null,"y":"q"},{"x":5,"y":"r"}],"m":{"a":2,"k":1},"z":2},"b":1}' and got[1] == '{"a":null,"b":null}'
    assert all(json.dumps(json.loads(x), sort_keys=True, separators=(",", ":")) == x for x in got)


def test_scales_of_early_rows_ignore_what_comes_later(spark):
    from statistics import pstdev

    from skyvane.operators.history import history_neighbours

    values = [50.0, 50.01, 53.7, 50.02, 3e9, 50.03]
    rows = [("k", i, v) for i, v in enumerate(values)]
    got = {(r.target, r.prior): r.distance for r in history_neighbours(spark.createDataFrame(rows, "k string, o int, a double"), ["k"], "o", ["a"], 9).collect()}
    for (i, j), d in got.items():
        scale = pstdev(values[:i])
        assert d is None if scale == 0 else d == pytest.approx(abs(values[i] - values[j]) / scale, rel=1e-9), (i, j)
    assert len(got) == 15
