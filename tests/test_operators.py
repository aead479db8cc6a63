"""Operators on small inputs with known answers: logs, kernels, models, exact association, guards."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyvane.functions import spectral as sp
from skyvane.operators import association as a
from skyvane.operators import evidence, ml, partitions
from skyvane.operators.bursts import aggregate_bursts, decode_frames
from skyvane.operators.capture import ordered_markers_inside
from skyvane.operators.sessions import session_features
from skyvane.sources import logs, samples


def write(path, text):
    path.write_text(text)
    return str(path)


def test_strict_and_lenient_lines(spark):
    df = spark.createDataFrame([("a=1,b = x=y ,noise,a=2",), ("a=1,=2",), ("a=1,a=2",), ("a=1,b",), ("a=1, b=2",)], "value string")
    got = df.select(logs.lenient_map(F.col("value")).alias("m"), logs.strict_error(F.col("value")).alias("e")).collect()
    assert got[0].m == {"a": "2", "b": "x=y"} and [r.e for r in got] == ["part without =", "empty key", "repeated key", "part without =", None]


def test_burst_log_and_features(spark, tmp_path):
    line = "time=2026-01-01T00:00:0{0},session_id=T1,bearing={1},peak_power=-40,max_confidence=5,doa_width=NA,median_doa_peaks=1,bearing_spread=1,median_confidence=4,single_peak_ratio=1,quality={2},samples=4"
    text = "\n".join(["", "SESSION_START | id=T1 | time=2026-01-01T00:00:00 | source=x", line.format(0, 359, "STABLE"), line.format(1, 1, "STABLE"), line.format(2, -358, "MULTIPATH"), line.format(3, 9, "ODD"), "no session"])
    lines = logs.numbered_lines(spark, write(tmp_path / "b.log", text))
    b = logs.burst_log(lines)
    none = spark.createDataFrame([], "session_id string, event string")
    t = spark.createDataFrame([("T1", "TRACK_ACQUIRED"), ("T1", "TRACK_DEGRADED"), ("T1", "TRACK_VARIABLE")], none.schema)
    r = session_features(b, t, none).collect()[0]
    assert (r.burst_count, r.track_event_count, r.episode_event_count) == (3, 2, 0) and r.stable_ratio == pytest.approx(2 / 3)
    assert (r.bearing_circular_mean_deg < 5 or r.bearing_circular_mean_deg > 355) and r.doa_width_mean_deg is None and r.peak_power_std_db == 0
    marks = logs.markers(lines)
    assert logs.latest_session(marks).first()[0] == "T1" and logs.session_times(marks).first().end_time is None


def test_other_logs(spark, tmp_path):
    act = "capture | x\nclock | monotonic\nA1 | wall=2026-01-01T00:00:00+00:00 | monotonic_ns=10\nA2 | wall=2026-01-01T00:00:01+00:00 | monotonic_ns=9\n"
    got = logs.activation_log(logs.numbered_lines(spark, write(tmp_path / "a.log", act)))
    assert [(r.label, r.monotonic_ns) for r in got.collect()] == [("A1", 10), ("A2", 9)]
    m = ordered_markers_inside(got.withColumn("ordinal", F.col("label")).withColumn("k", F.lit(1)), ["k"], F.lit(0), F.lit(9)).orderBy("label").collect()
    assert [r.errors for r in m] == [["AFTER_FINISH"], ["NOT_MONOTONIC"]]
    h = "f" * 64
    hashes = logs.hash_list(logs.numbered_lines(spark, write(tmp_path / "h", f"{h}  a/b\n{h}  c d\n{h}  a/b\nbad\n"))).collect()
    assert sorted((r.path, r.repeated) for r in hashes) == [("a/b", True), ("a/b", True), ("c d", False)]
    for n in (5, 14, 20):
        (tmp_path / f"TPMS-NATURAL-{n:03d}-x.json").write_text("{")
    assert [p.rsplit("-", 2)[1] for p in logs.numbered_files(spark, str(tmp_path), r"NATURAL-(\d+)-", 15)] == ["005", "014"]
    df = spark.createDataFrame([("s", 433.92, None)], "session_id string, frequency_mhz double, doa_width double")
    assert logs.kv_text(df, ["session_id", "frequency_mhz", "doa_width"]).first()[0] == "session_id=s,frequency_mhz=433.920000,doa_width=NA"
    assert logs.canonical_jsonl(df).first()[0] == '{"doa_width":null,"frequency_mhz":433.92,"session_id":"s"}'
    with pytest.raises(Exception):
        logs.episode_log(spark, write(tmp_path / "e.jsonl", '{"event": "x"}\n{bad\n')).collect()


def test_frames_and_gap_sessions(spark):
    ok = ["0", "12.5", "4", "-30", "433920000"] + ["0"] * 12 + ["1" if i in (0, 180) else "0.2" for i in range(360)]
    rows = [",".join(ok), ",".join(ok[:-1]), ",".join(["0", "x", *ok[2:]]), ""]
    got = decode_frames(spark.createDataFrame([(r,) for r in rows], "value string")).collect()
    assert [(r.bearing, r.width, r.peaks, r.frequency_mhz) for r in got] == [(12.5, 2.0, 2.0, 433.92)]
    f = spark.createDataFrame([("s", t, i, 10.0, -40.0 if i != 3 else -45.0, 4.0, 433.92, 10.0, 1.0) for i, t in enumerate((0.0, 2.999, 5.999, 6.5, 7.0))], "session_id string, t double, event_id int, bearing double, power double, confidence double, frequency_mhz double, width double, peaks double")
    out = aggregate_bursts(f.withColumn("time", F.timestamp_millis((F.col("t") * 1000).cast("bigint")))).orderBy("burst").collect()
    assert [(r.samples, r.quality) for r in out] == [(2, "LOW_QUALITY"), (2, "LOW_QUALITY")]  # a gap of exactly 3 s closes; -45 dB is out


def tone(hz, n=10_923, noise=0.01, seed=0):
    g = np.random.default_rng(seed)
    return np.exp(2j * np.pi * hz * np.arange(n) / sp.RATE) + noise * (g.normal(size=n) + 1j * g.normal(size=n))


def test_kernels_find_a_tone():
    iq = tone(-2300.0)
    assert sp.strongest_offset(iq) == pytest.approx(-2300, abs=3) and sp.spectrum_features(iq)["strongest_hz"] == pytest.approx(-2300, abs=2)
    assert sp.dominant_bins(iq)["dominant"]["median"] == pytest.approx(-2300, abs=13) and sp.instantaneous(iq)["sample"]["median"] == pytest.approx(-2300, abs=5)
    c = sp.fragment_components(iq)
    assert c["usable"] and any(abs(x["frequency_hz"] + 2300) < 3 for x in c["components"])
    assert sp.fragment_components(np.zeros(100, complex))["flags"] == ["ZERO_SPECTRAL_POWER"] and sp.fragment_components(np.array([1j]))["flags"] == ["TOO_SHORT"]
    quiet = np.zeros(2000, complex)
    quiet[100:220] = tone(3000.0, 120, 0)
    quiet[240:243] = 1
    quiet[900:903] = 1
    assert sp.burst_events(quiet) == [(100, 242)]
    assert sp.event_peaks(quiet, 100, 219)[0]["frequency_hz"] == pytest.approx(3000, abs=10)


def test_grid_keeps_power_and_detector_sees_lines():
    f, p = sp.synthetic_spectrum(10_923, 40.0, -5300.0, "exponential", 3, 26.0, 200.0, 6.0)
    assert sp.rebin(f, p).sum() == pytest.approx(p.sum(), rel=1e-11)
    got = [c["frequency_hz"] for c in sp.detect_on(f, p, 10.0) if c["eligible"]]
    assert any(abs(x + 5300) < 10 for x in got) and any(abs(x + 5100) < 10 for x in got)
    flat = np.array([1.0, 3, 3, 1, 2, 2, 5])
    assert sp.flat_maxima(flat).tolist() == [1, 6]


def test_files_are_checked_and_measured(spark, tmp_path):
    (tmp_path / "a.iq").write_bytes(tone(1500.0, 4096).astype("<c16").tobytes())
    (tmp_path / "b.iq").write_bytes(b"123")
    files = samples.sample_files(spark, str(tmp_path))
    sha = hashlib.sha256((tmp_path / "a.iq").read_bytes()).hexdigest()
    assert {r.sha256 for r in samples.receipts(files).collect()} >= {sha}
    manifest = spark.createDataFrame([("a.iq", 65536, sha)], "name string, size_bytes bigint, sha256 string")
    assert {r.name: r.problem for r in samples.checked(files, manifest).collect()} == {"a.iq": None, "b.iq": "NOT_IN_MANIFEST"}
    for k in samples.KERNELS:
        got = {r.name: r for r in samples.measured(files, k).collect()}
        assert got["a.iq"].error is None and got["b.iq"].error
    assert samples.measured(files.where("name = 'a.iq'"), "strongest").first().result.strongest_hz == pytest.approx(1500, abs=7)


def test_passband_tone():
    t = np.arange(sp.CS8_SAMPLES) / sp.CS8_RATE
    raw = np.empty(2 * sp.CS8_SAMPLES, np.int8)
    raw[0::2], raw[1::2] = np.round(40 * np.cos(2 * np.pi * 3e5 * t)), np.round(40 * np.sin(2 * np.pi * 3e5 * t))
    raw[-2:] = -128, 127
    got = sp.passband_tone(raw.tobytes(), 3e5)
    assert got["clipped"] == 2 and abs(got["error_hz"]) < 8 and got["power_db"] == pytest.approx(20 * np.log10(40), abs=0.1)
    with pytest.raises(ValueError):
        sp.passband_tone(b"12", 0.0)


def brute(e, group, margin):
    """All partitions of a group into feasible paths, best linked, within the margin."""
    paths = {}
    for n in range(1, len(group) + 1):
        for p in itertools.combinations(group, n):
            hz = [e.hz[i] for i in p]
            steps = list(zip(p, p[1:], strict=False))
            if max(hz) - min(hz) <= 100 and all(e.fragment[b] - e.fragment[x] in (1, 2) and abs(e.hz[b] - e.hz[x]) <= 50 for x, b in steps):
                paths[p] = sum(((e.hz[b] - e.hz[x]) / 50) ** 2 + 0.25 * (e.fragment[b] - e.fragment[x] == 2) for x, b in steps)
    out = []

    def go(left, chosen, links, cost):
        if not left:
            out.append((links, cost, frozenset(chosen)))
            return
        for p, c in paths.items():
            if p[0] == left[0] and set(p) <= set(left):
                go([i for i in left if i not in p], [*chosen, p], links + len(p) - 1, cost + c)

    go(sorted(group), [], 0, 0.0)
    most = max(x[0] for x in out)
    least = min(c for n, c, _ in out if n == most)
    return most, least, [s for n, c, s in out if n == most and c <= least + margin + 1e-12]


def test_partitions_equal_enumeration():
    rng = random.Random(4)
    for _ in range(40):
        n = rng.randint(2, 7)
        e = a.Episode([f"c{i}" for i in range(n)], [rng.randint(1, 4) for _ in range(n)], [float(rng.randint(0, 6) * 10) for _ in range(n)])
        for g in (g for g in e.groups if len(g) > 1):
            for margin in (0.0, 0.25, 1.0):
                links, cost, sets = brute(e, g, margin)
                p = a.Partitions(e, g, 10**6, 10**7)
                assert p.best()[0] == links and float(p.best()[1]) == pytest.approx(cost)
                m = a.Fraction(margin)
                assert sum(p.histogram(m).values()) == len(sets)
                assert {s for _, s in p.listed(m, 10**6)} == {frozenset(tuple(e.ids[i] for i in q) for q in s) for s in sets}


def test_equal_cost_matching_counts_and_budgets(spark):
    e = a.Episode([f"{s}{i:02d}" for s in "ab" for i in range(8)], [1] * 8 + [2] * 8, [0.0] * 16)
    full = a.solve(e, 2, True, 0.0)
    assert full["state"] == "COMPLETE" and full["hypotheses"] == str(40320) and len(full["possible"]) == 64 and full["invariant"] == []
    cut = a.solve(e, 2, True, 0.0, paths=10)  # listed only up to 2,000 partitions
    assert cut["state"] == "QUERY_UNRESOLVED" and (cut["links"], cut["cost"], cut["hypotheses"]) == (full["links"], full["cost"], "40320") and cut["possible"] is None
    short = a.solve(e, 2, True, 0.0, states=10)
    assert short["state"] == "COMPUTATION_UNRESOLVED" and short["hypotheses"] is None
    comp = spark.createDataFrame([(1, f"c{i}", i, 100.0 + i, True) for i in range(1, 5)] + [(2, "x", 1, 5.0, False)], "episode int, candidate_id string, fragment int, frequency_hz double, eligible boolean")
    frag = spark.createDataFrame([(e, f, e != 3) for e in (1, 2, 3) for f in range(1, 5)], "episode int, fragment int, usable boolean")
    got = {r.episode: r for r in a.track_episodes(comp, frag, ["episode"]).collect()}
    assert {k: r.status for k, r in got.items()} == {1: "UNIQUE_PERSISTENT_TRACK", 2: "NO_ELIGIBLE_COMPONENT", 3: "UNUSABLE_INPUT"}
    assert got[1].primary_track_id == "T001" and got[1].tracks[0].coverage == 1.0
    exact = {r.episode: r for r in partitions.associate(comp, frag, ["episode"], 0.25).collect()}
    assert exact[1].primary == ["c1", "c2", "c3", "c4"] and exact[1].hypotheses == "1" and exact[2].status == "NO_ELIGIBLE_COMPONENT"


def test_models(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.2, (8, 3)) for c in (0, 3, 6)])
    k, labels = ml.choose_clusters(x)
    assert k == 3 and [len(set(labels[i : i + 8])) for i in (0, 8, 16)] == [1, 1, 1] and labels[0] == 0
    assert ml.rand_index(labels, (labels + 1) % 3) == 1.0 and (ml.aligned((labels + 1) % 3, labels) == labels).all()
    pc, load, share = ml.principal_components(x)
    assert share[0] > 0.9 and np.abs(load).max(axis=1).tolist() == load.max(axis=1).tolist() and pc.shape == (24, 2)
    odd = np.concatenate([rng.normal(0, 1, (100, 2)), [[9.0, 9.0]]])
    assert ml.isolation_scores(odd, 100).argmax() == 100
    assert {r[0] for r in ml.ablation(x, labels, {"first": [0], "rest": [1, 2]})} == {"first", "rest"}
    t = ml.perturbation_trials(spark, x, labels, trials=6).collect()
    assert len(t) == 6 and all(r.ari > 0.9 for r in t)
    led = spark.createDataFrame([("a", 1)], "session_id string, v int")
    new = spark.createDataFrame([("a", 2), ("b", 4), ("b", 3)], led.schema)
    assert [tuple(r) for r in ml.append_ledger(led, new).collect()] == [("b", 3)]
    with pytest.raises(ValueError):
        ml.bounded([[0.0]] * (ml.MOST + 1))


def test_json_hashes_and_artifacts(spark):
    assert evidence.canonical({"b": 1, "a": [1.5, None]}) == '{"a":[1.5,null],"b":1}'
    df = spark.createDataFrame([('{"a": 1}',), ('{"a":1,"a":2}',), ('{"a": NaN}',), (None,)], "t string")
    got = [r.d for r in df.select(evidence.json_digest("t").alias("d")).collect()]
    assert got[0].sha256 == hashlib.sha256(b'{"a":1}').hexdigest() and all(r.sha256 is None and r.error for r in got[1:])
    art = evidence.artifact("history", {"n": 1}, {"results/a.json": "00"})
    assert evidence.artifact_problems(art) == []
    assert evidence.artifact_problems(art | {"payload": {"n": 2}}) == ["payload_sha256", "envelope_sha256"]
    assert "path" in evidence.artifact_problems(evidence.artifact("x", {}, {"../up": "1"})) and evidence.artifact_problems({}) == ["fields"]
    nums = spark.createDataFrame([(5,), (6,), (6,)], "number int")
    assert sorted(map(tuple, evidence.prefix_problem(nums, [5, 6, 7, 8], 7).collect())) == [(6, "REPEATED"), (7, "MISSING")]


def test_burst_stream(spark, tmp_path):
    from skyvane.streaming.live import append_once, burst_stream, frame_stream

    (tmp_path / "in").mkdir()
    row = lambda t, b: ",".join([f"2026-01-01T00:00:{t:02d}", str(b), "4", "-30", "433920000"] + ["0"] * 12 + ["1"] + ["0"] * 359)
    (tmp_path / "in/a.csv").write_text("\n".join([row(1, 10), row(2, 12), "broken", row(20, 50)]))
    frames = frame_stream(spark, str(tmp_path / "in")).withColumn("session_id", F.lit("s"))
    run = lambda: burst_stream(frames, ["session_id"]).writeStream.foreachBatch(append_once(str(tmp_path / "out"))).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    run()
    (tmp_path / "in/b.csv").write_text(row(59, 1))
    run()  # a restart goes on where the first run ended
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("time").collect()
    assert [(r.samples, round(r.bearing, 3)) for r in got] == [(2, 11.0), (1, 50.0)]


def test_files_are_not_ok_when_something_is_unknown(spark):
    from skyvane.operators.capture import verify_files

    schema = "path string, size_bytes bigint, sha256 string"
    want = {"a": ("OK", (1, "x"), (1, "x")), "b": ("HASH-FAIL", (1, "x"), (1, None)), "c": ("HASH-FAIL", (1, None), (1, "x")), "d": ("SIZE-FAIL", (None, "x"), (1, "x")), "e": ("SIZE-FAIL", (1, "x"), (None, "x")),
            "f": ("UNKNOWN", (None, "x"), (None, "x")), "g": ("UNKNOWN", (1, None), (1, None)), "h": ("MISSING", (1, "x"), None), "i": ("SIZE-FAIL", (1, "x"), (2, "y"))}
    manifest = spark.createDataFrame([(p, *m) for p, (_, m, _) in want.items()], schema)
    disk = spark.createDataFrame([(p, *d) for p, (_, _, d) in want.items() if d], schema)
    assert {r.path: r.verdict for r in verify_files(manifest, disk).collect()} == {p: v for p, (v, _, _) in want.items()}


def test_spectral_episode_medians(spark):
    from skyvane.operators.rollups import spectral_episodes

    rows = [("e", 0, 1.0, [-3.0, 2.0], [10.0, 20.0, 30.0, 100.0]), ("e", 10**9, 2.0, [5.0], [40.0, None]), ("e", 3 * 10**9, 6.0, [], []), ("f", 0, None, None, None)]
    df = spark.createDataFrame(rows, "ep string, mtime_ns bigint, centroid_hz double, offsets_hz array<double>, spacings_hz array<double>")
    for c in ("spread_hz", "entropy", "occupied_hz"):
        df = df.withColumn(c, F.col("centroid_hz"))
    got = {r.ep: r for r in spectral_episodes(df, ["ep"]).collect()}
    assert (got["e"].fragments, got["e"].centroid_hz, got["e"].nearest_offset_hz, got["e"].spacing_hz, got["e"].gap_s) == (3, 2.0, 3.5, 32.5, 1.5)
    assert got["f"].spacing_hz is None


def test_questions_about_partitions_equal_their_listing():
    from fractions import Fraction

    rng = random.Random(11)
    for _ in range(60):
        n = rng.randint(3, 9)
        e = a.Episode([f"c{i}" for i in range(n)], [rng.randint(0, 4) for _ in range(n)], [float(rng.choice([0, 20, 40, 45, 70, 90, 120])) for _ in range(n)])
        fragments, margin = 5, rng.choice([0.0, 0.25, 1.0])
        m, got = Fraction(margin), a.solve(e, 5, True, margin)
        assert got == a.solve(e, 5, True, margin, listing=0)
        invariant, possible, joint = set(), set(), [(Fraction(0), frozenset())]
        for g in e.groups:
            p = a.Partitions(e, g, 10**6, 10**7)
            sets = p.listed(m, 10**6)
            best = p.best()[1]
            invariant |= frozenset.intersection(*[s for _, s in sets])
            possible |= frozenset.union(*[s for _, s in sets])
            joint = [(c + d - best, h | s) for c, h in joint for d, s in sets if c + d - best <= m + a.TOLERANCE]
            for path in p.paths():
                named = tuple(e.ids[i] for i in path)
                other = p.alternative(m, path)
                without = [s for _, s in sets if named not in s]
                assert (other is None) == (not without) and (other is None or other in without)
        lasting = {x for x in possible if len(x) >= a.SUPPORT and len(x) / fragments >= a.COVERAGE}
        most = max(len(lasting & h) for _, h in joint)
        primary = next(iter(lasting)) if len(lasting) == 1 and lasting <= invariant else None
        status = "UNIQUE_PERSISTENT_TRACK" if primary else "MULTIPLE_PERSISTENT_TRACKS" if most > 1 else "AMBIGUOUS_ASSOCIATION" if len(joint) > 1 else "INSUFFICIENT_SUPPORT"
        assert (got["status"], got["hypotheses"]) == (status, str(len(joint)))
        assert got["invariant"] == sorted(map(list, invariant)) and got["possible"] == sorted(map(list, possible))


def test_ledger_takes_no_row_without_a_key(spark):
    led = spark.createDataFrame([("a", 1)], "session_id string, v int")
    new = spark.createDataFrame([(None, 2), (None, 3), ("b", 4), ("a", 5)], led.schema)
    assert [tuple(r) for r in ml.append_ledger(led, new).collect()] == [("b", 4)]


def test_study_scores_rows_beyond_its_sample(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (150, 3)), rng.normal(9, 1, (150, 3)), [[60.0, -60.0, 60.0]]])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, [0.0] * 3), (999, None)], "id bigint, x array<double>")
    got = {r.id: r for r in ml.study(rows, "id", most=80, trees=40).collect()}
    assert sorted(got) == list(range(301))
    first, second = {got[i].cluster for i in range(150)}, {got[i].cluster for i in range(150, 300)}
    assert len(first) == len(second) == 1 and first != second
    assert got[300].isolation > np.quantile([r.isolation for r in got.values()], 0.9)
    assert ml.study(rows.limit(0), "id").count() == 0 and ml.study(rows.where("id < 2"), "id").count() == 2


def test_episode_log_names_the_place_and_takes_a_missing_file(spark, tmp_path):
    good = '{"version": 1, "session_id": "s", "event": "EPISODE_CLOSED", "episode_id": 3, "summary": {"episode_id": 3, "max_support": 7}}'
    (tmp_path / "a.jsonl").write_text(f"{good}\n\n{good.replace('s', 't', 0)}\n")
    got = logs.episode_log(spark, str(tmp_path / "a.jsonl"), "s").collect()
    assert [(r.episode_id, r.summary.max_support) for r in got] == [(3, 7)] * 2
    assert logs.episode_log(spark, str(tmp_path / "none.jsonl")).collect() == []
    (tmp_path / "b.jsonl").write_text(f"{good}\n{{broken\n")
    with pytest.raises(Exception, match=r"b\.jsonl:2: no episode event"):
        logs.episode_log(spark, str(tmp_path / "b.jsonl")).collect()


def test_centres_that_stand_for_their_surroundings(spark):
    import random

    from skyvane.operators.families import distinct_centres

    def sweep(points, reach):
        left, out = dict(sorted(points)), []
        while left:
            low = min(left)
            near = [c for c in left if c <= low + reach]
            best = max(near, key=lambda c: (left[c], -c))
            out.append((best, left[best]))
            left = {c: s for c, s in left.items() if abs(c - best) > reach}
        return out

    rng = random.Random(8)
    of = {"a": [(0.0, 1.0), (90.0, 5.0), (180.0, 9.0)], "b": [(0.0, 9.0), (90.0, 5.0), (180.0, 9.0), (281.0, 1.0)], "c": [(5.0, 2.0), (5.0, 7.0)]}
    of |= {f"k{i}": [(float(c), float(rng.randint(0, 4))) for c in rng.sample(range(3000), 60)] for i in range(12)}
    rows = [(k, c, s) for k, points in of.items() for c, s in points] + [("d", None, 1.0), ("e", 7.0, None)]
    got = sorted(map(tuple, distinct_centres(spark.createDataFrame(rows, "k string, centre double, support double"), ["k"], 100.0).collect()))
    want = [(k, i, c, s) for k, points in {**of, "c": [(5.0, 7.0)], "e": [(7.0, 0.0)]}.items() for i, (c, s) in enumerate(sorted(sweep(points, 100.0)), 1)]
    assert got == sorted(want) and [r for r in got if r[0] == "a"] == [("a", 1, 90.0, 5.0)]
