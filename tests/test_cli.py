import hashlib
import json

from skyvane.cli import main


def test_reports(spark, tmp_path, capsys):
    log = tmp_path / "e.jsonl"
    log.write_text("\n".join(json.dumps({"session_id": "A", "event": e, "episode_id": i, "reason": r, "summary": {"degraded_seen": d}}) for e, i, r, d in (("EPISODE_STARTED", 10, None, None), ("EPISODE_STARTED", 3, None, None), ("EPISODE_STARTED", 1, None, None), ("EPISODE_CLOSED", 1, "TRACK_LOST", True))))
    assert main(["--json", "episode-report", "--log", str(log), "--session", "A"]) == 0
    got = json.loads(capsys.readouterr().out)
    assert got["active_episode_ids"] == [3, 10] and got["track_losses"] == got["degraded_closed_episodes"] == 1
    assert main(["episode-report", "--log", str(log), "--session", "none"]) == 2
    assert main(["episode-report", "--log", str(tmp_path / "absent")]) == 2
    burst = tmp_path / "b.log"
    burst.write_text("\n".join(f"time=2026-01-01T00:0{i}:00,session_id=A,bearing={i},peak_power=-4,max_confidence=5,quality=STABLE,samples=4,frequency_mhz=433.92" for i in range(6)))
    capsys.readouterr()
    assert main(["--json", "session-summary", "--burst-log", str(burst), "--episode-log", str(log)]) == 0
    assert json.loads(capsys.readouterr().out)["bursts"] == 6
    assert main(["--json", "frequency-report", "--burst-log", str(burst), "--session", "A"]) == 0
    assert json.loads(capsys.readouterr().out)["current"] == 6
    assert main(["dataset", "--burst-log", str(burst), "--out", str(tmp_path / "d")]) == 0
    assert spark.read.parquet(str(tmp_path / "d")).first().burst_count == 6
    assert main(["dataset", "--burst-log", str(burst), "--out", str(tmp_path / "d")]) == 2


def test_captures(spark, tmp_path, capsys):
    (tmp_path / "c").mkdir()
    (tmp_path / "c/a.iq").write_bytes(b"\0" * 64)
    sha = hashlib.sha256(b"\0" * 64).hexdigest()
    m = tmp_path / "manifest.json"
    m.write_text(json.dumps({"files": [{"path": "x/a.iq", "size_bytes": 64, "sha256": sha}]}))
    assert main(["verify-capture", "--folder", str(tmp_path / "c"), "--manifest", str(m)]) == 0
    m.write_text(json.dumps({"files": [{"path": "x/a.iq", "size_bytes": 65, "sha256": sha}, {"path": "x/b.iq", "size_bytes": 1, "sha256": sha}]}))
    capsys.readouterr()
    assert main(["verify-capture", "--folder", str(tmp_path / "c"), "--manifest", str(m)]) == 3
    assert "SIZE-FAIL" in (out := capsys.readouterr().out) and "MISSING" in out
    assert main(["--json", "group-episodes", "--folder", str(tmp_path / "c")]) == 0
    assert main(["measure", "--folder", str(tmp_path / "c"), "--kernel", "magnitude", "--out", str(tmp_path / "m")]) == 0
    led = tmp_path / "l.csv"
    led.write_text("block,n,session_id,cluster,a,b,c,d,e\nA,5,s5,2,1,2,3,1,W\nA,6,s6,1,1,2,3,1,W\nB,8,s8,1,1,2,3,1,W\n")
    capsys.readouterr()
    assert main(["--json", "transitions", "--ledger", str(led)]) == 0
    rows = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert sorted((r["from_cluster"], r["to_cluster"], r["n"]) for r in rows) == [(1, 1, 1), (2, 1, 1)]
