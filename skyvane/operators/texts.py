"""Text reports of small results, and the rules that word them."""

from __future__ import annotations

# How clusters are described.
REGIMES = {
    0: "variable / multipath-heavy behavioural regime", 1: "coherent behavioural regime", 2: "directionally stable but weaker / broader behavioural regime",
}
BOUNDARY = "Behavioural evidence only: it establishes neither the identity of a transmitter nor a calibrated direction."


def table(rows: list[dict], columns: list[str] | None = None) -> str:
    """Rows as a Markdown table, numbers with four decimals, null as n/a."""
    if not rows:
        return "no rows"
    names = columns or list(rows[0])
    cell = lambda v: "n/a" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(names) + " |", "|" + "-|" * len(names), *("| " + " | ".join(cell(r[n]) for n in names) + " |" for r in rows)])


def episode_text(r: dict) -> str:
    """An episode report of one session."""
    active = ", ".join(map(str, r["active_episode_ids"])) or "none"
    names = {"event_count": "events", "episodes_started": "started", "episodes_closed": "closed", "shift_boundaries": "closed by shift", "track_losses": "closed by loss", "degraded_closed_episodes": "degraded"}
    return "\n".join([f"Session {r['session_id']}", *(f"  {label}: {r[k]}" for k, label in names.items()), f"  active: {active}"])


def regime_findings(summary: dict, score: dict) -> dict:
    """Label, evidence lines and warnings for a scored session."""
    total, inside = summary["bursts"], score["novelty"] == "WITHIN_OBSERVED_TRAINING_RANGE"
    lines = [f"{summary[q]} of {total} bursts {q.upper()}" for q in ("stable", "multipath", "low_quality")]
    lines += [f"{n.removeprefix('track_').replace('_', ' ')}: {summary[n]}" for n in ("track_acquired", "track_degraded", "track_lost", "track_shift_confirmed")]
    lines += [f"nearest distance {score['nearest']:.4f}", f"ratio to the training maximum {score['ratio']:.4f}"]
    warnings = [] if inside else ["outside the observed training distances; read the assignment with care"]
    warnings += [f"missing log: {m}" for m in summary.get("missing_logs") or []]
    return {"cluster": score["cluster"], "regime": REGIMES.get(score["cluster"], "unlabelled behavioural regime"), "evidence": lines, "warnings": warnings, "boundary": BOUNDARY}


def evidence_prompt(findings: dict, question: str) -> str:
    """The text that a caller may hand to a language model: only what was found, and what must not be claimed."""
    return "\n".join([question, "", f"Regime: {findings['regime']} (cluster {findings['cluster']})", *(f"- {x}" for x in findings["evidence"] + findings["warnings"]), "", findings["boundary"]])


def daq_failures(status: dict) -> list[str]:
    """Receiver checks that do not hold."""
    daq = status.get("daq_status") or {}
    want = {"frame_sync": True, "sample_delay_sync": True, "iq_sync": True, "adc_overdrive": False}
    out = [k for k, v in want.items() if daq.get(k) is not v]
    return out + ["daq_ok"] * (status.get("daq_ok") is not True) + ["dropped_frames"] * (status.get("daq_num_dropped_frames") != 0)


def recorder_alive(before: tuple[int, int], after: tuple[int, int]) -> bool:
    """(size, mtime) of a log that is being written: both must have grown."""
    return after[0] > before[0] and after[1] > before[1]
