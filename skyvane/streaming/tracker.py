"""Track and source-episode state machines: one pure step, run in batch and in streams.

Batch orders each session and passes its rows through the step while they stream by, so memory is one state a session.
Streams keep the same state as one JSON text per session, with the bursts that the watermark has not passed yet.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

# Window lengths, distances and counts of the state machine.
WINDOW, PENDING = 5, 7
SHIFT_DEG, JOIN_DEG, STABLE_DEG, SHIFTING_DEG = 20.0, 12.0, 5.0, 12.0
MATURE = 20


def apart(a: float, b: float) -> float:
    return abs((a - b + 180) % 360 - 180)


def mean_of(b: list[float]) -> float:
    s, c = (sum(f(math.radians(x)) for x in b) / len(b) for f in (math.sin, math.cos))
    return math.degrees(math.atan2(s, c)) % 360


def spread_of(b: list[float]) -> float:
    s, c = (sum(f(math.radians(x)) for x in b) / len(b) for f in (math.sin, math.cos))
    return math.degrees(math.sqrt(-2 * math.log(min(1.0, max(math.hypot(s, c), 1e-12)))))


@dataclass
class State:
    """Everything of a session that later observations depend on."""

    index: int = 0
    window: list[float] = field(default_factory=list)
    pending: list[float] = field(default_factory=list)
    previous: str = "INSUFFICIENT_DATA"
    health: str = "BUILDING"
    stable_mean: float | None = None
    support: int = 0
    rejected: int = 0
    age_start: float | None = None
    last_episode: int = 0
    active: dict | None = None

    def dumps(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def loads(text: str) -> State:
        return State(**json.loads(text))


def health_of(support: int, rejected: int) -> str:
    degrade, lost = (5, 8) if support >= MATURE else (3, 5)
    return "BUILDING" if support < WINDOW else "LOST" if rejected >= lost else "DEGRADED" if rejected >= degrade else "HEALTHY"


def observe(s: State, bearing: float | None, quality: str) -> dict:
    """Move the track on by one observation; what it reports."""
    required = 7 if s.support >= MATURE else 5
    candidate, count, supported, confirmed = "NONE", len(s.pending), False, False
    if quality == "STABLE":
        established = s.stable_mean is not None and len(s.window) == WINDOW
        if not established or apart(bearing, s.stable_mean) < SHIFT_DEG:
            s.window = [*s.window, bearing][-WINDOW:]
            s.pending, count, supported = [], 0, True
        else:
            if s.pending and apart(bearing, mean_of(s.pending)) > JOIN_DEG:
                s.pending = []
            s.pending = [*s.pending, bearing][-PENDING:]
            candidate, count = "PENDING", len(s.pending)
            if count >= required and spread_of(s.pending) <= STABLE_DEG:
                candidate, confirmed, supported = "CONFIRMED", True, True
                s.window, s.pending = s.pending[-WINDOW:], []
    if len(s.window) < WINDOW:
        state, mean, spread = "INSUFFICIENT_DATA", None, None
    else:
        mean, spread = mean_of(s.window), spread_of(s.window)
        state = "TRACK_STABLE" if spread <= STABLE_DEG else "TRACK_SHIFTING" if spread >= SHIFTING_DEG else "TRACK_VARIABLE"
    s.rejected = 0 if quality == "STABLE" else s.rejected + 1
    if state == "TRACK_STABLE":
        s.support = WINDOW if confirmed or s.previous != "TRACK_STABLE" else s.support + supported
    elif state != "INSUFFICIENT_DATA":
        s.support = 0
    health = health_of(s.support, s.rejected)
    return {
        "track_state": state, "track_mean": mean, "track_spread": spread, "support": s.support, "rejected": s.rejected, "health": health,
        "maturity": "MATURE" if s.support >= MATURE else "ESTABLISHED" if s.support >= WINDOW else "BUILDING", "candidate": candidate, "candidate_count": count, "required": required,
    }


def derived_events(s: State, r: dict) -> tuple[str | None, str | None]:
    """The track event and the health event between the previous state and this result."""
    state, event = r["track_state"], None
    if r["candidate"] == "CONFIRMED":
        event = "TRACK_SHIFT_CONFIRMED"
    elif state != s.previous:
        if state == "TRACK_STABLE":
            event = "TRACK_ACQUIRED" if s.stable_mean is None else "TRACK_REACQUIRED"
        elif state == "TRACK_SHIFTING":
            event = "TRACK_SHIFT_DETECTED" if s.stable_mean is not None else None
        elif state == "TRACK_VARIABLE":
            event = "TRACK_VARIABLE"
    health = None
    if r["health"] != s.health:
        health = {"DEGRADED": "TRACK_DEGRADED", "LOST": "TRACK_LOST"}.get(r["health"], "TRACK_RECOVERED" if r["health"] == "HEALTHY" and s.health in ("DEGRADED", "LOST") else None)
    return event, health


def follow_episode(s: State, r: dict) -> list[dict]:
    """Open, continue or close the source episode; closed ones and new ones as events."""
    out: list[dict] = []
    established = r["track_state"] == "TRACK_STABLE" and r["track_mean"] is not None and r["support"] >= WINDOW and r["health"] != "LOST"

    def close(at: int, reason: str) -> None:
        out.append({"event": "EPISODE_CLOSED", "reason": reason, **s.active, "end_index": at})
        s.active = None

    def begin() -> None:
        s.last_episode += 1
        s.active = {"episode_id": s.last_episode, "start_index": s.index, "start_mean": r["track_mean"], "latest_mean": r["track_mean"], "max_support": r["support"], "degraded_seen": r["health"] == "DEGRADED"}
        out.append({"event": "EPISODE_STARTED", "reason": None, **s.active, "end_index": None})

    if r["candidate"] == "CONFIRMED":
        if s.active:
            close(s.index - 1, "SHIFT_CONFIRMED")
        if established:
            begin()
    elif r["health"] == "LOST":
        if s.active:
            close(s.index, "TRACK_LOST")
    elif s.active is None:
        if established:
            begin()
    else:
        if r["track_state"] == "TRACK_STABLE":
            s.active["latest_mean"] = r["track_mean"]
        s.active["max_support"] = max(s.active["max_support"], r["support"])
        s.active["degraded_seen"] = s.active["degraded_seen"] or r["health"] == "DEGRADED"
    return out


def step(s: State, bearing: float | None, quality: str, at_s: float | None = None) -> dict:
    """One observation: the track result, its events, the track's age and the episode events. Changes s.

    A null bearing counts as a rejected observation, like any quality but STABLE.
    """
    s.index += 1
    r = observe(s, bearing, quality if bearing is not None else "NO_BEARING")
    r["track_event"], r["health_event"] = derived_events(s, r)
    if at_s is not None:
        if r["candidate"] == "CONFIRMED" or r["track_state"] == "TRACK_STABLE" and s.age_start is None:
            s.age_start = at_s
        elif r["track_state"] in ("TRACK_SHIFTING", "TRACK_VARIABLE"):
            s.age_start = None
    r["age_s"] = at_s - s.age_start if at_s is not None and s.age_start is not None else None
    r["episodes"] = follow_episode(s, r)
    r["observation_index"] = s.index
    s.previous, s.health = r["track_state"], r["health"]
    if r["track_state"] == "TRACK_STABLE":
        s.stable_mean = r["track_mean"]
    if r["health"] == "LOST":  # the last stable mean and the health stay
        s.window, s.pending, s.support, s.rejected, s.previous, s.age_start = [], [], 0, 0, "INSUFFICIENT_DATA", None
    return r


EPISODE_TYPE = pa.struct([("event", pa.string()), ("reason", pa.string()), ("episode_id", pa.int32()), ("start_index", pa.int64()), ("end_index", pa.int64()), ("start_mean", pa.float64()), ("latest_mean", pa.float64()), ("max_support", pa.int32()), ("degraded_seen", pa.bool_())])
FIELDS: dict[str, tuple[pa.DataType, str]] = {
    "observation_index": (pa.int64(), "bigint"), "track_state": (pa.string(), "string"), "track_mean": (pa.float64(), "double"), "track_spread": (pa.float64(), "double"), "support": (pa.int32(), "int"),
    "rejected": (pa.int32(), "int"), "health": (pa.string(), "string"), "maturity": (pa.string(), "string"), "candidate": (pa.string(), "string"), "candidate_count": (pa.int32(), "int"), "required": (pa.int32(), "int"),
    "track_event": (pa.string(), "string"), "health_event": (pa.string(), "string"), "age_s": (pa.float64(), "double"),
    "episodes": (pa.list_(EPISODE_TYPE), "array<struct<event:string,reason:string,episode_id:int,start_index:bigint,end_index:bigint,start_mean:double,latest_mean:double,max_support:int,degraded_seen:boolean>>"),
}


def track(bursts: DataFrame, key: str = "session_id", time: str = "time", tie: str = "event_id") -> DataFrame:
    """bursts' key, time and tie with the step's result after each row, sessions in order of time and tie.

    One shuffle by session and one sort; a session is followed while its rows stream by.
    """
    src = bursts.select(key, time, tie, "bearing", "quality", (F.unix_micros(time) / 1e6).alias("__at"))
    parts = int(bursts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = src.repartition(parts, key).sortWithinPartitions(key, time, tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), State()
        for b in batches:
            out: dict[str, list] = {n: [] for n in FIELDS}
            for k, bearing, quality, at in zip(*(b.column(i).to_pylist() for i in (0, 3, 4, 5)), strict=True):
                if k != now:
                    now, state = k, State()
                r = step(state, bearing, quality, at)
                for n in FIELDS:
                    out[n].append(r[n])
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(3)] + [pa.array(out[n], t) for n, (t, _) in FIELDS.items()], names=[key, time, tie, *FIELDS])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in src.select(key, time, tie).schema] + [f"{n} {t}" for n, (_, t) in FIELDS.items()])
    return ordered.mapInArrow(run, schema)


def episode_events(tracked: DataFrame, key: str = "session_id") -> DataFrame:
    """A row per episode event, closed episodes' means rounded to one decimal."""
    e = tracked.select(key, "observation_index", F.explode("episodes").alias("e"))
    mean = lambda c: F.when(F.col("e.event") == "EPISODE_CLOSED", F.bround(f"e.{c}", 1)).otherwise(F.col(f"e.{c}")).alias(c)
    return e.select(key, "observation_index", "e.event", "e.episode_id", "e.reason", "e.start_index", "e.end_index", mean("start_mean"), mean("latest_mean"), "e.max_support", "e.degraded_seen")


STREAMED = ["observation_index", "track_state", "track_mean", "support", "health", "candidate", "candidate_count", "track_event", "health_event", "age_s", "episodes"]


class Follower(StatefulProcessor):
    """Follows one session's track. Bursts wait in the state until the watermark has passed them and are then taken in
    order of time and tie, so batches may overlap in time; a session that is silent for ``idle_ms`` gives up its state.

    State: the track as text, the waiting bursts, and the time of the newest one.
    """

    def __init__(self, key: str, time: str, tie: str, idle_ms: int):
        self.key, self.time, self.tie, self.idle_ms = key, time, tie, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("track", "text string")
        self.waiting = handle.getListState("waiting", "at_us bigint, tie bigint, bearing double, quality string")
        self.newest = handle.getValueState("newest", "at_us bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new, mark = [], timerValues.getCurrentWatermarkInMs() * 1000
        for frame in rows:
            at = frame[self.time].astype("datetime64[us]").astype("int64")
            for t, n, bearing, quality in zip(at, frame[self.tie], frame["bearing"], frame["quality"], strict=True):
                if t >= mark:
                    new.append((int(t), int(n), None if pd.isna(bearing) else float(bearing), quality))
        if new:
            self.waiting.appendList(new)
            newest = max(t for t, *_ in new)
            if not self.newest.exists() or self.newest.get()[0] < newest:
                self.newest.update((newest,))
            due = max(mark // 1000, min(t for t, *_ in new) // 1000) + 1
            self.handle.registerTimer(due)
            self.handle.registerTimer(newest // 1000 + self.idle_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        ready, later = [r for r in rows if r[0] < mark], [r for r in rows if r[0] >= mark]
        state = State.loads(self.held.get()[0]) if self.held.exists() else State()
        out = [(t, n, step(state, bearing, quality, t / 1e6)) for t, n, bearing, quality in ready]
        if ready:
            self.held.update((state.dumps(),))
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(max(mark // 1000, later[0][0] // 1000) + 1)
        else:
            self.waiting.clear()
            if self.newest.exists() and self.newest.get()[0] + self.idle_ms * 1000 <= mark:
                self.held.clear()
                self.newest.clear()
        if out:
            yield self.frame(key, out)

    def frame(self, key: tuple, out: list) -> pd.DataFrame:
        cols = {self.key: [key[0]] * len(out), self.time: pd.to_datetime([t for t, _, _ in out], unit="us"), self.tie: [n for _, n, _ in out]}
        cols |= {n: pd.Series([r[n] for _, _, r in out], dtype=object) for n in STREAMED}
        return pd.DataFrame(cols)

    def close(self) -> None:
        pass


def track_stream(bursts: DataFrame, key: str = "session_id", time: str = "time", tie: str = "event_id", delay: str = "10 seconds", idle_ms: int = 3_600_000) -> DataFrame:
    """The same over a stream of bursts, with track age and episode events.

    A burst's result comes when the watermark (the newest burst less ``delay``) has passed it; bursts older than the
    watermark are dropped. Sessions that are silent for ``idle_ms`` of event time end. Needs the RocksDB state store.
    """
    kinds = {f.name: f.dataType.simpleString() for f in bursts.schema}
    schema = f"`{key}` {kinds[key]}, `{time}` {kinds[time]}, `{tie}` bigint, " + ", ".join(f"{n} {FIELDS[n][1]}" for n in STREAMED)
    src = bursts.select(key, time, F.col(tie).cast("bigint").alias(tie), "bearing", "quality").withWatermark(time, delay)
    return src.groupBy(key).transformWithStateInPandas(Follower(key, time, tie, idle_ms), schema, "Append", "EventTime")
