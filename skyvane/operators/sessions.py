"""Session-grain features, summaries and episode reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyvane.functions.circular import circular_mean, circular_std_dataset
from skyvane.functions.stats import sample_std
from skyvane.sources.observations import TRACK_EVENTS

QUALITIES = ["STABLE", "MULTIPATH", "LOW_QUALITY"]


def count_if(c: Column) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False)))


def counts_by_session(ev: DataFrame, names: list[str], labels: list[str], total: str) -> DataFrame:
    """One row per session: how many of all, and of each name."""
    return ev.groupBy("session_id").agg(F.count("*").alias(total), *[count_if(F.col("event") == n).alias(lab) for n, lab in zip(names, labels, strict=True)])


def session_features(bursts: DataFrame, track: DataFrame, episodes: DataFrame, min_bursts: int = 1) -> DataFrame:
    """Metadata and 29 features per session with at least ``min_bursts`` bursts of a known quality.

    Missing logs count as 0 events; missing numbers leave means null. Each log is aggregated to sessions before the
    joins, so only session rows are shuffled for them.
    """
    b = bursts.where(F.col("session_id").isNotNull() & F.col("quality").isin(QUALITIES))
    n = F.count("*")
    per = b.groupBy("session_id").agg(
        F.min("time").alias("start_time"), F.max("time").alias("end_time"), ((F.max(F.unix_micros("time")) - F.min(F.unix_micros("time"))) / 1e6).alias("duration_s"),
        n.alias("burst_count"), *[count_if(F.col("quality") == q).alias(f"{q.lower()}_count") for q in QUALITIES],
        *[(count_if(F.col("quality") == q) / n).alias(f"{q.lower()}_ratio") for q in QUALITIES],
        circular_mean("bearing").alias("bearing_circular_mean_deg"), circular_std_dataset("bearing").alias("bearing_circular_std_deg"),
        F.avg("peak_power").alias("peak_power_mean_db"), sample_std("peak_power").alias("peak_power_std_db"), F.avg("max_confidence").alias("max_confidence_mean"),
        F.avg("median_confidence").alias("median_confidence_mean"), F.avg("doa_width").alias("doa_width_mean_deg"), sample_std("doa_width").alias("doa_width_std_deg"),
        F.avg("median_doa_peaks").alias("median_doa_peaks_mean"), F.avg("bearing_spread").alias("bearing_spread_mean_deg"),
        F.avg("single_peak_ratio").alias("single_peak_ratio_mean"), F.avg("samples").alias("samples_mean"),
    ).where(F.col("burst_count") >= min_bursts)
    labels = [f"{n.lower()}_count" for n in TRACK_EVENTS]
    t = counts_by_session(track.where(F.col("event").isin(TRACK_EVENTS)), TRACK_EVENTS, labels, "track_event_count")
    e = counts_by_session(episodes, ["EPISODE_STARTED", "EPISODE_CLOSED"], ["episode_started_count", "episode_closed_count"], "episode_event_count")
    out = per.join(t, "session_id", "left").join(e, "session_id", "left")
    zero = ["track_event_count", *labels, "episode_event_count", "episode_started_count", "episode_closed_count"]
    return out.select(*per.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in zero])


def episode_report(episodes: DataFrame) -> DataFrame:
    """Per session: events, started, closed, ids still active (ascending), and why episodes closed."""
    ids = lambda name: F.collect_set(F.when(F.col("event") == name, F.col("episode_id")))
    closed = F.col("event") == "EPISODE_CLOSED"
    return episodes.groupBy("session_id").agg(
        F.count("*").alias("event_count"), count_if(F.col("event") == "EPISODE_STARTED").alias("episodes_started"), count_if(closed).alias("episodes_closed"),
        F.array_sort(F.array_except(ids("EPISODE_STARTED"), ids("EPISODE_CLOSED"))).alias("active_episode_ids"),
        count_if(closed & (F.col("reason") == "SHIFT_CONFIRMED")).alias("shift_boundaries"), count_if(closed & (F.col("reason") == "TRACK_LOST")).alias("track_losses"),
        count_if(closed & F.col("summary.degraded_seen")).alias("degraded_closed_episodes"),
    )


def session_summary(bursts: DataFrame, track: DataFrame, episodes: DataFrame) -> DataFrame:
    """Per session met in any log: bursts by quality, the counted track events and the episode report, absent ones 0."""
    b = bursts.where(F.col("session_id").isNotNull()).groupBy("session_id").agg(F.count("*").alias("bursts"), *[count_if(F.col("quality") == q).alias(q.lower()) for q in QUALITIES])
    t = track.groupBy("session_id").agg(*[count_if(F.col("event") == n).alias(n.lower()) for n in TRACK_EVENTS])
    out = b.join(t, "session_id", "full").join(episode_report(episodes), "session_id", "full")
    return out.select("session_id", *[(F.coalesce(c, F.array().cast("array<int>")) if c == "active_episode_ids" else F.coalesce(c, F.lit(0))).alias(c) for c in out.columns if c != "session_id"])


def unmatched_sessions(records: DataFrame, markers: DataFrame) -> DataFrame:
    """Session ids that occur in records but not among the markers, with their rows."""
    return records.where(F.col("session_id").isNotNull()).groupBy("session_id").agg(F.count("*").alias("records")).join(markers.select("session_id").distinct(), "session_id", "left_anti")
