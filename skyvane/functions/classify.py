"""Row classifiers as CASE expressions. Order and strictness of the comparisons are part of each rule."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .circular import col

# Thresholds of burst quality, tracking and reporting.
POWER_GATE_DB = -45.0
TRACK_WINDOW, SPREAD_STABLE, SPREAD_SHIFTING = 5, 5.0, 12.0
SUPPORT_ESTABLISHED, SUPPORT_MATURE = 5, 20
CONFIRM, CONFIRM_MATURE = 5, 7


def burst_quality(samples: Column | str, spread: Column | str, confidence: Column | str, width: Column | str, single: Column | str) -> Column:
    n, s, c, w, r = map(col, (samples, spread, confidence, width, single))
    return (
        F.when((s >= 12.0) | (w >= 80.0) | (r < 0.75), "MULTIPATH")
        .when((n >= 3) & (s <= 7.0) & (c >= 3.5) & (w <= 70.0) & (r >= 0.75), "STABLE")
        .otherwise("LOW_QUALITY")
    )


def track_state(count: Column | str, spread: Column | str) -> Column:
    return F.when(col(count) < TRACK_WINDOW, "INSUFFICIENT_DATA").when(col(spread) <= SPREAD_STABLE, "TRACK_STABLE").when(col(spread) >= SPREAD_SHIFTING, "TRACK_SHIFTING").otherwise("TRACK_VARIABLE")


def maturity(support: Column | str) -> Column:
    return F.when(col(support) >= SUPPORT_MATURE, "MATURE").when(col(support) >= SUPPORT_ESTABLISHED, "ESTABLISHED").otherwise("BUILDING")


def reject_limits(support: Column | str) -> Column:
    """Rejected observations in a row until a track is degraded, and until it is lost."""
    mature = col(support) >= SUPPORT_MATURE
    return F.struct(F.when(mature, 5).otherwise(3).alias("degrade"), F.when(mature, 8).otherwise(5).alias("lost"))


def track_health(support: Column | str, streak: Column | str) -> Column:
    limit = reject_limits(support)
    return F.when(col(support) < SUPPORT_ESTABLISHED, "BUILDING").when(col(streak) >= limit["lost"], "LOST").when(col(streak) >= limit["degrade"], "DEGRADED").otherwise("HEALTHY")


def shift_required(support: Column | str) -> Column:
    return F.when(col(support) >= SUPPORT_MATURE, CONFIRM_MATURE).otherwise(CONFIRM)


def shift_confirmed(count: Column | str, required: Column | str, spread: Column | str) -> Column:
    return (col(count) >= col(required)) & (col(spread) <= SPREAD_STABLE)


def qualified(confidence: Column | str = "max_confidence", samples: Column | str = "samples") -> Column:
    return (col(confidence) >= 3.0) & (col(samples) >= 3)


def persistence(count: Column | str) -> Column:
    return F.when(col(count) == 1, "ISOLATED").when(col(count) <= 4, "SPARSE").when(col(count) <= 19, "REPEATED").otherwise("PERSISTENT")


def directional_class(count: Column | str, r: Column | str) -> Column:
    return F.when(col(count) < 5, "INSUFFICIENT DATA").when(col(r) < 0.25, "DIFFUSE").when(col(r) < 0.5, "WEAKLY CLUSTERED").when(col(r) < 0.75, "CLUSTERED").otherwise("TIGHTLY CLUSTERED")


def candidate_quality(persist: Column | str, direction: Column | str, shift: Column | str) -> Column:
    p, d = col(persist), col(direction)
    tight = d.isin("CLUSTERED", "TIGHTLY CLUSTERED")
    return (
        F.when((p == "PERSISTENT") & tight & (col(shift) >= 30.0), "STRONG TEMPORAL CANDIDATE — EVOLVING DoA")
        .when((p == "PERSISTENT") & tight, "STRONG CANDIDATE")
        .when((p == "PERSISTENT") & d.isin("DIFFUSE", "WEAKLY CLUSTERED"), "RECURRING / UNSTABLE DoA")
        .when((p == "REPEATED") & tight, "DEVELOPING CANDIDATE")
        .otherwise("INSUFFICIENT EVIDENCE")
    )


def peak_status(windows: Column | str) -> Column:
    return F.when(col(windows) >= 4, "PERSISTENT").when(col(windows) >= 2, "REPEATED").otherwise("TRANSIENT")


def coherence(peaks: Column | str) -> Column:
    return F.when(col(peaks) <= 1.0, "COHERENT").otherwise("AMBIGUOUS")


def stability_class(windows: Column | str, recoveries: Column | str, has_state: Column | str, error: Column | str) -> Column:
    back = (col(recoveries) > 0) & col(has_state)
    return (
        F.when(back & (col(error) <= 10.0), "MIXED / RECOVERING").when(back, "MIXED / SHIFTED")
        .when(col(windows) > 0, "MIXED / UNRESOLVED").when(col(has_state), "STABLE / NO AMBIGUITY").otherwise("INSUFFICIENT DATA")
    )


def rf_recurrence(sessions: Column | str) -> Column:
    return F.when(col(sessions) >= 2, "YES").otherwise("NOT YET")


def doa_recurrence(sessions: Column | str, qualifying: Column | str) -> Column:
    return F.when(col(qualifying) >= 2, "READY FOR VALIDATION").when(col(sessions) >= 2, "PRELIMINARY").otherwise("INSUFFICIENT DATA")


def guarded_ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, infinite where b is not positive."""
    return F.when(col(b) > 0, col(a) / F.when(col(b) > 0, col(b))).otherwise(float("inf"))


def novelty(ratio: Column | str) -> Column:
    return F.when(col(ratio) <= 1.0, "WITHIN_OBSERVED_TRAINING_RANGE").otherwise("OUTSIDE_OBSERVED_TRAINING_RANGE")


def short_event(duration_ms: Column | str) -> Column:
    return col(duration_ms).between(4.5, 5.4)


def association_status(usable: Column | str, eligible: Column | str, persistent: Column | str, recurring: Column | str, ambiguous: Column | str) -> Column:
    return (
        F.when(~col(usable), "UNUSABLE_INPUT").when(col(eligible) == 0, "NO_ELIGIBLE_COMPONENT").when(col(persistent) > 1, "MULTIPLE_PERSISTENT_TRACKS")
        .when((col(ambiguous) > 0) | (col(recurring) > 1), "AMBIGUOUS_ASSOCIATION").when(col(persistent) == 0, "INSUFFICIENT_SUPPORT").otherwise("UNIQUE_PERSISTENT_TRACK")
    )


def same_setting(a: Column | str, b: Column | str) -> Column:
    return F.abs(col(a) - col(b)) < 1e-9


def daq_failures(frame_sync: Column | str, sample_sync: Column | str, iq_sync: Column | str, overdrive: Column | str, ok: Column | str, dropped: Column | str) -> Column:
    """Array of the receiver checks that do not hold; what is unknown does not hold."""
    holds = {"frame_sync": col(frame_sync), "sample_delay_sync": col(sample_sync), "iq_sync": col(iq_sync), "adc_overdrive": ~col(overdrive), "daq_ok": col(ok), "dropped_frames": col(dropped) == 0}
    return F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), n) for n, c in holds.items()]), lambda x: x.isNotNull())


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once a row, however often lambdas inside ask for it."""
    return F.transform(F.array(value), use)[0]


def beam_width(doa: Column | str) -> Column:
    """Bins at or above half of the largest."""
    return once(col(doa), lambda d: once(F.array_max(d) * 0.5, lambda top: F.size(F.filter(d, lambda v: v >= top))))


def beam_peaks(doa: Column | str) -> Column:
    """Local maxima of a circular spectrum at or above half of the largest: above the left neighbour, not below the right."""
    at = lambda d, i: F.element_at(d, (F.pmod(i, F.size(d)) + 1).cast("int"))
    peaks = lambda d, top: F.size(F.filter(d, lambda v, i: (v >= top) & (v > at(d, i - 1)) & (v >= at(d, i + 1))))
    return once(col(doa), lambda d: once(F.array_max(d) * 0.5, lambda top: peaks(d, top)))
