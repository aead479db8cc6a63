"""Frequency, direction and recurrence reports over bursts.

Frequencies are compared as whole hertz. Everything that asks for other rows of a frequency is one aggregation or one
window; no operator scans the bursts once per frequency.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyvane.functions import classify as k
from skyvane.functions.circular import angular_distance, circular_mean, resultant
from skyvane.functions.stats import exact_median
from skyvane.operators.bursts import gap_sessions

BINS, BIN_DEG, NEAR_DEG = 36, 10, 10.0


def hertz(c: str = "frequency_mhz") -> Column:
    return F.round(F.col(c) * 1e6).cast("bigint")


def ten_minutes(c: Column | str = "time") -> Column:
    """Start of the wall-clock ten minutes, as whole seconds."""
    s = F.unix_micros(c)
    return F.floor(s / 600_000_000) * 600


def span_s(c: str = "time") -> Column:
    return (F.max(F.unix_micros(c)) - F.min(F.unix_micros(c))) / 1e6


def gap_stats(df: DataFrame, keys: list[str], time: str = "time", tie: str = "event_id", bucket_s: int = 86_400) -> DataFrame:
    """Median and largest gap in seconds between consecutive rows by key; null for a single row.

    Keys can be few and large (a frequency has rows of all sessions), so rows are ordered inside time buckets of a key,
    and only the ends of buckets are ordered by key, for the gaps between buckets.
    """
    t = df.select(*keys, tie, F.unix_micros(time).alias("__t")).withColumn("__b", F.floor(F.col("__t") / (bucket_s * 1_000_000)))
    inner = t.withColumn("gap", F.col("__t") - F.lag("__t").over(Window.partitionBy(*keys, "__b").orderBy("__t", tie)))
    ends = t.groupBy(*keys, "__b").agg(F.min("__t").alias("first"), F.max("__t").alias("last"))
    outer = ends.withColumn("gap", F.col("first") - F.lag("last").over(Window.partitionBy(*keys).orderBy("__b")))
    # A key's only row has no gap, but the key stays.
    gaps = inner.select(*keys, "gap").unionAll(outer.select(*keys, "gap")).groupBy(*keys, "gap").agg(F.count("*").alias("n"))
    n = F.when(F.col("gap").isNotNull(), F.col("n")).otherwise(0)
    return gaps.groupBy(*keys).agg((F.percentile("gap", F.lit(0.5), n) / 1e6).alias("median_gap_s"), (F.max("gap") / 1e6).alias("max_gap_s"))


def doa_shift(df: DataFrame, keys: list[str]) -> DataFrame:
    """Distance between the mean bearings of the first and the last ten minutes that have five rows; 0 with fewer than two."""
    per = df.groupBy(*keys, ten_minutes().alias("bucket")).agg(F.count("*").alias("n"), circular_mean("bearing").alias("mean"))
    reliable = F.when(F.col("n") >= 5, F.struct("bucket", "mean"))
    ends = per.groupBy(*keys).agg(F.min(reliable).alias("first"), F.max(reliable).alias("last"), F.count(reliable).alias("reliable"))
    return ends.select(*keys, F.when(F.col("reliable") >= 2, angular_distance("last.mean", "first.mean")).otherwise(0.0).alias("doa_shift_deg"))


def frequency_overview(df: DataFrame) -> DataFrame:
    """Per frequency over all rows: counts, sessions, direction, persistence, drift, gaps and candidate quality."""
    keyed = df.withColumn("frequency_hz", hertz())
    per = keyed.groupBy("frequency_hz").agg(
        F.count("*").alias("observations"), F.count_distinct("session_id").alias("tagged_sessions"), circular_mean("bearing").alias("mean_bearing"), resultant("bearing").alias("concentration"),
        exact_median("peak_power").alias("median_power"), exact_median("max_confidence").alias("median_confidence"), exact_median("doa_width").alias("median_width"), span_s().alias("span_s"),
    )
    per = per.withColumn("persistence", k.persistence("observations")).withColumn("directional_class", k.directional_class("observations", "concentration"))
    out = per.join(doa_shift(keyed, ["frequency_hz"]), "frequency_hz").join(gap_stats(keyed, ["frequency_hz"]), "frequency_hz")
    return out.withColumn("candidate_quality", k.candidate_quality("persistence", "directional_class", "doa_shift_deg"))


def frequency_groups(current: DataFrame, history: DataFrame) -> DataFrame:
    """The overview of every frequency of the current session, with the session's own counts and response medians."""
    now = current.withColumn("frequency_hz", hertz()).groupBy("frequency_hz").agg(
        F.count("*").alias("current"), F.count("doa_width").alias("width_measured"), exact_median("doa_width").alias("current_width"), exact_median("median_doa_peaks").alias("current_peaks"))
    return now.withColumn("current_persistence", k.persistence("current")).join(frequency_overview(history), "frequency_hz")


def bearing_histogram(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per ten degrees, empty bins too."""
    counts = df.groupBy(*keys, F.floor(F.pmod("bearing", F.lit(360.0)) / BIN_DEG).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    held = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    return held.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))).alias("bin"), "m").select(*keys, "bin", F.coalesce(F.try_element_at("m", "bin"), F.lit(0)).alias("n"))


def histogram_peaks(df: DataFrame, keys: list[str]) -> DataFrame:
    """Bins with three rows at least, above the left neighbour and not below the right; rank 1 is the highest, later bin first."""
    h = bearing_histogram(df, keys)
    whole = F.transform(F.array_sort(F.collect_list(F.struct("bin", "n"))), lambda x: x["n"])
    at = lambda i: F.element_at("b", (F.pmod(i, F.lit(BINS)) + 1).cast("int"))
    rows = h.groupBy(*keys).agg(whole.alias("b")).select(*keys, "b", F.posexplode("b").alias("bin", "n"))
    rows = rows.where((F.col("n") >= 3) & (F.col("n") > at(F.col("bin") - 1)) & (F.col("n") >= at(F.col("bin") + 1)))
    w = Window.partitionBy(*keys).orderBy(F.col("n").desc(), F.col("bin").desc())
    return rows.select(*keys, (F.col("bin") * BIN_DEG).alias("centre"), F.col("n").alias("peak_count"), F.row_number().over(w).alias("peak_rank"))


def directional_states(df: DataFrame, keys: list[str]) -> DataFrame:
    """Each histogram peak with the rows within ten degrees of its bin's lower edge.

    A row is near at most three bins' edges, so it meets peaks by an equality join on those bins, never all of them.
    """
    bins = F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: F.pmod(F.floor(F.col("bearing") / BIN_DEG).cast("int") + d, F.lit(BINS)) * BIN_DEG)
    near = df.withColumn("centre", F.explode(bins)).where(angular_distance("bearing", F.col("centre").cast("double")) <= NEAR_DEG)
    out = histogram_peaks(df, keys).join(near, [*keys, "centre"]).groupBy(*keys, "centre", "peak_count", "peak_rank").agg(
        F.count("*").alias("hits"), F.pmod(F.degrees(F.atan2(F.sum(F.sin(F.radians("bearing"))), F.sum(F.cos(F.radians("bearing"))))), F.lit(360.0)).alias("bearing"),
        F.avg("max_confidence").alias("mean_confidence"), F.max("peak_power").alias("strongest"), exact_median("doa_width").alias("width"), exact_median("median_doa_peaks").alias("peaks"),
        F.count_distinct(ten_minutes()).alias("windows"), span_s().alias("span_s"),
    )
    return out.withColumn("status", k.peak_status("windows")).withColumn("coherence", k.coherence("peaks"))


def dominant_states(df: DataFrame, keys: list[str]) -> DataFrame:
    """The state with most hits; of equal ones that of the higher peak."""
    w = Window.partitionBy(*keys).orderBy(F.col("hits").desc(), F.col("peak_rank"))
    return directional_states(df, keys).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def ambiguity_windows(df: DataFrame, keys: list[str], gap_s: float = 60.0) -> DataFrame:
    """Runs of rows with several peaks, parted by gaps over gap_s: extent, extremes and the next run's start.

    A run whose rows all lack a width has max_width null.
    """
    runs = gap_sessions(df.where("median_doa_peaks > 1"), keys, "time", ["event_id"], gap_s, closed=False, name="window")
    out = runs.groupBy(*keys, "window").agg(F.min("time").alias("start"), F.max("time").alias("end"), F.count("*").alias("rows"), F.max("median_doa_peaks").alias("max_peaks"), F.max("doa_width").alias("max_width"), F.min("max_confidence").alias("min_confidence"))
    return out.withColumn("next_start", F.lead("start").over(Window.partitionBy(*keys).orderBy("window")))


def ambiguity_recovery(df: DataFrame, keys: list[str], gap_s: float = 60.0) -> DataFrame:
    """Each ambiguity window with the single-peak qualified rows after its end and before the next window.

    Every row belongs to the window that ended last before it, so one ordered pass finds it: an as-of lookup by a
    running maximum, not a range join.
    """
    w = ambiguity_windows(df, keys, gap_s)
    marks = w.select(*keys, F.col("end").alias("time"), F.lit(0).alias("kind"), "window", F.lit(None).cast("double").alias("bearing"))
    good = df.where(k.qualified() & (F.col("median_doa_peaks") <= 1)).select(*keys, "time", F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("window"), "bearing")
    order = Window.partitionBy(*keys).orderBy("time", F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, 0)
    met = marks.unionByName(good).withColumn("window", F.max("window").over(order)).where("kind = 1 and window is not null")
    met = met.join(w.select(*keys, "window", "next_start"), [*keys, "window"]).where("next_start is null or time < next_start")
    found = met.groupBy(*keys, "window").agg(F.min("time").alias("recovered_at"), F.count("*").alias("recovery_rows"), F.pmod(F.degrees(F.atan2(F.sum(F.sin(F.radians("bearing"))), F.sum(F.cos(F.radians("bearing"))))), F.lit(360.0)).alias("recovery_bearing"))
    out = w.join(found, [*keys, "window"], "left")
    s = lambda a, b: (F.unix_micros(a) - F.unix_micros(b)) / 1e6
    return out.withColumn("recovery_rows", F.coalesce("recovery_rows", F.lit(0))).withColumn("delay_s", s("recovered_at", "end")).withColumn("transition_s", s("recovered_at", "start"))


def stability(df: DataFrame, keys: list[str], gap_s: float = 60.0) -> DataFrame:
    """Stability class per key from windows, recoveries and the distance of the latest recovery to the dominant state."""
    rec = ambiguity_recovery(df, keys, gap_s)
    last = rec.groupBy(*keys).agg(F.count("*").alias("windows"), F.count("recovered_at").alias("recoveries"), F.max(F.when(F.col("recovered_at").isNotNull(), F.struct("window", "recovery_bearing"))).alias("latest"))
    dom = dominant_states(df, keys).select(*keys, F.col("bearing").alias("dominant_bearing"), "hits")
    both = df.select(*keys).distinct().join(last, keys, "left").join(dom, keys, "left").withColumn("windows", F.coalesce("windows", F.lit(0))).withColumn("recoveries", F.coalesce("recoveries", F.lit(0)))
    both = both.withColumn("centroid_error", angular_distance("latest.recovery_bearing", "dominant_bearing"))
    return both.withColumn("stability_class", k.stability_class("windows", "recoveries", F.col("dominant_bearing").isNotNull(), "centroid_error")).drop("latest")


def recurrence(df: DataFrame) -> DataFrame:
    """Per frequency: sessions, qualifying ones (five rows), recurrence labels and the widest distance of their centroids.

    The widest pair of a set of angles is found on the sorted circle: for each centroid the nearest ones to its
    opposite point, by two as-of lookups, so sessions are never paired with each other. Lookups stay inside a degree of
    a frequency; beyond it they need only the ends of the nearest degrees that have centroids.
    """
    per = df.where(F.col("session_id").isNotNull()).groupBy(hertz().alias("frequency_hz"), "session_id").agg(F.count("*").alias("n"), circular_mean("bearing").alias("centroid"))
    q = per.where("n >= 5").select("frequency_hz", "centroid")
    copies = F.array(F.col("centroid") - 360.0, F.col("centroid"), F.col("centroid") + 360.0)
    points = q.select("frequency_hz", F.explode(copies).alias("at"), F.lit(0).alias("asks"))
    asks = q.select("frequency_hz", F.pmod(F.col("centroid") + 180.0, F.lit(360.0)).alias("at"), F.lit(1).alias("asks"))
    degree = F.floor("at").alias("degree")
    place = ["frequency_hz", "degree"]
    up, down = (Window.partitionBy(*place).orderBy(o, "asks").rowsBetween(Window.unboundedPreceding, 0) for o in (F.col("at"), F.col("at").desc()))
    point = F.when(F.col("asks") == 0, F.col("at"))
    line = points.unionByName(asks).select("frequency_hz", degree, "at", "asks")
    ends = line.groupBy(*place).agg(F.min(point).alias("least"), F.max(point).alias("most"))
    by = Window.partitionBy("frequency_hz").orderBy
    before, after = by("degree").rowsBetween(Window.unboundedPreceding, -1), by(F.col("degree").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*place, F.max("most").over(before).alias("before"), F.min("least").over(after).alias("after"))
    line = line.withColumn("below", F.last(point, True).over(up)).withColumn("above", F.last(point, True).over(down)).where("asks = 1").join(ends, place)
    line = line.withColumn("below", F.coalesce("below", "before")).withColumn("above", F.coalesce("above", "after"))
    off = F.least(F.col("at") - F.col("below"), F.col("above") - F.col("at"))
    widest = line.groupBy("frequency_hz").agg((180.0 - F.min(off)).alias("max_centroid_shift"), F.count("*").alias("c"))
    out = per.groupBy("frequency_hz").agg(F.count("*").alias("tagged_sessions"), F.count_if(F.col("n") >= 5).alias("qualifying_sessions")).join(widest, "frequency_hz", "left")
    return out.select("frequency_hz", "tagged_sessions", "qualifying_sessions", k.rf_recurrence("tagged_sessions").alias("rf_recurrence"), k.doa_recurrence("tagged_sessions", "qualifying_sessions").alias("doa_recurrence"), F.when(F.col("qualifying_sessions") >= 2, F.col("max_centroid_shift")).alias("max_centroid_shift"))


def session_shifts(df: DataFrame) -> DataFrame:
    """Dominant bearing of each session of a frequency, in order of session id, and its distance to the previous one."""
    keyed = df.where(F.col("session_id").isNotNull()).withColumn("frequency_hz", hertz())
    dom = dominant_states(keyed, ["frequency_hz", "session_id"]).select("frequency_hz", "session_id", "bearing", "hits")
    w = Window.partitionBy("frequency_hz").orderBy("session_id")
    whole = Window.partitionBy("frequency_hz")
    out = dom.withColumn("previous_session", F.lag("session_id").over(w)).withColumn("shift_deg", angular_distance("bearing", F.lag("bearing").over(w)))
    out = out.withColumn("sessions", F.count("*").over(whole)).withColumn("return_error", angular_distance("bearing", F.first("bearing").over(w)))
    last = F.row_number().over(w) == F.col("sessions")
    return out.withColumn("return_match", F.when(last & (F.col("sessions") >= 3), F.when(F.col("return_error") <= 10.0, "YES").otherwise("NO"))).where("sessions >= 2").drop("return_error")
