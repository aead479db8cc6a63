"""From measurements of fragments to episodes and captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyvane.functions.stats import exact_median

RATE = 25_000.0


def magnitude_episodes(fragments: DataFrame, keys: list[str]) -> DataFrame:
    """Episode magnitudes from fragments (samples, rms, mean, peak, strongest_hz): weighted by samples, offsets by median.

    The median of all samples cannot come from fragments; ``sample_median`` gives it from the samples' histogram.
    """
    n = F.sum("samples")
    return fragments.groupBy(*keys).agg(
        F.count("*").alias("fragments"), n.alias("samples"), (n / RATE).alias("duration_s"), F.min(F.col("samples") / RATE).alias("min_duration_s"), F.max(F.col("samples") / RATE).alias("max_duration_s"),
        exact_median(F.col("samples") / RATE).alias("median_duration_s"), F.sqrt(F.sum(F.col("rms") ** 2 * F.col("samples")) / F.when(n > 0, n)).alias("rms"),
        (F.sum(F.col("mean") * F.col("samples")) / F.when(n > 0, n)).alias("mean"), F.max("peak").alias("peak"), exact_median("strongest_hz").alias("median_offset_hz"),
        F.min("strongest_hz").alias("min_offset_hz"), F.max("strongest_hz").alias("max_offset_hz"), (F.max("strongest_hz") - F.min("strongest_hz")).alias("offset_spread_hz"),
    )


def sample_median(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact median over all samples of a key, from counts of equal values rather than from all values in one place."""
    c = samples.groupBy(*keys, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(value)
    c = c.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    low, high = F.floor((F.col("all") + 1) / 2), F.floor((F.col("all") + 2) / 2)
    at = lambda k: F.min(F.when(F.col("upto") >= k, F.col(value)))
    return c.groupBy(*keys).agg(((at(low) + at(high)) / 2).alias("median"))


def spectral_episodes(fragments: DataFrame, keys: list[str], order: str = "mtime_ns") -> DataFrame:
    """Medians of spectral features over an episode's fragments, and the gaps between them in seconds.

    fragments: centroid_hz, spread_hz, entropy, occupied_hz, offsets_hz, spacings_hz.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    f = fragments.withColumn("gap_s", (F.col(order) - F.lag(order).over(w)) / 1e9)
    nearest = F.array_min(F.transform("offsets_hz", lambda x: F.abs(x)))
    own = F.array_sort(F.filter("spacings_hz", lambda x: x.isNotNull()))
    f = f.withColumn("nearest_offset_hz", nearest).withColumn("__s", own).withColumn("__n", F.size("__s"))
    middle = (F.get("__s", F.floor((F.col("__n") - 1) / 2).cast("int")) + F.get("__s", F.floor(F.col("__n") / 2).cast("int"))) / 2
    f = f.withColumn("spacing_hz", F.when(F.col("__n") > 0, middle))
    names = ["centroid_hz", "spread_hz", "entropy", "occupied_hz", "nearest_offset_hz", "spacing_hz", "gap_s"]
    return f.groupBy(*keys).agg(F.count("*").alias("fragments"), *[exact_median(n).alias(n) for n in names])


def track_spacings(members: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of coherent tracks of an episode with two fragments in common: their spacing by fragment, summed up.

    members: keys, track_id, fragment, frequency_hz, one row per fragment of a track.
    """
    a = members.select(*keys, "fragment", F.col("track_id").alias("lower"), F.col("frequency_hz").alias("f"))
    b = members.select(*keys, "fragment", F.col("track_id").alias("higher"), F.col("frequency_hz").alias("g"))
    p = a.join(b, [*keys, "fragment"]).where("lower < higher").withColumn("spacing_hz", F.col("g") - F.col("f"))
    out = p.groupBy(*keys, "lower", "higher").agg(F.count("*").alias("common"), exact_median("spacing_hz").alias("median_hz"), F.min("spacing_hz").alias("min_hz"), F.max("spacing_hz").alias("max_hz"))
    return out.where("common >= 2")


def status_transitions(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """How many episodes went from each status to each."""
    return old.select(*keys, F.col("status").alias("old")).join(new.select(*keys, F.col("status").alias("new")), keys).groupBy("old", "new").agg(F.count("*").alias("episodes"))
