"""From raw frames to bursts: gate, gap sessions, circular aggregates, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyvane.functions import classify as k
from skyvane.functions.circular import circular_mean, circular_std
from skyvane.functions.stats import exact_median


def seconds(c: Column | str) -> Column:
    """Timestamp as exact seconds, with its microseconds."""
    return F.unix_micros(F.col(c) if isinstance(c, str) else c) / 1_000_000


def gap_sessions(df: DataFrame, keys: list[str], time: str, tie: list[str], gap_s: float, closed: bool, name: str = "gap_id") -> DataFrame:
    """Number the runs of rows that no long gap parts, from 1 by key.

    A run ends before a gap greater than gap_s, or with ``closed`` before one of at least gap_s. Rows are ordered by time
    and then ``tie``. One shuffle by key, one sort.
    """
    w = Window.partitionBy(*keys).orderBy(time, *tie)
    gap = F.unix_micros(time) - F.lag(F.unix_micros(time)).over(w)
    limit = round(gap_s * 1_000_000)
    new = F.when(gap.isNull() | ((gap >= limit) if closed else (gap > limit)), 1).otherwise(0)
    return df.withColumn("__new", new).withColumn(name, F.sum("__new").over(w)).drop("__new")


def aggregate_bursts(frames: DataFrame, keys: list[str] = ["session_id"], gap_s: float = 3.0) -> DataFrame:  # noqa: B006
    """Frames above the power gate, gathered over gaps of at least gap_s, with circular statistics and quality.

    frames: keys, time, event_id, bearing, power, confidence, frequency_mhz, width, peaks.
    """
    runs = gap_sessions(frames.where(F.col("power") > k.POWER_GATE_DB), keys, "time", ["event_id"], gap_s, closed=True, name="burst")
    out = runs.groupBy(*keys, "burst").agg(
        F.min("time").alias("start_time"), F.max("time").alias("end_time"), F.count("*").alias("samples"),
        circular_mean("bearing").alias("bearing"), circular_std("bearing").alias("bearing_spread"), F.max("power").alias("peak_power"),
        F.max("confidence").alias("max_confidence"), exact_median("confidence").alias("median_confidence"), F.avg("frequency_mhz").alias("frequency_mhz"),
        exact_median("width").alias("doa_width"), exact_median("peaks").alias("median_doa_peaks"), F.avg((F.col("peaks") == 1).cast("double")).alias("single_peak_ratio"),
    )
    return out.withColumn("quality", k.burst_quality("samples", "bearing_spread", "median_confidence", "doa_width", "single_peak_ratio"))


def decode_frames(lines: DataFrame, line: str = "value", keep: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Positional CSV rows as frames, with the columns to keep; a row with a number that does not parse, or without exactly 360 spectrum bins, goes."""
    # What is exploded is computed once a row: filters and lambdas that ask for it do not compute it again.
    lines, f = lines.select(*keep, F.explode(F.array(F.split(F.col(line), ","))).alias("__f")), F.col("__f")
    spectrum = F.transform(F.slice(f, 18, F.greatest(F.size(f) - 17, F.lit(0))), lambda x: x.try_cast("double"))
    num = lambda i: F.try_element_at(f, F.lit(i)).try_cast("double")
    out = lines.select(*keep, num(2).alias("bearing"), num(3).alias("confidence"), num(4).alias("power"), (num(5) / 1e6).alias("frequency_mhz"), F.explode(F.array(spectrum)).alias("doa"))
    ok = F.col("bearing").isNotNull() & F.col("confidence").isNotNull() & F.col("power").isNotNull() & F.col("frequency_mhz").isNotNull()
    out = out.where(ok & (F.size("doa") == 360) & F.forall("doa", lambda x: x.isNotNull()))
    return out.withColumn("width", k.beam_width("doa").cast("double")).withColumn("peaks", k.beam_peaks("doa").cast("double"))
