"""Live pipelines: frames from growing CSV folders, bursts by event-time session windows, exactly-once sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyvane.functions import classify as k
from skyvane.functions.circular import mean_cos, mean_sin
from skyvane.operators.bursts import decode_frames


def frame_stream(spark: SparkSession, folder: str, latest_only: bool = True, files_per_trigger: int = 100) -> DataFrame:
    """Frames of CSV files that appear in a folder, with the time of their file. ``latest_only`` leaves files out that
    are older than a week when first seen, as a backlog; a restart goes on from the checkpoint."""
    r = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger)
    if latest_only:
        r = r.option("maxFileAge", "7d")
    lines = r.load(folder).select("value", F.col("_metadata.file_modification_time").alias("time"))
    return decode_frames_with_time(lines)


def decode_frames_with_time(lines: DataFrame) -> DataFrame:
    """decode_frames, keeping a time column: the first CSV field where it is a time, else the line's own."""
    out = decode_frames(lines.withColumn("__t", F.coalesce(F.try_to_timestamp(F.split("value", ",")[0]), F.col("time"))), keep=["__t"])
    return out.withColumnRenamed("__t", "time")


def burst_stream(frames: DataFrame, keys: list[str], gap_s: float = 3.0, late: str = "10 seconds") -> DataFrame:
    """Bursts as session windows over event time, given out when the watermark passes them: those of ``aggregate_bursts``.

    A window takes a row exactly one gap after the last one, and a burst ends before a gap of ``gap_s``; times have
    microseconds, so the window's gap is one microsecond shorter. Medians are exact.
    """
    f = frames.where(F.col("power") > k.POWER_GATE_DB).withWatermark("time", late)
    half = lambda c: F.percentile(c, F.lit(0.5))
    out = f.groupBy(*keys, F.session_window("time", f"{round(gap_s * 1_000_000) - 1} microseconds")).agg(
        F.max("time").alias("end_time"), F.count("*").alias("samples"), mean_cos("bearing").alias("c"), mean_sin("bearing").alias("s"), F.max("power").alias("peak_power"), F.max("confidence").alias("max_confidence"),
        half("confidence").alias("median_confidence"), F.avg("frequency_mhz").alias("frequency_mhz"), half("width").alias("doa_width"), half("peaks").alias("median_doa_peaks"), F.avg((F.col("peaks") == 1).cast("double")).alias("single_peak_ratio"),
    )
    r = F.sqrt(F.col("c") ** 2 + F.col("s") ** 2)
    out = out.withColumn("bearing", F.pmod(F.degrees(F.atan2("s", "c")), F.lit(360.0))).withColumn("bearing_spread", F.degrees(F.sqrt(-2.0 * F.ln(F.least(F.lit(1.0), F.greatest(r, F.lit(1e-12)))))))
    out = out.withColumn("quality", k.burst_quality("samples", "bearing_spread", "median_confidence", "doa_width", "single_peak_ratio"))
    return out.select(*keys, F.col("session_window.start").alias("time"), "end_time", "samples", "bearing", "bearing_spread", "peak_power", "max_confidence", "median_confidence", "frequency_mhz", "doa_width", "median_doa_peaks", "single_peak_ratio", "quality")


def append_once(path: str, transform: Callable[[DataFrame], DataFrame] = lambda d: d) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer: each micro-batch in a folder of its own number, so a repeated batch replaces itself."""

    def write(df: DataFrame, number: int) -> None:
        transform(df).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
