"""Sample files by the binaryFile source: metadata scans without contents, verified reads, kernels over files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyvane.functions import spectral

SUMMARY = pa.struct([("count", pa.int64()), *[(n, pa.float64()) for n in ("median", "min", "max", "range", "mad", "q25", "q75", "iqr")]])
HZ = pa.list_(pa.float64())
COMPONENT = pa.struct([
    ("component", pa.int32()), ("first_bin", pa.int32()), ("last_bin", pa.int32()), *[(n, pa.float64()) for n in ("frequency_hz", "peak_power", "integrated_power", "contrast_db", "maximum_contrast_db", "width_hz")],
    ("local_maxima", pa.int32()), ("low_hz", pa.float64()), ("high_hz", pa.float64()), ("eligible", pa.bool_()), ("reasons", pa.list_(pa.string())), ("flags", pa.list_(pa.string())),
])
#: Kernel, and the type of what it gives, by name.
KERNELS: dict[str, tuple[Callable[[np.ndarray], dict], pa.StructType]] = {
    "magnitude": (spectral.magnitude, pa.struct([("samples", pa.int64()), *[(n, pa.float64()) for n in ("rms", "mean", "median", "peak")]])),
    "strongest": (lambda iq: {"strongest_hz": spectral.strongest_offset(iq)}, pa.struct([("strongest_hz", pa.float64())])),
    "spectrum": (spectral.spectrum_features, pa.struct([*[(n, pa.float64()) for n in ("centroid_hz", "spread_hz", "entropy", "occupied_hz", "strongest_hz", "strongest_share")], ("peaks_hz", HZ), ("offsets_hz", HZ), ("spacings_hz", HZ)])),
    "instantaneous": (spectral.instantaneous, pa.struct([(n, SUMMARY) for n in ("sample", "block_median", "block_mad", "block_change")])),
    "dominant": (spectral.dominant_bins, pa.struct([("windows", pa.int64()), ("dominant", SUMMARY), ("step", SUMMARY), ("states", pa.int64()), ("state_spacing", SUMMARY)])),
    "envelope": (spectral.envelope, pa.struct([("sample", SUMMARY), ("variation", pa.float64()), ("block_median", SUMMARY), ("active", SUMMARY), ("transitions", pa.int64())])),
    "events": (
        lambda iq: {"events": [{"first": a, "last": b, "duration_ms": (b - a + 1) / spectral.RATE * 1e3, "peaks": spectral.event_peaks(iq, a, b)} for a, b in spectral.burst_events(iq)]},
        pa.struct([("events", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("duration_ms", pa.float64()), ("peaks", pa.list_(pa.struct([("rank", pa.int32()), ("frequency_hz", pa.float64()), ("relative_db", pa.float64())])))])))]),
    ),
    "components": (spectral.fragment_components, pa.struct([("usable", pa.bool_()), ("flags", pa.list_(pa.string())), ("strongest_hz", pa.float64()), ("components", pa.list_(COMPONENT))])),
}


def sample_files(spark: SparkSession, path: str, pattern: str = "*.iq") -> DataFrame:
    """(path, name, size_bytes, modified) of sample files; contents are not read unless selected later."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return df.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), "content")


def receipts(files: DataFrame) -> DataFrame:
    """(path, size_bytes, sha256) of every file."""
    return files.select("path", "size_bytes", F.sha2("content", 256).alias("sha256"))


def checked(files: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """files with problem: null, or why its samples must not be used."""
    problem = F.when(F.col("size_bytes") % 16 != 0, "PARTIAL_SAMPLE").when(F.col("size_bytes") < 32, "TOO_SHORT")
    if manifest is None:
        return files.withColumn("problem", problem)
    m = manifest.select("name", F.col("size_bytes").alias("want_size"), F.col("sha256").alias("want_sha"))
    out = files.join(m, "name", "left")
    return out.withColumn("problem", F.when(F.col("want_size").isNull(), "NOT_IN_MANIFEST").when(F.col("want_size") != F.col("size_bytes"), "SIZE-FAIL").when(F.sha2("content", 256) != F.col("want_sha"), "HASH-FAIL").otherwise(problem)).drop("want_size", "want_sha")


def ddl(t: pa.DataType) -> str:
    if pa.types.is_struct(t):
        return "struct<" + ",".join(f"{f.name}:{ddl(f.type)}" for f in t) + ">"
    if pa.types.is_list(t):
        return f"array<{ddl(t.value_type)}>"
    return {pa.float64(): "double", pa.int64(): "bigint", pa.int32(): "int", pa.bool_(): "boolean", pa.string(): "string"}[t]


def measured(files: DataFrame, kernel: str) -> DataFrame:
    """files without the content, with result and error: the kernel's struct over complex128 samples, or why there is none.

    A file that a kernel rejects gives an error, not a failed job. One file at a time is in memory.
    """
    keep = [c for c in files.columns if c != "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn, kind = KERNELS[kernel]
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                raw, out, error = row.column(row.schema.get_field_index("content"))[0].as_buffer(), None, None
                try:
                    out = fn(np.frombuffer(raw, "<c16"))
                except (ValueError, IndexError) as why:
                    error = str(why)[:200]
                yield pa.RecordBatch.from_arrays([row.column(row.schema.get_field_index(c)) for c in keep] + [pa.array([out], kind), pa.array([error], pa.string())], names=[*keep, "result", "error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.select(*keep).schema)
    return files.mapInArrow(run, f"{schema}, result {ddl(KERNELS[kernel][1])}, error string")


def passband_grid(files: DataFrame) -> DataFrame:
    """Tone measurements of files named pass<1|2>_<minus|plus><n>00k.cs8."""
    form = r"^pass([12])_(minus|plus)([1-9]00)k\.cs8$"
    name = F.col("name")
    f = files.where(name.rlike(form)).select("name", F.regexp_extract(name, form, 1).cast("int").alias("pass"), (F.regexp_extract(name, form, 3).cast("int") * F.when(F.regexp_extract(name, form, 2) == "minus", -1000).otherwise(1000)).alias("offset_hz"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1)
                try:
                    t = spectral.passband_tone(r.column(3)[0].as_py(), r.column(2)[0].as_py()) | {"error": None}
                except ValueError as why:
                    t = dict.fromkeys(("clipped", "clipped_fraction", "measured_hz", "error_hz", "power_db")) | {"error": str(why)}
                types = {"clipped": pa.int64(), "error": pa.string()}
                yield pa.RecordBatch.from_arrays([r.column(k) for k in range(3)] + [pa.array([v], types.get(n, pa.float64())) for n, v in t.items()], names=["name", "pass", "offset_hz", *t])

    return f.mapInArrow(run, "name string, pass int, offset_hz int, clipped bigint, clipped_fraction double, measured_hz double, error_hz double, power_db double, error string")


def passband_summary(tones: DataFrame) -> DataFrame:
    """Per offset: mean power of both passes relative to the tones at 100 kHz, their difference, and the rules."""
    ref = tones.where(F.abs("offset_hz") == 100_000).agg(F.avg("power_db").alias("reference_db"))
    g = tones.groupBy("offset_hz").agg(F.count("*").alias("passes"), F.avg("power_db").alias("mean_db"), (F.max("power_db") - F.min("power_db")).alias("difference_db"), F.max("clipped").alias("clipped"), F.max(F.abs("error_hz")).alias("error_hz"))
    out = g.crossJoin(F.broadcast(ref)).withColumn("relative_db", F.col("mean_db") - F.col("reference_db"))
    ok = (F.col("passes") == 2) & (F.col("clipped") == 0) & (F.col("error_hz") <= spectral.CS8_NEAR_HZ) & (F.col("relative_db") >= -3.0) & (F.col("difference_db") <= 1.0)
    return out.withColumn("rules_pass", F.coalesce(ok, F.lit(False)))
