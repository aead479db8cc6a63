"""Queries of state machines, kernels, model studies and guards; SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyvane.functions import classify as k
from skyvane.functions.stats import shown
from skyvane.operators import guards, ml
from skyvane.operators.families import contiguous_edge
from skyvane.plans.history_queries import DIMS, vectors
from skyvane.sources import samples
from skyvane.sources.observations import BURSTS_SQL, bursts, spread
from skyvane.streaming import tracker as t


def tracker(spark: SparkSession, sf: str) -> DataFrame:
    return t.track(bursts(spark, sf)).drop("episodes", "age_s", "time").withColumn("track_mean", shown("track_mean")).withColumn("track_spread", shown("track_spread"))


def source_episodes(spark: SparkSession, sf: str) -> DataFrame:
    return t.episode_events(t.track(bursts(spark, sf)))


def rejected_streak(spark: SparkSession, sf: str) -> DataFrame:
    """Policy columns of the tracker from counts alone: rejects in a row before each row's STABLE, and what they mean."""
    from pyspark.sql import Window

    w = Window.partitionBy("session_id").orderBy("time", "event_id")
    b = bursts(spark, sf).withColumn("run", F.sum((F.col("quality") == "STABLE").cast("int")).over(w))
    b = b.withColumn("streak", F.sum((F.col("quality") != "STABLE").cast("int")).over(Window.partitionBy("session_id", "run").orderBy("time", "event_id")))
    s = F.col("event_id") % 30
    return b.select("event_id", "streak", k.maturity(s).alias("maturity"), k.track_health(s, "streak").alias("health"), k.shift_required(s).alias("required"), k.track_state(F.col("event_id") % 8, F.col("event_id") % 15).alias("state"), k.short_event(F.col("event_id") % 9).alias("short"))


STREAK = f"""
WITH {BURSTS_SQL}, r AS (SELECT *, sum((quality = 'STABLE')::INT) OVER (PARTITION BY session_id ORDER BY time, event_id) AS run FROM bursts),
s AS (SELECT event_id, event_id % 30 AS su, sum((quality <> 'STABLE')::INT) OVER (PARTITION BY session_id, run ORDER BY time, event_id)::BIGINT AS streak FROM r)
SELECT event_id, streak, CASE WHEN su >= 20 THEN 'MATURE' WHEN su >= 5 THEN 'ESTABLISHED' ELSE 'BUILDING' END AS maturity,
  CASE WHEN su < 5 THEN 'BUILDING' WHEN streak >= CASE WHEN su >= 20 THEN 8 ELSE 5 END THEN 'LOST' WHEN streak >= CASE WHEN su >= 20 THEN 5 ELSE 3 END THEN 'DEGRADED' ELSE 'HEALTHY' END AS health,
  CASE WHEN su >= 20 THEN 7 ELSE 5 END AS required, CASE WHEN event_id % 8 < 5 THEN 'INSUFFICIENT_DATA' WHEN event_id % 15 <= 5 THEN 'TRACK_STABLE' WHEN event_id % 15 >= 12 THEN 'TRACK_SHIFTING' ELSE 'TRACK_VARIABLE' END AS state,
  event_id % 9 BETWEEN 4.5 AND 5.4 AS short FROM s"""


def contiguous_edges(spark: SparkSession, sf: str) -> DataFrame:
    b = bursts(spark, sf).withColumn("step", F.col("event_id"))
    return contiguous_edge(b, ["session_id"], "step", F.col("quality") != "MULTIPATH")


EDGES = f"""WITH {BURSTS_SQL}, f AS (SELECT session_id, min(event_id) FILTER (quality = 'MULTIPATH') AS f FROM bursts GROUP BY 1)
SELECT session_id, max(event_id) FILTER (f IS NULL OR event_id < f) AS edge FROM bursts JOIN f USING (session_id) GROUP BY 1"""


def made_files(spark: SparkSession, sf: str) -> DataFrame:
    """Sample files in memory: a tone per vector, its frequency and noise taken from the vector."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    e = spread(e, 1_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in (batch.slice(at, 64) for at in range(0, batch.num_rows, 64)):  # 4 MB of samples at a time
                out = []
                for v in b.column(1).to_pylist():
                    n, x = 4096, np.resize(np.array(v), 4096)
                    out.append((np.exp(2j * np.pi * (2000 + 4000 * v[0]) * np.arange(n) / 25_000) * 0.2 + 0.02 * (x + 1j * x[::-1])).astype("<c16").tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["vec_id", "content"])

    return e.mapInArrow(run, "vec_id bigint, content binary")


def kernel(name: str, *fields: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = samples.measured(made_files(spark, sf), name)
        return out.select("vec_id", *[F.col(f"result.{f}").alias(f.replace(".", "_")) for f in fields], "error")

    return run


def cluster_study(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters, isolation scores and two principal components of every vector, by models fitted on a bounded sample."""
    v = vectors(spark, sf).drop("cluster")
    return ml.study(ml.standardized(v, DIMS, ml.model_params(v, DIMS)), "vec_id", trees=100)


def perturbation(spark: SparkSession, sf: str) -> DataFrame:
    """How stable Ward's clusters of a study's sample are when rows are left out and noise is added."""
    v = vectors(spark, sf).drop("cluster")
    rows = ml.study_sample(ml.standardized(v, DIMS, ml.model_params(v, DIMS)), "vec_id").orderBy("vec_id").select("x").collect()
    x = ml.bounded([r["x"] for r in rows])
    return ml.perturbation_trials(spark, x, ml.ward(x, 3), trials=50)


IDENTITY, CAUSE, DIRECTION, CLASSES, STEADY, CLUSTER = "device or fingerprint identity", "unsupported causal explanation", "directional accuracy", "classification or separation capability", "physical source reliability or stability", "physical conclusion from a cluster"
#: Sentences on every topic, with denials, and what they claim by a reader's judgement.
GUARD_CASES = [
    ("Whoever sent this, the emitter has been recognised.", [IDENTITY]), ("Both runs met a device of one identity.", [IDENTITY]), ("Nothing here says which emitter sent it.", []), ("A fingerprint as unique as this is rare.", [IDENTITY]), ("We cannot identify a transmitter from power.", []),
    ("Rain brought about the longer gaps.", [CAUSE]), ("Wider peaks point to scattering.", [CAUSE]), ("The gaps were never due to rain.", []), ("Shorter gaps stem from a new schedule.", [CAUSE]), ("Multipath was looked for at noon.", []),
    ("Our azimuths are accurate to a degree.", [DIRECTION]), ("No bearing was calibrated that day.", []), ("Its absolute direction is north.", [DIRECTION]), ("The doa agrees with the ground truth.", [DIRECTION]), ("Bearings were kept for each burst.", []),
    ("Two classes can be told apart by width.", [CLASSES]), ("Power alone discriminates between emitters.", [CLASSES]), ("Width does not separate the classes.", []), ("These transmitters were easily distinguished.", [CLASSES]), ("Widths were put into three bins.", []),
    ("Its emitter stayed steady for a week.", [STEADY]), ("Trustworthy sources were heard at night.", [STEADY]), ("The source isn't reliable.", []), ("Stability of any device is unproven.", []), ("Burst counts were steady.", []),
    ("Members of cluster C3 are cars.", [CLUSTER]), ("C0 stands for a tyre sensor.", [CLUSTER]), ("C1 has nine members.", []), ("The emitter is stable, C2 is a vehicle.", [STEADY, CLUSTER]), ("It was not explained, but the device is the same.", [IDENTITY]),
]
#: The sentences that stood here before those above, with what they claim.
EARLIER_CASES = [
    ("This identifies the transmitter.", [IDENTITY]), ("It does not establish device identity.", []), ("The device has been identified.", [IDENTITY]), ("A unique RF fingerprint was met.", [IDENTITY]), ("No evidence of a device fingerprint.", []),
    ("Multipath caused the drift.", [CAUSE]), ("The spread reflects interference.", [CAUSE]), ("The drift is not due to multipath.", []), ("The change results from heating.", [CAUSE]), ("The values are plain.", []),
    ("The directional accuracy is known.", [DIRECTION]), ("The bearing was not calibrated.", []), ("The true azimuth is 40.", [DIRECTION]), ("The bearing agrees with ground truth.", [DIRECTION]), ("The bearing spread is 4 degrees.", []),
    ("Both features separate the classes.", [CLASSES]), ("The devices are distinguishable.", [CLASSES]), ("Do not claim discrimination.", []), ("Results confirm class separation.", [CLASSES]), ("Burst classifications were counted.", []),
    ("The emitter remains stable.", [STEADY]), ("A reliable source was found.", [STEADY]), ("Reliability of the source is unsupported.", []), ("This never proves device stability.", []), ("Counts were stable.", []),
    ("Cluster C1 represents a vehicle.", [CLUSTER]), ("C2 means interference.", [CLUSTER]), ("Cluster C0 has ten sessions.", []), ("The source is reliable, and C1 identifies a sensor.", [STEADY, CLUSTER]), ("It does not explain this but it is the device.", [IDENTITY]),
]
ALL_CASES = [*EARLIER_CASES, *GUARD_CASES]


def claim_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Claims in every document's whole text followed by one of the sentences."""
    case = F.element_at(F.array(*[F.lit(t) for t, _ in ALL_CASES]), (F.col("doc_id") % len(ALL_CASES) + 1).cast("int"))
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.concat_ws("\n", F.coalesce("text", F.lit("")), case).alias("text"))
    return d.select("doc_id", F.array_join(guards.topics(guards.left_open("text"), guards.ALL_CLAIMS), "; ").alias("claims"))


CASES_SQL = ", ".join("'" + t.replace("'", "''") + "'" for t, _ in ALL_CASES)
CLAIM_GUARD = f"""SELECT doc_id, {guards.topics_sql('text', guards.ALL_CLAIMS)} AS claims FROM (
  SELECT doc_id, {guards.left_open_sql(f"coalesce(text, '') || chr(10) || list_extract([{CASES_SQL}], (doc_id % {len(ALL_CASES)} + 1)::INT)")} AS text FROM documents)"""

QUERIES = {
    "tracker": tracker, "source_episodes": source_episodes, "track_policy": rejected_streak, "contiguous_edge": contiguous_edges, "iq_magnitude": kernel("magnitude", "samples", "rms", "mean", "median", "peak"),
    "iq_strongest": kernel("strongest", "strongest_hz"), "iq_spectrum": kernel("spectrum", "centroid_hz", "spread_hz", "entropy", "occupied_hz", "strongest_hz"), "iq_instantaneous": kernel("instantaneous", "sample.median", "block_mad.median"),
    "iq_dominant": kernel("dominant", "windows", "dominant.median", "states"), "iq_envelope": kernel("envelope", "variation", "transitions"), "iq_events": kernel("events", "events"), "iq_components": kernel("components", "usable", "strongest_hz"),
    "cluster_study": cluster_study, "perturbation": perturbation, "claim_guard": claim_guard,
}
SQL = {
    "track_policy": STREAK, "contiguous_edge": EDGES,
    "claim_guard": CLAIM_GUARD,
}
