"""Evidence and artifacts: strict JSON, canonical hashes, record checks.

The hashes are per-record text work whose number and key formats are Python's own, so they run as Arrow UDFs.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def strict_loads(text: str | bytes):
    """JSON without repeated keys and without NaN or infinities."""

    def pairs(items: list) -> dict:
        out = dict(items)
        if len(out) != len(items):
            raise ValueError("repeated key")
        return out

    def constant(name: str):
        raise ValueError(f"{name} is not allowed")

    return json.loads(text, object_pairs_hook=pairs, parse_constant=constant)


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def canonical_sha256(value) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def text_sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def json_digest(text: Column | str) -> Column:
    """Struct (sha256, error): digest of the canonical form of JSON texts, or why they are not strict JSON."""

    @F.pandas_udf("sha256 string, error string")
    def run(s: pd.Series) -> pd.DataFrame:
        out = []
        for t in s:
            try:
                out.append((canonical_sha256(strict_loads(t)), None))
            except (ValueError, TypeError) as why:
                out.append((None, str(why)[:200]))
        return pd.DataFrame(out, columns=["sha256", "error"])

    return run(text)


def evidence_bundle(summary: DataFrame, scored: DataFrame, key: str = "session_id") -> DataFrame:
    """One row per session in both: its summary, its model record and the digests of both as JSON."""
    s = summary.select(key, F.to_json(F.struct(*[c for c in summary.columns if c != key])).alias("summary"))
    m = scored.select(key, F.to_json(F.struct(*[c for c in scored.columns if c != key])).alias("model"))
    out = s.join(m, key).withColumn("d", json_digest("summary")).withColumn("e", json_digest("model"))
    return out.select(key, "summary", "model", F.col("d.sha256").alias("summary_sha256"), F.col("e.sha256").alias("model_sha256"))


def model_record_problems(scored: DataFrame) -> DataFrame:
    """scored with problems: clusters outside 0 to 2, distances that are null, negative or out of order, wrong novelty."""
    c = F.filter(F.array(
        F.when(~F.coalesce(F.col("cluster").isin(0, 1, 2), F.lit(False)), "cluster"), F.when(F.coalesce(F.col("nearest") < 0, F.lit(True)), "nearest"), F.when(F.coalesce(F.col("second") < F.col("nearest"), F.lit(True)), "order"),
        F.when(F.coalesce((F.col("ratio") <= 1.0) != (F.col("novelty") == "WITHIN_OBSERVED_TRAINING_RANGE"), F.lit(True)), "novelty")), lambda x: x.isNotNull())
    return scored.withColumn("problems", c)


def prefix_problem(numbers: DataFrame, required: list[int], through: int) -> DataFrame:
    """Required session numbers up to ``through`` that are missing, and numbers that repeat."""
    want = numbers.sparkSession.createDataFrame([(n,) for n in required if n <= through], "number int")
    have = numbers.groupBy("number").agg(F.count("*").alias("n"))
    return want.join(have, "number", "left_anti").select("number", F.lit("MISSING").alias("problem")).unionAll(have.where("n > 1").select("number", F.lit("REPEATED")))


def artifact(kind: str, payload: dict, sources: dict[str, str]) -> dict:
    """An envelope with the digests of its payload and of itself."""
    body = {"kind": kind, "version": 1, "payload": payload, "payload_sha256": canonical_sha256(payload), "sources": dict(sorted(sources.items()))}
    return body | {"envelope_sha256": canonical_sha256(body)}


def artifact_problems(a: dict) -> list[str]:
    """What is wrong with an envelope: its fields, its digests, or a source path that leaves its folder."""
    fields = {"kind", "version", "payload", "payload_sha256", "sources", "envelope_sha256"}
    if set(a) != fields:
        return ["fields"]
    out = ["payload_sha256"] * (canonical_sha256(a["payload"]) != a["payload_sha256"])
    out += ["envelope_sha256"] * (canonical_sha256({k: v for k, v in a.items() if k != "envelope_sha256"}) != a["envelope_sha256"])
    return out + ["path"] * any(p.startswith("/") or ".." in p.split("/") for p in a["sources"])


def snapshot(spark: SparkSession, path: str, fields: str | None = None) -> DataFrame:
    """(path, n_bytes, sha256, line_no, value) of evidence files, with r for JSON lines of the given ``fields``.

    Digest and records of a file come from one read of its bytes in one row, so records never stand beside the digest of
    another state of the file, even if it changes while the query runs. Blank lines count but have no row; a file without
    lines, or that is no UTF-8, has one row without a record; Spark's file sources leave empty files out. r is null where a
    line is no such record. A file must fit a row.
    """
    files = spark.read.format("binaryFile").load(path)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    lines = F.filter(F.transform(F.split(text, "\r?\n"), lambda v, i: F.struct((i + 1).alias("line_no"), v.alias("value"))), lambda x: F.trim(x["value"]) != "")
    out = files.select(F.col("path"), F.octet_length("content").alias("n_bytes"), F.sha2("content", 256).alias("sha256"), lines.alias("lines"))
    out = out.select("path", "n_bytes", "sha256", F.inline_outer("lines"))
    return out.withColumn("r", F.from_json("value", fields)) if fields else out


def drifted(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, drift) of files whose digest in one snapshot is not that in the other: NEW, REMOVED or CHANGED."""
    digest = lambda d, name: d.select("path", F.col("sha256").alias(name)).distinct()
    both = digest(before, "was").join(digest(now, "is"), "path", "full")
    drift = F.when(F.col("was").isNull(), "NEW").when(F.col("is").isNull(), "REMOVED").when(F.col("was") != F.col("is"), "CHANGED")
    return both.select("path", drift.alias("drift")).where("drift is not null")
