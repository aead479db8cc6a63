"""An audit of all texts that are kept as evidence: digests, copies, broken records, claims that data cannot support.

Reads documents and conversations, and writes a row for each text, partitioned by where it comes from, and the list of
texts that occur more than once. Each run computes all of it and replaces what an earlier one wrote, so it can be run
again at any time.

    python -m jobs.text_audit --documents IN --conversations IN --out OUT [--settings FILE]
"""

from __future__ import annotations

import logging
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command, run_folder, settings, written
from skyvane.operators import guards
from skyvane.sources import logs

NAME = "text_audit"
log = logging.getLogger(f"jobs.{NAME}")

ROWS = "id bigint, part bigint, sha256 string, n_bytes bigint, n_lines int, n_records int, n_broken int, claims string, copies bigint, first_origin string, first_id bigint, origin string, kind string"
COPIES = "sha256 string, copies bigint, first struct<origin:string,id:bigint,part:bigint>"


def texts(documents: DataFrame, conversations: DataFrame) -> DataFrame:
    """(origin, kind, id, part, text): documents by source, turns of conversations by role."""
    d = documents.select(F.lit("documents").alias("origin"), F.col("source").alias("kind"), F.col("doc_id").alias("id"), F.lit(None).cast("bigint").alias("part"), "text")
    return d.unionAll(conversations.select(F.lit("conversations"), "role", "conv_id", F.col("turn").cast("bigint"), "text"))


def digest(text: Column | str) -> Column:
    return F.sha2(text, 256)


def repeated(all_: DataFrame, least: int) -> DataFrame:
    """(sha256, copies, first) of texts that occur ``least`` times or more; first is the least place."""
    place = F.struct("origin", "id", "part")
    return all_.where("text is not null").groupBy(digest("text").alias("sha256")).agg(F.count("*").alias("copies"), F.min(place).alias("first")).where(F.col("copies") >= least)


def audited(all_: DataFrame, copies: DataFrame) -> DataFrame:
    """A row for each text. A line with ``=`` is a record: strict, or broken. A null text has no lines, digest or copies."""
    records = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line: F.contains(line, F.lit("=")))
    broken = F.size(F.filter(records, lambda line: logs.strict_error(line).isNotNull()))
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))
    out = all_.select(
        "origin", "kind", "id", "part", digest("text").alias("sha256"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), lines.alias("n_lines"),
        (F.size(records) - broken).alias("n_records"), broken.alias("n_broken"), F.array_join(guards.topics("text"), "; ").alias("claims"),
    ).join(copies, "sha256", "left")
    own = lambda c, mine: F.when(F.col("sha256").isNotNull(), F.coalesce(c, mine))
    return out.select("id", "part", "sha256", "n_bytes", "n_lines", "n_records", "n_broken", "claims", own("copies", F.lit(1)).alias("copies"), own("first.origin", "origin").alias("first_origin"), own("first.id", "id").alias("first_id"), "origin", "kind")


def run(spark: SparkSession, documents: str, conversations: str, out: str, least_copies: int = 2) -> dict:
    """Audit all texts into ``out``/texts, by origin and kind, and ``out``/copies. Returns the numbers of rows."""
    all_ = texts(spark.read.parquet(documents), spark.read.parquet(conversations))
    # The copies are written before they are joined: both sides of the join are exchanged, and a text with very many copies can be split.
    repeated(all_, least_copies).write.mode("overwrite").parquet(f"{out}/copies")
    copies = written(spark, f"{out}/copies", COPIES)
    audited(all_, copies).hint("rebalance", "origin", "kind").write.mode("overwrite").partitionBy("origin", "kind").parquet(f"{out}/texts")
    rows = output(spark, out)
    did = rows.agg(F.count("*").alias("texts"), F.count_if(F.col("claims") != "").alias("with_claims"), F.count_if(F.col("n_broken") > 0).alias("with_broken_records"), F.count_if(F.col("copies") > 1).alias("copied")).first().asDict()
    log.info("read %s and %s, wrote %d texts to %s/texts and %d repeated ones to %s/copies: %s", documents, conversations, did["texts"], out, copies.count(), out, did)
    return did


def output(spark: SparkSession, out: str) -> DataFrame:
    return written(spark, f"{out}/texts", ROWS)


def job2_text_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job over the whole tables, twice into one new folder: the second run replaces the first one's rows."""
    folder = run_folder(spark, "job2")
    for _ in range(2):
        run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/conversations.parquet", f"{folder}/out", **settings(NAME))
    return output(spark, f"{folder}/out")


PARTS = "string_split(line, ',')"
STRICT = f"""len([p FOR p IN {PARTS} IF NOT contains(p, '=') OR trim(split_part(p, '=', 1)) = '']) = 0 AND len(list_distinct([trim(split_part(p, '=', 1)) FOR p IN {PARTS}])) = len({PARTS})"""
JOB2_SQL = f"""
WITH t AS (
  SELECT 'documents' AS origin, source AS kind, doc_id AS id, NULL::BIGINT AS part, text FROM documents
  UNION ALL SELECT 'conversations', role, conv_id, turn::BIGINT, text FROM conversations),
c AS (SELECT sha256(text) AS sha256, count(*) AS copies, min({{'o': origin, 'i': id, 'p': part}}) AS first FROM t WHERE text IS NOT NULL GROUP BY 1),
r AS (SELECT *, [line FOR line IN string_split(coalesce(text, ''), chr(10)) IF contains(line, '=')] AS records FROM t),
s AS (SELECT *, len([line FOR line IN records IF {STRICT}]) AS strict FROM r)
SELECT s.id, s.part, sha256(text) AS sha256, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END::INT AS n_lines,
  strict::INT AS n_records, (len(records) - strict)::INT AS n_broken, {guards.topics_sql('text')} AS claims, copies, first.o AS first_origin, first.i AS first_id, origin, kind
FROM s LEFT JOIN c ON c.sha256 = sha256(s.text)"""

if __name__ == "__main__":
    sys.exit(command(NAME, __doc__, {"documents": "Parquet table of documents", "conversations": "Parquet table of conversations", "out": "folder of the output"}, run))
