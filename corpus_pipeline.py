"""Corpus preparation: the stages from raw documents to packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyvane.llm.common import cut, table
from skyvane.llm.decontamination import decontaminate
from skyvane.llm.packing import byte_bpe, pack
from skyvane.llm.quality import keep_good
from skyvane.llm.secrets import redact_secrets
from skyvane.llm.simhash import one_per_group, similar_cut


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality discriminant rejects go. A null text is judged as an empty one, rows alike go or stay
    together, extra columns are kept, also those named like a result; without labels of both kinds all rows get the
    share of good labels as their score; an empty table stays empty."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the smallest id: five-word shingles, a similarity of 0.8 or
    more. Null and empty texts are one group; of rows alike in id and text one stays; extra columns are kept."""
    return one_per_group(docs, cut_=similar_cut(0.8, docs.count()), shingle=5)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go; null and empty texts stay, rows alike go or stay together, extra columns
    are kept."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced inside the texts, so documents stay; n_chars follows the text, where there are both. Null and
    empty texts and extra columns stay as they are; rows are treated one by one."""
    out = redact_secrets(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars"))) if "n_chars" in docs.columns else out


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of at most 2,048 tokens. A null text is packed as an empty one; an empty table
    gives no pieces; extra columns do not matter."""
    return pack(docs, **byte_bpe())


STAGES = [
    ("quality classifier", quality_classifier),
    ("simhash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]
ORACLE_SQL = None  # a trained classifier and a tokenizer are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
