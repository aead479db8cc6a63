"""What the corpus operators share: reading, the shared folder, label splits, Arrow helpers."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's ``spark.checkpoint.dir``; only a local session without one gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given is None and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="skyvane-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder: later jobs read it back, also after an executor is lost."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(written: DataFrame) -> DataFrame:
    """A written frame whose size estimate starts anew. A checkpoint keeps its plan's estimate, those of joins are products,
    and in a loop they get millions of digits, which planning then multiplies."""
    spark = written.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(written._jdf.javaRDD(), written._jdf.schema()), spark)


def held_out(doc_id: Column | str) -> Column:
    """True where crc32(doc_id as text) mod 5 is 0. A null id is neither held out nor trained on."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, cap: int) -> DataFrame:
    """(doc_id, text, label) of at most ``cap`` labelled documents outside the held-out fold.

    The cap is the documented bound of the classifiers' training set. Rows are taken in the order of a hash of their
    id, so a sample does not depend on partitioning. Of repeated ids the smallest text and label count. The broadcast
    side has at most ``cap`` rows of two numbers.
    """
    y = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id").agg(F.min(label).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(cap)
    )
    return (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(y), "doc_id")
        .groupBy("doc_id", "y").agg(F.min("text").alias("text"))
        .select("doc_id", "text", "y")
    )


def map_texts(df: DataFrame, fn: Callable[[list[str]], dict[str, pa.Array | list]], out: list[tuple[str, str]], text: str = "text", keep_text: bool = False) -> DataFrame:
    """Append columns computed by ``fn`` from lists of texts (null as '') to the columns of df; the text goes, but for keep_text.

    ``fn`` gets slices of at most 2,000 texts or about 8 MB, whichever is less, so memory follows the longest text, not
    the batch. ``out`` gives the new columns as (name, Spark type). Columns of df with a new column's name give way.
    """
    names = [n for n, _ in out]
    keep = [c for c in df.columns if (c != text or keep_text) and c not in names]
    read = text if keep_text else "__text__"
    src = df.select(*keep) if keep_text else df.select(*keep, F.col(text).alias(read))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in src.select(*keep).schema] + [f"`{n}` {t}" for n, t in out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, read):
                col = part.column(part.schema.get_field_index(read))
                new = fn([x or "" for x in col.to_pylist()])
                kept = [part.column(part.schema.get_field_index(k)) for k in keep]
                yield pa.RecordBatch.from_arrays(kept + [as_array(new[n], t) for n, t in out], names=keep + names)

    return src.mapInArrow(run, schema)


ARROW = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64()), "array<bigint>": pa.list_(pa.int64())}


def as_array(x, kind: str) -> pa.Array:
    return x if isinstance(x, pa.Array) else pa.array(x, type=ARROW[kind])


def slices(batch: pa.RecordBatch, text: str, rows: int = 2000, size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece has at most ``rows`` rows and, but for single long texts, ``size`` bytes."""
    col = batch.column(batch.schema.get_field_index(text))
    lengths = [0 if n is None else n for n in pc.binary_length(col).to_pylist()]
    at, held = 0, 0
    for i, n in enumerate(lengths):
        if i > at and (i - at >= rows or held + n > size):
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < len(lengths):
        yield batch.slice(at)
