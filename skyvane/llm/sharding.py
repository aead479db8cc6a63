"""Balanced contiguous shards from global byte-size prefix sums, by DataFrame functions only.

Rows are dealt by ranges of their id into buckets ("partitions" of the method), whose boundaries are fixed by
approximate quantiles; each bucket's byte and row totals are summed, the running sums of those few totals give every
bucket its offset, and a window inside the bucket gives every row its global prefix sum. Shard boundaries are the
equal targets ``total * k / shards``: a row belongs to the shard in which the middle of its bytes lies, so shards are
contiguous in (id, tie) order and each differs from its target by at most one row's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

TIES = 64


def bucket_of(key: Column, bounds: list[int]) -> Column:
    """Index of key among sorted bounds: a coarse step, then a fine one, so a row costs about 2 * sqrt(bounds)."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads = F.array(*[F.lit(int(b[0])) for b in blocks])
    fine = F.array(*[F.array(*[F.lit(int(x)) for x in b]) for b in blocks])
    coarse = F.size(F.filter(heads, lambda x: x <= key))
    inside = F.when(coarse > 0, F.size(F.filter(F.element_at(fine, F.greatest(coarse, F.lit(1))), lambda x: x <= key))).otherwise(0)
    return F.when(coarse > 0, (coarse - 1) * step + inside).otherwise(0)


def assign_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """All columns of docs with size, text_crc32, shard and slot.

    size is the UTF-8 bytes of the text (null: none) plus 1. Order: id (nulls first), then a hash of the text, then
    size. Rows that repeat an id stay in that order; rows alike in all of it are interchangeable. An id so frequent
    that it fills several quantiles is split over TIES sub-buckets by the hash, so it does not land in one task. An
    empty table gives an empty table. Columns of docs named like a new one are replaced. Ids are whole numbers. ``buckets``
    is by default one per 250,000 rows, from 256 to 8,192. Driver data: ``buckets`` numbers and two totals per
    sub-bucket; one shuffle, of whatever columns are read later. Rows alike in id and text are sorted in one task.
    """
    buckets = buckets or min(8192, max(256, docs.count() // 250_000))
    own = ("size", "text_crc32", "shard", "slot")
    raw = F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary"))
    src = docs.select(*[c for c in docs.columns if c not in own or c in (id_col, text)])
    q = src.select(F.percentile_approx(id_col, [i / buckets for i in range(1, buckets)], 10 * buckets).alias("q")).first()["q"] or []
    bounds = sorted(set(q))
    hot = sorted({x for x in bounds if q.count(x) > 1})

    key = F.col(id_col).cast("bigint")
    tie = F.xxhash64(raw)
    sub = F.when(key.isin(hot), F.shiftright(tie, 58) + TIES // 2).otherwise(0) if hot else F.lit(0)
    bucket = F.when(key.isNull(), -TIES + F.shiftright(tie, 58) + TIES // 2).otherwise(2 * bucket_of(key, bounds) * TIES)
    # An id that is itself a bound opens its bucket; the hot one's sub-buckets come before the ids after it.
    bucket = bucket + F.when(key.isin(hot), sub).otherwise(F.when(key.isNull(), 0).otherwise(TIES)) if hot else bucket
    dealt = (
        src.withColumn("size", (F.octet_length(raw) + 1).cast("bigint"))
        .withColumn("text_crc32", F.crc32(raw))
        .withColumn("__tie", tie).withColumn("__bucket", bucket.cast("bigint"))
    )
    # At most (2 * buckets + 1) * TIES rows of totals, whatever the input.
    totals = dealt.groupBy("__bucket").agg(F.sum("size").alias("__b"), F.count("*").alias("__n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "__bucket",
        F.coalesce(F.sum("__b").over(before), F.lit(0)).alias("__bytes_before"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__rows_before"),
        F.sum("__b").over(whole).alias("__all"),
    )
    inside = Window.partitionBy("__bucket").orderBy(F.col(id_col).asc_nulls_first(), "__tie", "size")
    placed = (
        dealt.withColumn("__end", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("__row", F.row_number().over(inside))
        .join(F.broadcast(offsets), "__bucket")
        .withColumn("__row", F.col("__row") + F.col("__rows_before") - 1)
        .withColumn("__twice", 2 * (F.col("__end") + F.col("__bytes_before")) - F.col("size"))
        .withColumn("shard", F.least(F.expr(f"__twice * {shards} div (2 * __all)"), F.lit(shards - 1)).cast("int"))
    )
    first = placed.groupBy("shard").agg(F.min("__row").alias("__first"))
    out = placed.join(F.broadcast(first), "shard").withColumn("slot", F.col("__row") - F.col("__first"))
    return out.select(*src.columns, *[c for c in own if c not in src.columns])


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``bytes``: nothing is promised for one shard more, so grown_shard is null."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return assign_shards(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP5_SQL = """
WITH s0 AS (SELECT i, i::BIGINT AS c FROM range(256) t(i)),
s1 AS (SELECT i, list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, c) AS c FROM s0),
tab AS (SELECT list(c ORDER BY i) AS t FROM s1),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
r AS (SELECT doc_id, len(h) // 2 + 1 AS size, 4294967295 - list_reduce([('0x' || substr(h, 2 * i + 1, 2))::BIGINT FOR i IN range(0, len(h) // 2)], lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1]), 4294967295::BIGINT) AS crc FROM d, tab),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id) AS upto, sum(size) OVER () AS total FROM r),
q AS (SELECT *, least((2 * upto - size) * 8 // (2 * total), 7)::INT AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'bytes' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1)::BIGINT AS slot, NULL::INT AS grown_shard FROM q
"""
