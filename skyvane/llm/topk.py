"""Exact top-k inner products by distributed histogram selection.

Every candidate is scored against every query of a block. Executors count the scores of each query in equal bins of
its range, the summed histograms locate the bin of the k-th highest score, and that bin is refined until it is one
score wide. Then the scores at or above the k-th are kept, ties at it cut to the smallest ids, first in each batch of
candidates, so that a score which very many candidates share is never gathered whole, and at last over all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Sums of products up to this are exact in doubles.
EXACT = 2**53
LARGEST = 2**61


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, v array<bigint>): floor(scale * x) of vectors without null or non-finite components; null ids go too."""
    x = F.col(vec_col)
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return (
        vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & good)
        .select(F.col(id_col).cast("bigint").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))
    )


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of doubles, cut or filled with zeros to ``width`` components."""
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width).astype(np.float64)
    out, at = np.zeros((len(lengths), width)), 0
    for i, n in enumerate(lengths):
        out[i, : min(n, width)] = flat[at : at + min(n, width)]
        at += n
    return out


def scored(batches: Iterator[pa.RecordBatch], q_ids: np.ndarray, q: np.ndarray, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(candidate ids, scores as integers, mask of own rows), candidates by queries, ``rows`` candidates at a time."""
    top = np.abs(q).max(initial=0)
    for b in batches:
        for at in range(0, b.num_rows, rows):
            part = b.slice(at, rows)
            ids, v = part.column(0).to_numpy(), matrix(part.column(1), q.shape[1])
            if top * np.abs(v).max(initial=0) * q.shape[1] < EXACT:
                s = (v @ q.T).astype(np.int64)
            else:
                exact = [[sum(int(x) * int(y) for x, y in zip(a, c, strict=True)) for c in q] for a in v]
                if any(abs(x) >= LARGEST for row in exact for x in row):
                    raise OverflowError("a score needs more than 62 bits")
                s = np.array(exact, np.int64).reshape(len(v), len(q))
            yield ids, s, ids[:, None] == q_ids[None, :]


def top_k_block(cand: DataFrame, q_ids: np.ndarray, q: np.ndarray, k: int, bins: int, rows: int) -> DataFrame:
    spark = cand.sparkSession
    sent = spark.sparkContext.broadcast((q_ids, q))

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, m = sent.value
        low, high, n = np.full(len(ids), LARGEST), np.full(len(ids), -(LARGEST)), np.zeros(len(ids), np.int64)
        for _, s, own in scored(batches, ids, m, rows):
            low = np.minimum(low, np.where(own, LARGEST, s).min(axis=0, initial=LARGEST))
            high = np.maximum(high, np.where(own, -(LARGEST), s).max(axis=0, initial=-(LARGEST)))
            n += (~own).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, low, high, n)], names=["q", "low", "high", "n"])

    def by_query(df: DataFrame) -> dict:
        return {r[0]: r[1:] for r in df.collect()}  # a row per query of the block

    seen = by_query(cand.mapInArrow(bounds, "q bigint, low bigint, high bigint, n bigint").groupBy("q").agg(F.min("low"), F.max("high"), F.sum("n")))
    low = np.array([seen[i][0] if i in seen else 0 for i in q_ids.tolist()], np.int64)
    high = np.array([seen[i][1] if i in seen else -1 for i in q_ids.tolist()], np.int64)
    total = np.array([seen[i][2] if i in seen else 0 for i in q_ids.tolist()], np.int64)
    above = np.zeros(len(q_ids), np.int64)
    low, high = np.where(total > 0, low, 0), np.where(total > 0, high, 0)
    few = total <= k  # all of them are wanted: the least score is the threshold
    high = np.where(few, low, high)
    while (high > low).any():
        width = np.maximum(1, -(-(high - low + 1) // bins))
        now = spark.sparkContext.broadcast((low, high, width))

        def histogram(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            ids, m = sent.value
            lo, hi, w = now.value
            open_ = np.flatnonzero(hi > lo)
            counts = np.zeros((len(open_), bins), np.int64)
            for _, s, own in scored(batches, ids[open_], m[open_], rows):
                ok = (s >= lo[open_]) & (s <= hi[open_]) & ~own
                c, j = np.nonzero(ok)
                counts += np.bincount(j * bins + (s[c, j] - lo[open_][j]) // w[open_][j], minlength=counts.size).reshape(counts.shape)
            j, b = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(open_[j]), pa.array(b), pa.array(counts[j, b])], names=["q", "bin", "n"])

        # Sums from the highest bin down; of each query only the bin that holds the k-th score comes to the driver.
        hist = cand.mapInArrow(histogram, "q bigint, bin bigint, n bigint").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        down = F.sum("n").over(Window.partitionBy("q").orderBy(F.col("bin").desc()))
        need = spark.createDataFrame(pa.table({"q": np.arange(len(q_ids)), "need": k - above}))
        kth = hist.withColumn("down", down).join(F.broadcast(need), "q").where((F.col("down") >= F.col("need")) & (F.col("down") - F.col("n") < F.col("need")))
        for r in kth.select("q", "bin", F.col("down") - F.col("n")).collect():
            above[r[0]] += r[2]
            start = low[r[0]] + r[1] * width[r[0]]
            low[r[0]], high[r[0]] = start, min(high[r[0]], start + width[r[0]] - 1)
        now.unpersist()
    limit = spark.sparkContext.broadcast(low)

    def winners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, m = sent.value
        held = np.zeros((0, 3), np.int64)

        def best(x: np.ndarray) -> np.ndarray:
            x = x[np.lexsort((x[:, 2], -x[:, 1], x[:, 0]))]
            first = np.searchsorted(x[:, 0], x[:, 0], "left")
            return x[np.arange(len(x)) - first < k]

        for c_ids, s, own in scored(batches, ids, m, rows):
            c, j = np.nonzero((s >= limit.value) & ~own)
            held = best(np.concatenate([held, np.stack([j, s[c, j], c_ids[c]], axis=1)]))
        yield pa.RecordBatch.from_arrays([pa.array(ids[held[:, 0]]), pa.array(held[:, 1]), pa.array(held[:, 2])], names=["query_id", "score", "vec_id"])

    best = cand.mapInArrow(winners, "query_id bigint, score bigint, vec_id bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding", block: int = 2048, bins: int = 512, rows: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): for each id of ``queries`` the k highest integer inner products in ``vectors``.

    Components become floor(scale * x). Equal scores go to the smaller vec_id; with fewer than k candidates all are
    returned. Vectors null, with null or non-finite components or with a null id take no part; missing components of
    a shorter vector count as 0. All rows with a query's own id are left out of its candidates; a query id that repeats
    is asked once, with its least vector; equal candidate rows are so many candidates. Scores of 2**61 or more raise. No queries or no candidates give
    no rows. Queries go out in blocks of ``block``; per block the driver holds their vectors and a bound each.
    """
    cand = integer_vectors(vectors, id_col, vec_col, scale)
    asked = integer_vectors(queries, id_col, vec_col, scale).groupBy("vec_id").agg(F.min("v").alias("v"))
    out, held = None, []

    def done(held: list) -> DataFrame:
        width = max(1, *(len(v) for _, v in held))
        m = np.zeros((len(held), width))
        for i, (_, v) in enumerate(held):
            m[i, : len(v)] = v
        return top_k_block(cand, np.array([i for i, _ in held], np.int64), m, k, bins, rows)

    for r in asked.toLocalIterator():
        held.append((r[0], r[1]))
        if len(held) == block:
            part = cut(done(held))
            out, held = part if out is None else out.unionAll(part), []
    if held or out is None:
        part = done(held) if held else vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
        out = part if out is None else out.unionAll(part)
    return out


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all vectors for every hundredth one; nulls, ties and repeated rows as in ``top_k``."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(e, e.where("vec_id % 100 = 0"))


OP7_SQL = """
WITH v AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
