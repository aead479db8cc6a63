"""Scored sessions: transitions, blocks, prior-only neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyvane.functions import classify as k

# Runtime block of each formal session number.
BLOCKS = {**dict.fromkeys((5, 6, 7), "A"), **dict.fromkeys((8, 9, 10), "B"), **dict.fromkeys((11, 12, 13), "C"), **dict.fromkeys((15, 16, 17), "D")}


def block_of(number: Column) -> Column:
    return F.try_element_at(F.create_map(*[x for n, b in BLOCKS.items() for x in (F.lit(n), F.lit(b))]), number)


def session_number(c: Column | str) -> Column:
    """The number of an id TPMS-NATURAL-<nnn>-<yyyymmdd>-<hhmmss>; null if it has another form or no such day."""
    c = F.col(c) if isinstance(c, str) else c
    form = r"^TPMS-NATURAL-(\d{3})-(\d{8}-\d{6})$"
    when = F.try_to_timestamp(F.regexp_extract(c, form, 2), F.lit("yyyyMMdd-HHmmss"))
    return F.when(c.rlike(form) & when.isNotNull(), F.regexp_extract(c, form, 1).try_cast("int"))


def cluster_transitions(scored: DataFrame, keys: list[str], order: str = "n", cluster: str = "cluster") -> DataFrame:
    """How often each cluster follows each one between consecutive sessions."""
    nxt = F.lead(cluster).over(Window.partitionBy(*keys).orderBy(order))
    return scored.withColumn("to_cluster", nxt).where("to_cluster is not null").groupBy(*keys, F.col(cluster).alias("from_cluster"), "to_cluster").agg(F.count("*").alias("n"))


def block_summary(scored: DataFrame) -> DataFrame:
    """Per block: sessions, the order of their clusters as text, inside and outside counts and mean distances."""
    seq = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "cluster"))), lambda x: F.concat(F.lit("C"), x["cluster"])), " → ")
    inside = F.col("ratio") <= 1.0
    return scored.groupBy("block").agg(F.count("*").alias("sessions"), seq.alias("sequence"), F.count_if(inside).alias("within"), F.count_if(~inside).alias("outside"), F.avg("nearest").alias("mean_nearest"), F.avg("second").alias("mean_second"), F.avg("ratio").alias("mean_ratio"))


def cluster_sets(scored: DataFrame) -> DataFrame:
    """Per cluster: in how many blocks it occurs, and whether in all."""
    blocks = scored.select("block").distinct().agg(F.count("*").alias("all_blocks"))
    return scored.groupBy("cluster").agg(F.count_distinct("block").alias("blocks")).crossJoin(F.broadcast(blocks)).select("cluster", "blocks", (F.col("blocks") == F.col("all_blocks")).alias("common"))


def prior_scope(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Count, mean and population deviation of the strictly earlier rows."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("prior_n", F.count(value).over(w)).withColumn("prior_mean", F.avg(value).over(w)).withColumn("prior_std", F.stddev_pop(value).over(w))


def history_neighbours(rows: DataFrame, keys: list[str], order: str, features: list[str], neighbours: int = 3) -> DataFrame:
    """The nearest strictly earlier rows of each row of a key (a receiver, say): root mean square of the differences
    scaled by the population deviation of the earlier rows. Features without spread or with a null on either side are
    left out; the distance is null where none is left. Ties go to the earlier row; equal orders are not earlier.

    A key's rows stream by in order past its earlier feature rows, so pairs are compared in memory and only the
    nearest leave the task. The features of one key's history must fit a task.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    src = rows.select(*keys, order, *[F.col(f).cast("double").alias(f) for f in features])
    ordered = src.repartition(parts, *keys).sortWithinPartitions(*keys, order)
    width = len(keys)

    def nearest(key: tuple, o: list, x: np.ndarray) -> list[tuple]:
        """x has a row per order; scales come from running means and squares about them, so no later or distant value blurs them."""
        known = ~np.isnan(x)
        n = np.cumsum(known, axis=0)
        squares, mean, total = np.empty_like(x), np.zeros(x.shape[1]), np.zeros(x.shape[1])
        for i, v in enumerate(x):
            d = np.where(known[i], v - mean, 0.0)
            mean = mean + d / np.maximum(n[i], 1)
            total = total + np.where(known[i], v - mean, 0.0) * d
            squares[i] = total
        out, before = [], 0
        for i in range(1, len(o)):
            before = i if o[i] != o[i - 1] else before
            if not before:
                continue
            e = before - 1
            scale = np.sqrt(squares[e] / np.maximum(n[e], 1))
            use = known[:before] & known[i] & (scale > 0)
            d = np.where(use, (x[i] - np.where(use, x[:before], 0.0)) / np.where(scale > 0, scale, 1.0), 0.0)
            terms = use.sum(axis=1)
            dist = np.where(terms > 0, np.sqrt((d * d).sum(axis=1) / np.maximum(terms, 1)), np.inf)
            k = min(neighbours, before)
            limit = np.partition(dist, k - 1)[k - 1]
            best = np.flatnonzero(dist <= limit)
            best = best[np.argsort(dist[best], kind="stable")][:k]
            out += [(*key, o[i], r, o[j], None if np.isinf(dist[j]) else float(dist[j])) for r, j in enumerate(best, 1)]
        return out

    names = [*keys, "target", "rank", "prior", "distance"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, o, x, types = None, [], [], None

        def done() -> pa.RecordBatch:
            got = nearest(key, o, np.array(x, float).reshape(len(o), -1))
            cols = list(zip(*got, strict=True)) if got else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, types, strict=True)], names=names)

        for b in batches:
            f = b.schema
            types = [f.field(i).type for i in range(width)] + [f.field(width).type, pa.int32(), f.field(width).type, pa.float64()]
            cols = [c.to_pylist() for c in b.columns]
            for r in zip(*cols, strict=True):
                if r[:width] != key:
                    if o:
                        yield done()
                    key, o, x = r[:width], [], []
                o.append(r[width])
                x.append([np.nan if v is None else v for v in r[width + 1 :]])
        if o:
            yield done()

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"target {kinds[order]}, rank int, prior {kinds[order]}, distance double"])
    return ordered.mapInArrow(run, schema)


def history_bundle(rows: DataFrame, keys: list[str], order: str, cluster: str, features: list[str]) -> DataFrame:
    """Per row: how many earlier rows there are, in all and by the own cluster, the own cluster's earlier feature means,
    and the differences to them; null without an earlier row of the cluster. Windows only, strictly earlier rows."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy(*keys, cluster).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("prior_count", F.count("*").over(w)).withColumn("same_cluster_count", F.count("*").over(own))
    for f in features:
        out = out.withColumn(f"mean_{f}", F.avg(f).over(own)).withColumn(f"delta_{f}", F.col(f) - F.avg(f).over(own))
    return out.select(*keys, order, cluster, "prior_count", "same_cluster_count", *[f"{p}_{f}" for f in features for p in ("mean", "delta")])


def prior_cluster_counts(rows: DataFrame, keys: list[str], order: str, cluster: str) -> DataFrame:
    """Per row and cluster seen before it: how many earlier rows have that cluster."""
    kinds = rows.select(*keys, cluster).distinct().groupBy(*keys).agg(F.collect_list(cluster).alias("__k"))
    w = Window.partitionBy(*keys, "of_cluster").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    each = rows.join(kinds, keys).withColumn("of_cluster", F.explode("__k"))
    return each.withColumn("n", F.count_if(F.col(cluster) == F.col("of_cluster")).over(w)).where("n > 0").select(*keys, order, "of_cluster", "n")


def score_novelty(df: DataFrame) -> DataFrame:
    return df.withColumn("novelty", k.novelty("ratio"))
