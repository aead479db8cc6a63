"""Behaviour models over session features: exact scaling, clustering, freezing, scoring, robustness.

What touches every session is DataFrame work. Model fitting runs on a bounded table: it raises beyond ``MOST`` rows, and
``study`` fits on a stated sample and then scores every row.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyvane.functions import classify as k
from skyvane.functions.stats import exact_median

MOST = 20_000
#: Rows that a study over more of them is fitted on.
STUDY = 4_000


def model_params(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, median, mean, scale): imputation median, then mean and population deviation of the imputed column; no spread scales by 1."""
    med = df.agg(*[exact_median(f).alias(f) for f in features])
    filled = df.select(*features).crossJoin(F.broadcast(med.select(*[F.col(f).alias(f"m_{f}") for f in features]))).select(*[F.coalesce(f, f"m_{f}").alias(f) for f in features], *[f"m_{f}" for f in features])
    one = filled.agg(F.array(*[F.struct(F.lit(f).alias("feature"), F.first(f"m_{f}").alias("median"), F.avg(f).alias("mean"), F.stddev_pop(f).alias("sd")) for f in features]).alias("p"))
    return one.select(F.explode("p").alias("p")).select("p.feature", "p.median", "p.mean", F.when(F.col("p.sd") > 0, F.col("p.sd")).otherwise(1.0).alias("scale"))


def standardized(df: DataFrame, features: list[str], params: DataFrame) -> DataFrame:
    """df with x: the imputed, standardised features in order. params has a row per feature and is broadcast."""
    wide = params.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("median", "mean", "scale")))).alias("__p"))
    p = lambda f, c: F.col("__p")[f][c]
    x = F.array(*[(F.coalesce(F.col(f).cast("double"), p(f, "median")) - p(f, "mean")) / p(f, "scale") for f in features])
    return df.crossJoin(F.broadcast(wide)).withColumn("x", x).drop("__p")


def euclidean(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, t: s + t))


def freeze(df: DataFrame, x: str = "x", cluster: str = "cluster") -> DataFrame:
    """(cluster, centroid, ref_count, ref_mean, ref_median, ref_max) of assigned training rows."""
    n = F.posexplode(x)
    means = df.select(cluster, n.alias("i", "v")).groupBy(cluster, "i").agg(F.avg("v").alias("v")).groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("centroid"))
    d = df.join(F.broadcast(means), cluster).withColumn("d", euclidean(x, "centroid"))
    ref = d.groupBy(cluster).agg(F.count("*").alias("ref_count"), F.avg("d").alias("ref_mean"), exact_median("d").alias("ref_median"), F.max("d").alias("ref_max"))
    return means.join(ref, cluster)


def score(df: DataFrame, model: DataFrame, x: str = "x") -> DataFrame:
    """Nearest and second centroid of each row, their ratio and novelty; equal distances go to the smaller cluster.

    The model has a row per cluster and travels as one broadcast array; no UDF, no shuffle.
    """
    held = model.agg(F.array_sort(F.collect_list(F.struct("cluster", "centroid", "ref_max"))).alias("__m"))
    near = F.array_sort(F.transform("__m", lambda m: F.struct(euclidean(x, m["centroid"]).alias("d"), m["cluster"].alias("cluster"), m["ref_max"].alias("ref_max"))))
    out = df.crossJoin(F.broadcast(held)).withColumn("__n", near)
    out = out.withColumn("cluster", F.col("__n")[0]["cluster"]).withColumn("nearest", F.col("__n")[0]["d"]).withColumn("second", F.try_element_at("__n", F.lit(2))["d"])
    out = out.withColumn("ratio", k.guarded_ratio("nearest", F.col("__n")[0]["ref_max"])).withColumn("separation", k.guarded_ratio("second", "nearest"))
    return out.withColumn("novelty", k.novelty("ratio")).drop("__n", "__m")


def adjusted_rand(df: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Adjusted Rand index of two labelings by key, from the contingency table; 1 where both put all rows alike."""
    pairs = lambda n: (n * (n - 1) / 2).cast("double")
    cells = df.groupBy(*keys, a, b).agg(F.count("*").alias("n"))
    whole = lambda c: cells.groupBy(*keys, c).agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum(pairs(F.col("n"))).alias(f"s_{c}"))
    base = cells.groupBy(*keys).agg(F.sum(pairs(F.col("n"))).alias("s"), pairs(F.sum("n")).alias("t"))
    both = base.join(whole(a), keys).join(whole(b), keys)
    expected = F.col(f"s_{a}") * F.col(f"s_{b}") / F.when(F.col("t") > 0, F.col("t"))
    top = (F.col(f"s_{a}") + F.col(f"s_{b}")) / 2
    return both.select(*keys, F.when(F.coalesce(top == expected, F.lit(True)), 1.0).otherwise((F.col("s") - expected) / F.when(top != expected, top - expected)).alias("ari"))


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that are not unique: a one-to-one join must find none on either side."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def append_ledger(ledger: DataFrame, new: DataFrame, key: str = "session_id") -> DataFrame:
    """The rows of ``new`` that may be appended: keys not in the ledger, of repeated ones the first by content. A row without
    a key can never be told from another one and is not appended."""
    w = Window.partitionBy(key).orderBy(*[c for c in new.columns if c != key])
    return new.where(F.col(key).isNotNull()).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r").join(ledger.select(key), key, "left_anti")


def finalize(features: DataFrame, session_id: str, names: list[str], params: DataFrame, model: DataFrame, ledger: DataFrame) -> DataFrame:
    """The scored row of one session that is not in the ledger yet: one row to append, or none. The filter on the session
    reaches below the aggregation that made the features."""
    own = features.where(F.col("session_id") == session_id)
    out = score(standardized(own, names, params), model).select("session_id", "cluster", "nearest", "second", "separation", "ratio", "novelty")
    return append_ledger(ledger, out)


def bounded(rows: list) -> np.ndarray:
    if len(rows) > MOST:
        raise ValueError(f"a model is fitted on at most {MOST} sessions")
    return np.array(rows, float)


def study_sample(rows: DataFrame, key: str, most: int = STUDY) -> DataFrame:
    """At most ``most`` rows, in the order of a hash of their key: the documented bound of what a study is fitted on."""
    return rows.orderBy(F.xxhash64(key), key).limit(most)


def study(rows: DataFrame, key: str, x: str = "x", most: int = STUDY, trees: int = 500) -> DataFrame:
    """(key, cluster, isolation, pc1, pc2) of every row. Ward clusters, isolation trees and principal components are fitted
    on ``study_sample``; a row of the sample keeps its cluster, any other gets that of the nearest cluster mean. Rows
    with a null key or vector are left out; nothing is returned for an empty table. Keys are whole numbers."""
    rows = rows.where(F.col(key).isNotNull() & F.col(x).isNotNull()).select(key, x)
    got = sorted((r[0], r[1]) for r in study_sample(rows, key, most).collect())
    fit = bounded([v for _, v in got])
    schema = f"`{key}` bigint, cluster int, isolation double, pc1 double, pc2 double"
    if len(fit) < 3:
        return rows.sparkSession.createDataFrame([(int(k), 0, 0.0, 0.0, 0.0) for k, _ in got], schema)
    _, labels = choose_clusters(fit)
    own = {k: int(c) for (k, _), c in zip(got, labels, strict=True)}
    means = np.stack([fit[labels == c].mean(axis=0) for c in range(labels.max() + 1)])
    _, loadings, _ = principal_components(fit)
    sent = rows.sparkSession.sparkContext.broadcast((fit, own, means, loadings))

    def run(batches):
        fit, own, means, loadings = sent.value
        for batch in batches:
            keys, v = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), float)
            if len(keys):
                near = np.stack([((v - m) ** 2).sum(axis=1) for m in means], axis=1).argmin(axis=1)
                cluster = [own.get(k, int(c)) for k, c in zip(keys, near, strict=True)]
                pc = (v - fit.mean(axis=0)) @ loadings.T
                iso = isolation_scores(fit, trees, of=v)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(cluster, pa.int32()), pa.array(iso), pa.array(pc[:, 0]), pa.array(pc[:, 1] if pc.shape[1] > 1 else np.zeros(len(v)))], names=[key, "cluster", "isolation", "pc1", "pc2"])

    return rows.mapInArrow(run, schema)


def ward_merges(x: np.ndarray) -> list[tuple[float, int, int]]:
    """Ward's merges as (squared height, a member of each side), by nearest-neighbour chains; memory grows with the rows, not their pairs."""
    c, n = bounded(x).copy(), len(x)
    size, chain, out = np.ones(n), [], []
    while len(out) < n - 1:
        if not chain:
            chain = [int(np.isfinite(c[:, 0]).argmax())]
        while True:
            i = chain[-1]
            d = ((c - c[i]) ** 2).sum(1) * (2 * size * size[i] / (size + size[i]))
            d[i] = np.inf
            j = int(d.argmin())
            if len(chain) > 1 and d[chain[-2]] <= d[j]:
                j = chain[-2]
                break
            chain.append(j)
        del chain[-2:]
        out.append((float(d[j]), i, j))
        i, j = min(i, j), max(i, j)
        c[i] = (size[i] * c[i] + size[j] * c[j]) / (size[i] + size[j])
        size[i] += size[j]
        c[j] = np.inf  # out of reach
    return sorted(out, key=lambda m: m[0])


def merged_labels(merges: list[tuple[float, int, int]], n: int, clusters: int) -> np.ndarray:
    """Labels after the lowest n - clusters merges, numbered by first member."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for _, i, j in merges[: max(0, n - clusters)]:
        i, j = sorted((find(i), find(j)))
        root[j] = i
    return np.unique([find(i) for i in range(n)], return_inverse=True)[1]


def ward(x: np.ndarray, clusters: int) -> np.ndarray:
    """Ward clustering; labels are numbered by first member."""
    return merged_labels(ward_merges(x), len(x), clusters)


def silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    kinds, own = np.unique(labels, return_inverse=True)
    hot = np.eye(len(kinds))[own]
    count, step, s = hot.sum(axis=0), max(1, 4_000_000 // max(1, x.size)), np.zeros(len(x))
    for at in range(0, len(x), step):
        part, mine = slice(at, at + step), own[at : at + step]
        sums = np.sqrt(((x[part, None] - x[None]) ** 2).sum(-1)) @ hot
        rows = np.arange(len(mine))
        a = sums[rows, mine] / np.maximum(1, count[mine] - 1)
        other = sums / count
        other[rows, mine] = np.inf
        b = other.min(axis=1)
        top = np.maximum(a, b)
        s[part] = np.where((count[mine] > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0.0)
    return float(s.mean())


def choose_clusters(x: np.ndarray, most: int = 5) -> tuple[int, np.ndarray]:
    """The first k of 2..min(most, n - 1) with the best silhouette."""
    merges = ward_merges(x)
    best = max(range(2, min(most, len(x) - 1) + 1), key=lambda c: (silhouette(x, merged_labels(merges, len(x), c)), -c))
    return best, merged_labels(merges, len(x), best)


def principal_components(x: np.ndarray, n: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores, loadings and explained shares; the largest loading of each component is positive."""
    u, s, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    sign = np.sign(v[np.arange(len(v)), np.abs(v).argmax(axis=1)])
    return (u * s * sign)[:, :n], (v * sign[:, None])[:n], (s**2 / (s**2).sum())[:n]


def top_loadings(loadings: DataFrame, most: int = 5) -> DataFrame:
    """The ``most`` features of each component with the largest absolute loading, ties by name. loadings: component, feature, loading."""
    w = Window.partitionBy("component").orderBy(F.abs("loading").desc(), "feature")
    return loadings.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def isolation_scores(x: np.ndarray, trees: int = 500, sample: int = 256, seed: int = 42, of: np.ndarray | None = None) -> np.ndarray:
    """Isolation-forest anomaly scores, from 0 to 1, of the rows ``of`` (by default x) in trees grown from x; equal in
    distribution, not in value, to other libraries'. The trees depend on x and seed alone."""
    of = x if of is None else of
    rng = np.random.default_rng(seed)
    m = min(sample, len(x))
    c = lambda n: 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n if n > 2 else float(n == 2)
    depth = np.zeros(len(of))

    def drop(rows: np.ndarray, probe: np.ndarray, level: int, limit: int) -> None:
        span = np.ptp(x[rows], axis=0) if len(rows) else np.zeros(x.shape[1])
        open_ = np.flatnonzero(span > 0)
        if level >= limit or len(rows) <= 1 or not len(open_):
            depth[probe] += level + c(len(rows))
            return
        f = rng.choice(open_)
        at = rng.uniform(x[rows, f].min(), x[rows, f].max())
        drop(rows[x[rows, f] < at], probe[of[probe, f] < at], level + 1, limit)
        drop(rows[x[rows, f] >= at], probe[of[probe, f] >= at], level + 1, limit)

    for _ in range(trees):
        drop(rng.choice(len(x), m, replace=False), np.arange(len(of)), 0, int(np.ceil(np.log2(max(2, m)))))
    return 2 ** (-depth / trees / max(c(m), 1e-9))


def aligned(labels: np.ndarray, base: np.ndarray) -> np.ndarray:
    """labels renamed for the largest overlap with base (few clusters: all assignments are tried)."""
    kinds, targets = np.unique(labels), list(np.unique(base))
    targets += [max(targets) + 1 + i for i in range(max(0, len(kinds) - len(targets)))]
    best = max(permutations(targets, len(kinds)), key=lambda p: sum(((labels == a) & (base == b)).sum() for a, b in zip(kinds, p, strict=True)))
    name = dict(zip(kinds, best, strict=True))
    return np.array([name[v] for v in labels])


def rand_index(a: np.ndarray, b: np.ndarray) -> float:
    """Adjusted Rand index of two label vectors."""
    table = np.array([[((a == i) & (b == j)).sum() for j in np.unique(b)] for i in np.unique(a)], float)
    c2 = lambda n: n * (n - 1) / 2
    s, sa, sb, t = c2(table).sum(), c2(table.sum(1)).sum(), c2(table.sum(0)).sum(), c2(table.sum())
    expected, top = sa * sb / t if t else 0.0, (sa + sb) / 2
    return 1.0 if top == expected else float((s - expected) / (top - expected))


def perturbation_trials(spark, x: np.ndarray, base: np.ndarray, trials: int = 1000, keep: float = 0.8, noise: float = 0.1, seed: int = 42) -> DataFrame:
    """(trial, ari, retention) under random feature subsets and noise; trials run on executors, each with its own seed."""
    held, n = spark.sparkContext.broadcast((x, base)), len(np.unique(base))

    def run(batches):
        import pandas as pd

        v, b = held.value
        for pdf in batches:
            out = []
            for t in pdf["id"]:
                rng = np.random.default_rng([seed, int(t)])
                cols = rng.choice(v.shape[1], max(1, round(keep * v.shape[1])), replace=False)
                labels = ward(v[:, cols] + rng.normal(0, noise, (len(v), len(cols))), n)
                out.append((int(t), rand_index(labels, b), float((aligned(labels, b) == b).mean())))
            yield pd.DataFrame(out, columns=["trial", "ari", "retention"])

    return spark.range(trials).mapInPandas(run, "trial bigint, ari double, retention double")


def ablation(x: np.ndarray, base: np.ndarray, families: dict[str, list[int]]) -> list[tuple[str, float, float]]:
    """(family, ARI, retention) with each family of columns left out, least ARI first."""
    n, out = len(np.unique(base)), []
    for name, cols in families.items():
        labels = ward(np.delete(x, cols, axis=1), n)
        out.append((name, rand_index(labels, base), float((aligned(labels, base) == base).mean())))
    return sorted(out, key=lambda r: (r[1], r[0]))
