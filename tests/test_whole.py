"""Queries without SQL reach every row of their tables."""

import numpy as np
import pytest

from skyvane.catalog import QUERIES
from skyvane.operators import ml


def ids(spark, small, table, column):
    return sorted(r[0] for r in spark.read.parquet(f"{small}/{table}.parquet").select(column).distinct().collect())


def test_every_episode_is_associated(spark, small):
    got = [r[0] for r in QUERIES["association_exact"](spark, small).select("episode").collect()]
    assert sorted(got) == ids(spark, small, "lineitem", "l_orderkey")


@pytest.mark.parametrize("name", ["magnitude", "strongest", "spectrum", "instantaneous", "dominant", "envelope", "events", "components"])
def test_every_vector_is_measured(spark, small, name):
    got = [r[0] for r in QUERIES[f"iq_{name}"](spark, small).select("vec_id").collect()]
    assert sorted(got) == ids(spark, small, "embeddings", "vec_id")


def greedy_ward(x, clusters):
    groups = [[i] for i in range(len(x))]
    while len(groups) > clusters:
        cost = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum()
        _, i, j = min((cost(groups[i], groups[j]), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        groups[i] += groups.pop(j)
    out = np.zeros(len(x), int)
    for label, g in enumerate(sorted(groups, key=min)):
        out[g] = label
    return out


def test_ward_is_the_greedy_one_and_silhouette_the_plain_one():
    x = np.random.default_rng(3).normal(size=(60, 4))
    for k in (1, 2, 3, 7, 60):
        assert (ml.ward(x, k) == greedy_ward(x, k)).all()
    labels = ml.ward(x, 4)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    s = []
    for i, c in enumerate(labels):
        own = labels == c
        a, b = d[i, own].sum() / max(1, own.sum() - 1), min(d[i, labels == o].mean() for o in set(labels) - {c})
        s.append((b - a) / max(a, b) if own.sum() > 1 else 0)
    assert abs(ml.silhouette(x, labels) - np.mean(s)) < 1e-9


def test_studies_take_every_vector(spark, small, monkeypatch):
    got = [r[0] for r in QUERIES["cluster_study"](spark, small).select("vec_id").collect()]
    assert sorted(got) == ids(spark, small, "embeddings", "vec_id")
    seen = []
    monkeypatch.setattr(ml, "perturbation_trials", lambda spark, x, base, trials: seen.append((len(x), len(base), trials)))
    QUERIES["perturbation"](spark, small)
    assert seen == [(len(got), len(got), 50)]
