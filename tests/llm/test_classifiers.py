import zlib

import numpy as np

from skyvane.llm import quality, toxicity
from skyvane.llm.quality import fit_quality, keep_good, op3_quality, score_quality
from skyvane.llm.toxicity import fit_toxicity, op1_toxicity, score_toxicity


def auc(rows, truth):
    pos = [s for i, s in rows if truth.get(i) == 1]
    neg = [s for i, s in rows if truth.get(i) == 0]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


def checked(spark, query, label, floor, cut):
    sf = "/root/testdata/sf0.01"
    truth = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", label).collect()}
    rows = query(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= cut) for r in rows)
    assert auc([(r.doc_id, r.score) for r in rows if r.held_out], truth) >= floor


def test_toxicity_held_out(spark):
    checked(spark, op1_toxicity, "toxic", 0.85, 0.5)


def test_quality_held_out(spark):
    checked(spark, op3_quality, "quality", 0.97, 0.3)


def test_labels_of_the_held_out_fold_have_no_say(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    from pyspark.sql import functions as F

    from skyvane.llm.common import held_out

    for label, fit, mark in (("toxic", fit_toxicity, lambda m: m.__getstate__()), ("quality", fit_quality, lambda m: m.score(np.zeros((1, len(quality.statistics("")))).reshape(1, -1)).tolist())):
        flipped = labels.withColumn(label, F.when(held_out("doc_id"), 1 - F.col(label)).otherwise(F.col(label)))
        assert mark(fit(docs, labels)) == mark(fit(docs, flipped))


def test_planted_insults_are_found_by_compression():
    clean = ["the quiet river runs along the old stone bridge near our village today"] * 40
    words = ["river", "stone", "bridge", "village", "garden", "window", "letter", "market", "summer", "winter"]
    rng = np.random.default_rng(1)
    docs = [(" ".join(rng.choice(words, 30)), 0) for _ in range(300)]
    docs += [(" ".join([*rng.choice(words, 15), "blockhead", *rng.choice(words, 15), "nitwits"]), 1) for _ in range(60)]
    order = rng.permutation(len(docs))
    m = toxicity.train([docs[i] for i in order])
    found, plain, empty, odd = m.score(["you are a blockhead", clean[0], "", "x" * 5000])
    assert found > 0.5 > max(plain, empty, odd)
    far, near = m.distances(toxicity.windows(["blockhead village"]))
    assert far >= min(toxicity.THRESHOLDS) > near


def test_windows_cover_every_word_and_long_texts_alike():
    w = toxicity.windows(["", "one two", "  ", "é" * 100, "a\tb\nc"])
    assert w.doc.tolist() == [1, 1, 3, 3, 3, 4, 4, 4]
    assert (w.length // 4).tolist() == [3, 3, 48, 48, 4, 1, 1, 1]
    assert w.take(np.array([0])).samples(9) == toxicity.windows(["one"]).samples(9)
    again = toxicity.windows(["x one two y", "z one two z", "x one two y"])
    assert again.first_in_context().tolist() == [0, 1, 2, 3, 4, 5, 6, 7]
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdef"), 5)) for _ in range(400_000)]
    m = toxicity.Model(b"".join(toxicity.windows([" ".join(words[:500])]).samples(500)), b"".join(toxicity.windows([" ".join(words[500:600])]).samples(500)), (0.0, 1.0, 0, 0, 0, 0, 0, 0))
    long = " ".join(words)
    assert len(long) > 2 * toxicity.PART
    apart = sum(m.counts([" ".join(words[i : i + 50_000])])[0] for i in range(0, 400_000, 50_000))
    assert (m.counts(["a", long, "b"])[1] == apart).all()


def test_odd_rows_and_missing_labels(spark):
    rows = [(1, None, 7), (2, "", 8), (2, "a b", 9), (None, "words " * 5000, 1), (3, "é" * 9, 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score int")
    none = spark.createDataFrame([], "doc_id bigint, toxic int, quality int")
    odd = spark.createDataFrame([(None, 1, 1), (1, None, None), (1, 1, 0), (1, 1, 0)], none.schema)
    for labels in (none, odd):
        t = score_toxicity(docs, fit_toxicity(docs, labels)).collect()
        q = score_quality(docs, fit_quality(docs, labels)).collect()
        assert len(t) == len(q) == 5 and all(0 <= r.score <= 1 for r in t + q)
    assert keep_good(docs, none).columns == docs.columns
    assert keep_good(docs.limit(0), none).count() == 0
