"""Quality by regularised quadratic discriminant analysis over transformed document statistics.

Each class has a mean and a covariance that is shrunk towards the pooled covariance and that towards its diagonal. The
score comes from the difference of the two log-densities, whose Mahalanobis distances are solved with Cholesky factors
that the model holds. How far to shrink, and the slope and offset that turn the difference into a probability, are
chosen on labelled documents that the densities have not seen.
"""

from __future__ import annotations

import zlib
from collections import Counter
from operator import eq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, map_texts, table
from .toxicity import logistic

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
SPACE = b" \t\n\r\x0b\x0c"
STOPS = b".,;:'\"()?-"
SYMBOLS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in STOPS)
WIDE = bytes(range(128, 256))


def statistics(text: str) -> list[float]:
    """Numbers about a whole text; all ratios of an empty one are 0."""
    b, words, lines = text.encode(), text.split(), text.split("\n")
    n, m = max(1, len(b)), max(1, len(words))
    share = lambda kind: (len(b) - len(b.translate(None, kind))) / n
    top = Counter(words).most_common(1)
    pairs = set(zip(words, words[1:], strict=False))
    clean = [w.strip(".,;:!?") for w in words]
    return [
        np.log1p(len(words)),
        np.log1p(len(b) / m),
        np.arcsinh(20 * share(UPPER)),
        np.arcsinh(20 * share(DIGITS)),
        np.arcsinh(50 * share(SYMBOLS)),
        np.arcsinh(20 * share(STOPS)),
        share(SPACE),
        share(WIDE),
        np.arcsinh(50 * text.count("!") / n),
        np.arcsinh(50 * text.count("|") / n),
        np.arcsinh(10 * sum(map(str.isupper, words)) / m),
        np.log1p(len(set(words))) / np.log1p(m),
        np.arcsinh(10 * (top[0][1] / m if top else 0)),
        np.arcsinh(10 * sum(map(eq, words, words[1:])) / m),
        1 - len(pairs) / max(1, len(words) - 1) if len(words) > 1 else 0.0,
        np.arcsinh(5 * (1 - len(set(lines)) / len(lines))),
        np.log1p(len(lines)) - np.log1p(len(words)),
        sum(map(str.isalpha, clean)) / m,
        np.log1p(max(map(len, words), default=0)),
    ]


class Discriminant:
    """Two Gaussian densities by mean, Cholesky factor and log-determinant, and the calibration of their difference."""

    def __init__(self, x: np.ndarray, y: np.ndarray, to_pooled: float, to_diagonal: float):
        self.centre, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = (x - self.centre) / self.scale
        own = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
        pooled = sum(o * (y == c).mean() for c, o in enumerate(own))
        self.means, self.factors, self.logdets = [], [], []
        for c in (0, 1):
            s = (1 - to_pooled) * own[c] + to_pooled * pooled
            s = (1 - to_diagonal) * s + to_diagonal * np.diag(np.diag(s)) + 1e-3 * np.eye(len(s))
            f = np.linalg.cholesky(s)
            self.means.append(z[y == c].mean(axis=0))
            self.factors.append(f)
            self.logdets.append(2 * np.log(np.diag(f)).sum())
        self.slope, self.offset = 1.0, float(np.log(max(1, (y == 1).sum()) / max(1, (y == 0).sum())))

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log density under class 1 less that under class 0, pressed together so that far outliers stay comparable."""
        z = (x - self.centre) / self.scale
        far = [(np.linalg.solve(f, (z - m).T) ** 2).sum(axis=0) + d for m, f, d in zip(self.means, self.factors, self.logdets, strict=True)]
        return np.arcsinh((far[0] - far[1]) / 2)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(x) + self.offset, -30, 30)))


class Constant:
    """Stands in where one class has too few labelled documents: the share of class 1."""

    def __init__(self, share: float):
        self.share = share

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share)


def train(x: np.ndarray, y: np.ndarray) -> Discriminant | Constant:
    """Choose the shrinkage by log-loss on every third document, calibrate there, then fit the densities on the others."""
    if min((y == 0).sum(), (y == 1).sum()) < 6:
        return Constant(float((y.sum() + 1) / (len(y) + 2)))
    test = np.zeros(len(y), bool)
    for c in (0, 1):
        test[np.flatnonzero(y == c)[::3]] = True
    best = None
    for to_pooled in (0.02, 0.1, 0.3, 0.6):
        for to_diagonal in (0.02, 0.1, 0.3, 0.7):
            m = Discriminant(x[~test], y[~test], to_pooled, to_diagonal)
            d = m.difference(x[test])
            m.offset, m.slope = logistic(np.stack([np.ones(len(d)), d], axis=1), y[test], 0.1)
            p = np.clip(m.score(x[test]), 1e-6, 1 - 1e-6)
            loss = -(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p)).mean()
            if best is None or loss < best[0]:
                best = loss, m
    return best[1]


def fit_quality(docs: DataFrame, labels: DataFrame, cap: int = 12_000) -> Discriminant | Constant:
    """Train on at most ``cap`` labelled documents outside the held-out fold; only their statistics come to the driver."""
    rows = map_texts(labelled_sample(docs, labels, "quality", cap), lambda ts: {"x": [statistics(t) for t in ts]}, [("x", "array<double>")])
    got = sorted(((zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["x"], r["y"]) for r in rows.collect()), key=lambda r: r[:2])
    n = len(statistics(""))
    return train(np.array([r[2] for r in got], float).reshape(-1, n), np.array([r[3] for r in got], int))


def score_quality(docs: DataFrame, model: Discriminant | Constant, threshold: float = 0.3, text: str = "text", keep_text: bool = False) -> DataFrame:
    """Every column of docs (the text only with keep_text), with score (0 to 1) and predicted (1 from ``threshold`` on).

    Null and empty texts are scored by the statistics of the empty text. Rows are scored by themselves, equal texts
    alike; columns named score or predicted are replaced; an empty table stays empty. No shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str]) -> dict:
        s = sent.value.score(np.array([statistics(t) for t in texts], float).reshape(len(texts), -1))
        return {"score": s.tolist(), "predicted": (s >= threshold).astype(int).tolist()}

    return map_texts(docs, run, [("score", "double"), ("predicted", "int")], text, keep_text)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs without the rows whose score is under the threshold, every column as it was, also one named score or predicted.

    Null and empty texts are scored alike, rows alike go or stay together, an empty table stays empty; without enough
    labels of both kinds every score is the share of good ones (0.5 without any label)."""
    # Under names of their own: docs may have columns called score or predicted.
    named = docs.select(*[F.col(c).alias(f"__{c}" if c in ("score", "predicted") else c) for c in docs.columns])
    scored = score_quality(named, fit_quality(docs, labels), threshold, keep_text=True).where("predicted = 1")
    return scored.select(*[F.col(f"__{c}" if c in ("score", "predicted") else c).alias(c) for c in docs.columns])


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; odd rows as in ``score_quality``, a null id is never held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
