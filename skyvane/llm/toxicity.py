"""Toxicity by compression distance.

zstandard trains one dictionary on windows of ordinary text and one on windows of toxic text. A window's distance is its
compressed length with the ordinary dictionary less its length with the ordinary dictionary followed by the toxic one:
the bytes that knowing toxic text saves. Windows are single words with the space before them (longer words in parts of
``LONGEST`` characters). Before compression a character is written as the four-byte hash of itself and its two
neighbours, so that what a dictionary knows of a short window outweighs zstandard's fixed costs in every script.

Most text of a toxic document is ordinary, so the toxic dictionary is refined by the distance itself: the labelled
documents are dealt into folds, a dictionary of the other folds measures the windows of each, and those beyond a high
quantile of the distances of ordinary text are what the next dictionaries are trained on. The final dictionary is that
of the round that separates best on labelled documents which no round has seen; on these, the counts of windows at
several thresholds are also weighted into a probability.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, map_texts, table

LONGEST = 48
#: Characters that are written at once, which bounds memory; longer texts are cut at a space where there is one.
PART = 1_000_000
THRESHOLDS = (4, 6, 8, 10, 12, 15)
#: By round: the quantile of ordinary distances that a toxic window exceeds, and the largest toxic dictionary.
ROUNDS = ((0.99, 65536), (0.99, 32768), (0.995, 16384), (0.998, 16384), (0.999, 16384), (0.999, 16384))
ORDINARY = 1 << 21
FOLDS = 4
#: Of a training, which is one process.
THREADS = 4


class Windows:
    """Written windows of texts: a buffer, starts and lengths in bytes, and the number of the text of each."""

    def __init__(self, written: np.ndarray, start: np.ndarray, length: np.ndarray, doc: np.ndarray):
        self.written, self.start, self.length, self.doc = written, start, length, doc

    def __len__(self) -> int:
        return len(self.start)

    def take(self, at: np.ndarray) -> Windows:
        return Windows(self.written, self.start[at], self.length[at], self.doc[at])

    def samples(self, most: int) -> list[bytes]:
        """At most about ``most`` windows, evenly spaced, as bytes."""
        buffer, step = memoryview(self.written).cast("B"), max(1, len(self) // most)
        return [bytes(buffer[s : s + n]) for s, n in zip(self.start[::step].tolist(), self.length[::step].tolist(), strict=True)]

    def first_in_context(self) -> np.ndarray:
        """Numbers of the windows that are the first with their content and neighbours, so that copied text counts once."""
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.written.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))])
        own = sums[(self.start + self.length) // 4] - sums[self.start // 4]
        before, after = np.r_[np.uint64(1), own[:-1]], np.r_[own[1:], np.uint64(1)]
        edge = np.r_[True, self.doc[1:] != self.doc[:-1]]
        before, after = np.where(edge, np.uint64(1), before), np.where(np.r_[edge[1:], True], np.uint64(1), after)
        context = own * np.uint64(3) + before * np.uint64(0x85EBCA77C2B2AE63) + after * np.uint64(0xC2B2AE3D27D4EB4F)
        return np.sort(np.unique(context, return_index=True)[1])


def windows(texts: list[str]) -> Windows:
    lowered = [t.lower() for t in texts]
    ends = np.cumsum([len(t) + 1 for t in lowered])
    c = np.frombuffer(f" {' '.join(lowered)} ".encode("utf-32-le", "surrogatepass"), "<u4")
    space = (c <= 32) & ((c == 32) | (c >= 9) & (c <= 13))
    c = np.where(space, np.uint32(32), c)
    h = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA6B) + c[2:] * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    first = np.flatnonzero(~space[1:] & space[:-1]) + 1
    last = np.flatnonzero(~space[:-1] & space[1:]) + 1
    doc = np.searchsorted(ends, first - 1, "right")
    n = -(-(last - first) // LONGEST)
    word = np.repeat(np.arange(len(n)), n)
    part = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
    start = first[word] + part * LONGEST
    stop = np.minimum(last[word], start + LONGEST)
    return Windows(h, (start - 1) * 4, (stop - start) * 4, doc[word])


def parts(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of at most ``PART`` characters with the number of the first; a longer text comes in pieces."""
    at, held, size = 0, [], 0
    for i, t in enumerate(texts):
        if held and size + len(t) > PART:
            yield at, held
            held, size = [], 0
        while len(t) > PART:
            cut = t.rfind(" ", 1, PART) + 1 or PART
            yield i, [t[:cut]]
            t = t[cut:]
        if not held:
            at = i
        held.append(t)
        size += len(t)
    if held:
        yield at, held


def dictionary(samples: list[bytes], size: int) -> bytes:
    """The content that zstandard's trainer chooses, or the samples themselves if they are too few to train on."""
    size = max(256, min(size, sum(map(len, samples)) // 2))
    try:
        return zstandard.train_dictionary(size, samples, k=32, d=6, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    """Literals stay uncompressed (strategy 1 with a target length), so each byte that a dictionary lacks costs the same."""
    p = zstandard.ZstdCompressionParameters(
        window_log=22, hash_log=21, chain_log=21, search_log=5, min_match=4, target_length=1, strategy=1,
        write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    d = zstandard.ZstdCompressionDict(content or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=p)


def lengths(c: zstandard.ZstdCompressor, w: Windows, threads: int = 0, at_once: int = 100_000) -> np.ndarray:
    """Compressed length of each window. threads: of zstandard, where one process does the work of a whole training."""
    buffer, out = memoryview(w.written).cast("B"), np.zeros(len(w), np.int64)
    for s in range(0, len(w), at_once):
        places = np.stack([w.start[s : s + at_once], w.length[s : s + at_once]], axis=1).astype("<u8")
        found = c.multi_compress_to_buffer(zstandard.BufferWithSegments(buffer, places.tobytes()), threads=threads)
        out[s : s + len(places)] = np.fromiter(map(len, found), np.int64, len(places))
    return out


class Model:
    """Dictionaries and weights of a document's counts; compressors are made where they are used."""

    def __init__(self, ordinary: bytes, toxic: bytes, weights: tuple[float, ...] = (0.0,) * (len(THRESHOLDS) + 2)):
        self.ordinary, self.toxic, self.weights = ordinary, toxic, weights

    def __getstate__(self) -> tuple:
        return self.ordinary, self.toxic, self.weights

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    @cached_property
    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        return compressor(self.ordinary), compressor(self.ordinary + self.toxic)

    def distances(self, w: Windows, known: np.ndarray | None = None, threads: int = 0) -> np.ndarray:
        """``known``: the lengths with the ordinary dictionary, if they have been measured."""
        ordinary, both = self.compressors
        return (lengths(ordinary, w, threads) if known is None else known) - lengths(both, w, threads)

    def counts(self, texts: list[str]) -> np.ndarray:
        """For each text the number of windows at each threshold, and of all."""
        out = np.zeros((len(texts), len(THRESHOLDS) + 1))
        for at, run in parts(texts):
            w = windows(run)
            out[at : at + len(run)] += count(w, self.distances(w), len(run))
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(design(self.counts(texts)) @ np.array(self.weights), -30, 30)))


def count(w: Windows, distance: np.ndarray, n: int) -> np.ndarray:
    return np.stack([*(np.bincount(w.doc, weights=distance >= t, minlength=n) for t in THRESHOLDS), np.bincount(w.doc, minlength=n)], axis=1)


def design(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones((len(counts), 1)), np.log1p(counts)], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Weights by Newton steps, with a ridge on all but the first."""
    w, penalty = np.zeros(x.shape[1]), np.r_[1e-6, np.full(x.shape[1] - 1, ridge)]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def loss(x: np.ndarray, y: np.ndarray) -> float:
    """Mean log-loss of weights fitted on each half of the rows and applied to the other."""
    out = []
    for k in (0, 1):
        fit = np.arange(len(y)) % 2 == k
        p = 1 / (1 + np.exp(-np.clip(x[~fit] @ logistic(x[fit], y[fit]), -30, 30)))
        out.append(-np.log(np.where(y[~fit] == 1, p, 1 - p) + 1e-9))
    return float(np.concatenate(out).mean())


def refined(toxic: list[Windows], plain: list[Windows], most: int) -> Iterator[bytes]:
    """Toxic dictionaries round by round, from the windows that the folds of toxic text and of ordinary text hold."""
    folds = range(len(toxic))
    others = lambda lists, i: [s for k in folds if k != i for s in lists[k]]
    samples = [w.samples(most // len(folds)) for w in plain]
    ordinary = [dictionary(others(samples, i), ORDINARY) for i in folds]
    known = [[lengths(c, w[i], THREADS) for w in (toxic, plain)] for i, c in enumerate(map(compressor, ordinary))]
    chosen = [w.samples(most // len(folds)) for w in toxic]
    for quantile, size in ROUNDS:
        yield dictionary([s for c in chosen for s in c], size)
        kept = []
        for i in folds:  # the dictionary that measures a fold has not seen it
            m = Model(ordinary[i], dictionary(others(chosen, i), size))
            far, near = (m.distances(w[i], known[i][k], THREADS) for k, w in enumerate((toxic, plain)))
            kept.append(toxic[i].take(np.flatnonzero(far > np.quantile(near, quantile))).samples(most))
        chosen = kept
        if sum(map(len, chosen)) < 16:
            return


def train(docs: list[tuple[str, int]], odds: float | None = None, most: int = 200_000) -> Model:
    """Dictionaries from three quarters of the labelled texts, their choice and the weights from the others.

    odds: of toxic to ordinary in the whole corpus, if docs are not drawn in that proportion. most: windows of a class
    that a dictionary is trained on, evenly spaced if there are more. With fewer than four toxic or ordinary texts a fold
    every score is the share of toxic text (0.5 without any label).
    """
    y, turn = np.array([v for _, v in docs], int), np.zeros(len(docs), int)
    for c in (0, 1):
        turn[y == c] = np.arange((y == c).sum()) % 4
    share = (y.sum() + 1) / (len(y) + 2)
    constant = Model(b"", b"", (float(np.log(share / (1 - share))), *[0.0] * (len(THRESHOLDS) + 1)))
    if min(sum(y == 0), sum(y == 1)) < 4 * FOLDS:
        return constant
    folds = []
    for c in (1, 0):
        w = windows([docs[i][0] for i in np.flatnonzero((y == c) & (turn > 0))])
        w = w.take(w.first_in_context())
        folds.append([w.take(np.flatnonzero(w.doc % FOLDS == i)) for i in range(FOLDS)])
    if not min(len(w) for kind in folds for w in kind):
        return constant
    ordinary, best = dictionary([s for w in folds[1] for s in w.samples(most // FOLDS)], ORDINARY), None
    rest = np.flatnonzero(turn == 0)
    w = windows([docs[i][0] for i in rest])
    known = lengths(compressor(ordinary), w, THREADS)
    for toxic in refined(*folds, most):
        x = design(count(w, Model(ordinary, toxic).distances(w, known, THREADS), len(rest)))
        if best is None or loss(x, y[rest]) < best[0]:
            best = loss(x, y[rest]), toxic, x
    weights = logistic(best[2], y[rest])
    if odds:
        weights[0] += np.log(odds) - np.log(y.sum() / (len(y) - y.sum()))
    return Model(ordinary, best[1], tuple(weights))


def fit_toxicity(docs: DataFrame, labels: DataFrame, cap: int = 1500) -> Model:
    """Train on at most ``cap`` toxic and 3 * cap ordinary labelled documents outside the held-out fold."""
    counts = {r["toxic"]: r["count"] for r in labels.where(~held_out("doc_id") & F.col("toxic").isNotNull()).groupBy("toxic").count().collect()}
    rows = labelled_sample(docs, labels.where("toxic = 1"), "toxic", cap).unionAll(labelled_sample(docs, labels.where("toxic = 0"), "toxic", 3 * cap))
    got = sorted((zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["text"], r["y"]) for r in rows.collect())
    return train([(t, y) for _, _, t, y in got], counts.get(1, 0) / max(1, counts.get(0, 0)) or None)


def score_toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every column of docs but the text, with score (0 to 1) and predicted (1 from 0.5 on).

    Null and empty texts have no windows and get the score of that. Rows are scored by themselves, equal texts alike;
    columns of docs named score or predicted are replaced; an empty table stays empty. No shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str]) -> dict:
        s = sent.value.score(texts)
        return {"score": s.tolist(), "predicted": (s >= 0.5).astype(int).tolist()}

    return map_texts(docs, run, [("score", "double"), ("predicted", "int")], text)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; null and empty texts, repeated ids and extra columns as in
    ``score_toxicity``, an id that is null is never held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
