import hashlib
import math
import random

import numpy as np
import pytest

from skyvane.llm.registry import QUERIES
from skyvane.llm.vector_codes import coded, nearest


def plain(rows, parts=4, entries=256, rounds=4, scale=1024):
    """The contract, entry by entry, with Python's integers."""
    kept = [(i, [math.floor(scale * x) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v, _ in kept), default=0)
    d = -(-width // parts)
    kept = [(i, v + [0] * (parts * d - len(v)), y) for i, v, y in kept]
    first = {}
    for i, v, _ in kept:
        if i is not None:
            first[i] = min(v, first.get(i, v))
    first = [first[i] for i in sorted(first)[:entries]]
    books = [[v[p * d : p * d + d] for v in first] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds if first else 0):
        for p in range(parts):
            members = {}
            for _, v, _ in kept:
                x = v[p * d : p * d + d]
                members.setdefault(near(x, books[p])[1], []).append(x)
            for e, xs in members.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out, total = [], {}
    for i, v, y in kept:
        at = [near(v[p * d : p * d + d], books[p]) for p in range(parts)] if first else None
        error = sum(a for a, _ in at) if at else None
        if at:
            total[y] = total.get(y, 0) + error
        out.append((i, "".join(f"{e:02x}" for _, e in at) if at else None, error, y, sha))
    return sorted(((i, c, e, total.get(y), s) for i, c, e, y, s in out), key=str)


def rows(df):
    return sorted((tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in df.collect()), key=str)


def made(n, width, seed, spread=0.3):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, spread) for _ in range(width)], rng.choice([None, 0, 1, 1, 1])) for i in range(n)]


KIND = "vec_id bigint, embedding array<double>, label int"


@pytest.mark.parametrize("n, width, entries, spread", [(300, 8, 256, 0.3), (120, 12, 16, 0.002), (90, 4, 7, 40.0)])
def test_equals_brute_force(spark, n, width, entries, spread):
    data = made(n, width, n, spread)
    assert rows(coded(spark.createDataFrame(data, KIND).repartition(5), entries=entries)) == plain(data, entries=entries)


def test_odd_rows(spark):
    data = made(60, 8, 1) + [(100 + i, [0.25] * 8, 5) for i in range(80)]  # one vector very many times
    data += [(200, None, 1), (201, [0.1, None, *[0.0] * 6], 1), (202, [float("nan")] * 8, None), (203, [float("inf")] * 8, 1), (204, [], 2), (205, [0.5], None), (206, [0.1] * 10, 3), (207, [float("nan")] * 40, 3)]
    data += [(None, [0.3] * 8, 1), (3, [-0.9] * 8, 1), (3, [0.9] * 8, None), (7, data[7][1], data[7][2])]
    df = spark.createDataFrame(data, KIND)
    for entries in (256, 20, 1):
        assert rows(coded(df, entries=entries)) == plain(data, entries=entries)
    out = coded(df.selectExpr("*", "'x' as code", "1 as error", "2 as part", "3 as n", "4 as label_error"), entries=20)
    assert rows(out) == plain(data, entries=20) and out.columns == ["vec_id", "label", "part", "n", "code", "error", "label_error", "codebooks_sha256"]


def test_nothing_null_ids_and_numbers_too_large(spark):
    df = spark.createDataFrame(made(5, 8, 2), KIND)
    assert coded(df.limit(0)).count() == 0
    assert coded(df.selectExpr("vec_id", "cast(null as array<double>) as embedding", "label")).count() == 0
    assert rows(coded(df.selectExpr("cast(null as bigint) as vec_id", "embedding", "label"))) == plain([(None, v, y) for _, v, y in made(5, 8, 2)])
    with pytest.raises(Exception, match="too large"):
        coded(spark.createDataFrame([(1, [1e12] * 4, 0)], KIND)).collect()
    with pytest.raises(ValueError):
        coded(df, entries=257)


def test_dropping_entries_changes_nothing():
    rng = np.random.default_rng(4)
    for n, k, d, high in ((500, 256, 16, 900), (300, 100, 3, 4), (50, 1, 5, 9), (40, 70, 1, 3)):  # small ranges give ties
        x, book = rng.integers(-high, high, (n, d)), rng.integers(-high, high, (k, d))
        all_ = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        code, best = nearest(x, book, block=32)
        assert (code == all_.argmin(axis=1)).all() and (best == all_.min(axis=1)).all()


def test_query_equals_brute_force_on_the_whole_table(spark, small):
    e = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    got = QUERIES["op12_vector_codes"](spark, small)
    ints = np.array([[math.floor(1024 * x) for x in r.embedding] for r in sorted(e, key=lambda r: r.vec_id)])
    books = [ints[:256, p * 16 : p * 16 + 16].copy() for p in range(4)]
    far = lambda x, b: ((x[:, None] - b[None]) ** 2).sum(axis=2)
    for _ in range(4):
        for p, b in enumerate(books):
            x = ints[:, p * 16 : p * 16 + 16]
            at = far(x, b).argmin(axis=1)
            for i in set(at):
                b[i] = x[at == i].sum(axis=0) // (at == i).sum()
    d = [far(ints[:, p * 16 : p * 16 + 16], b) for p, b in enumerate(books)]
    codes = ["".join(f"{x[i].argmin():02x}" for x in d) for i in range(len(ints))]
    assert [(r.code, r.error) for r in got.orderBy("vec_id").collect()] == [(c, sum(int(x[i].min()) for x in d)) for i, c in enumerate(codes)]
