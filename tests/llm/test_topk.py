import math
import random

from skyvane.llm.topk import top_k


def plain(rows, asked, k=10):
    ints = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ints if i in asked}):
        own = min(v for i, v in ints if i == q)
        s = [(-sum(a * b for a, b in zip(own, v)), i) for i, v in ints if i != q]
        out += [(q, r + 1, i, -n) for r, (n, i) in enumerate(sorted(s)[:k])]
    return out


def test_equals_brute_force(spark):
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(6)]) for i in range(150)]
    rows += [(1000 + i, [0.5] * 6) for i in range(60)]  # one vector very many times
    rows += [(None, [0.1] * 6), (300, None), (301, [0.1, None, 0.2, 0.1, 0.1, 0.1]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (304, []), (305, [0.7, 0.2]), (10, [0.9] * 6), (10, [-0.9] * 6), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    asked = {i for i in range(0, 1100, 10)} | {301, 302, 305}
    for block, bins, n in ((1000, 512, 64), (20, 4, 7)):
        got = top_k(df, df.where(df.vec_id.isin(asked)), block=block, bins=bins, rows=n).collect()
        assert sorted(map(tuple, got)) == plain(rows, asked)


def test_few_candidates_large_numbers_and_nothing(spark):
    rows = [(0, [1e6, -2.0]), (1, [1.2e6, 1.0]), (2, [-1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert sorted(map(tuple, top_k(df, df).collect())) == plain(rows, {0, 1, 2})
    assert top_k(df, df.limit(0)).count() == 0
    assert top_k(df.limit(0), df).count() == 0
    assert top_k(df.where("vec_id = 0"), df.where("vec_id = 0")).count() == 0
