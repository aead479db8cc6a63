import random
import re

import numpy as np
import xxhash

from skyvane.llm.components import components
from skyvane.llm.simhash import cluster_links, exact_cut, fingerprint, fingerprint_links, fingerprints, near_duplicates, one_per_group, shingle_set, similar_cut


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps, distance):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def cloud(rng, centres, each, flips):
    out = set()
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(each):
            x = c
            for _ in range(rng.randint(0, flips)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
    return sorted(out)


def test_fingerprint_equals_the_plain_reading():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("aBc dÉÀ \x85 \t\n\r\x0b\x0c\x1c.") for _ in range(rng.randint(0, 60)))
        assert fingerprint(text) == plain_fingerprint(text)
    assert fingerprint("") == fingerprint(" \n") == 0


def test_links_connect_what_brute_force_connects(spark):
    rng = random.Random(5)
    fps = cloud(rng, 40, 30, 5) + [rng.getrandbits(64) for _ in range(300)]
    fps = sorted(set(fps))
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp bigint")
    want = groups(fps, 4)
    for block in (4096, 8):  # 8: nearly every bucket is cut into blocks
        links = [(int(np.int64(r.a).astype(np.uint64)), int(np.int64(r.b).astype(np.uint64))) for r in fingerprint_links(df, exact_cut(4), block).collect()]
        assert all((a ^ b).bit_count() <= 4 for a, b in links)
        at = {x: i for i, x in enumerate(fps)}
        root = list(range(len(fps)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            x, y = sorted((find(at[a]), find(at[b])))
            root[y] = x
        assert [find(i) for i in range(len(fps))] == want


def test_components_of_chains_hubs_and_nothing(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5), (None, 3), (7, 6)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 1000 for i in range(1000, 1100)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_documents_with_nulls_ties_copies_and_extra_columns(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(9, base, 1), (4, base.replace("w7 ", "w8 "), 2), (4, base, 3), (None, "alone here", 4), (12, None, 5), (11, "", 6), (30, "x", 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, component_id int")
    out = near_duplicates(df.withColumn("other", df.component_id)).collect()
    assert len(out) == len(rows) and out[0].__fields__ == ["doc_id", "other", "fp", "component_id", "root"]
    fps = [plain_fingerprint(t) for _, t, _ in rows]
    want = groups(fps, 4)
    least = {g: min((rows[i][0] for i in range(len(rows)) if want[i] == g and rows[i][0] is not None), default=None) for g in want}
    assert {r.other: r.component_id for r in out} == {rows[i][2]: least[want[i]] for i in range(len(rows))}
    assert near_duplicates(df.limit(0)).count() == 0
    kept = one_per_group(df.unionAll(df.limit(3))).collect()
    first = {g: min(((rows[i][0] is None, rows[i][0] or 0) for i in range(len(rows)) if want[i] == g)) for g in want}
    assert sorted(((r.doc_id is None, r.doc_id or 0) for r in kept)) == sorted(first.values())
    assert one_per_group(df.limit(0)).count() == 0


def jaccard(a, b, k=5):
    x, y = ({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_similar_texts_meet_and_unlike_ones_stay_apart(spark):
    rng = random.Random(9)
    rows, like = [], []
    for i in range(0, 1200, 2):
        base = [f"{rng.choice('abcdefgh')}{rng.randint(0, 3000)}" for _ in range(rng.randint(150, 500))]
        copy = list(base)
        for _ in range(rng.randint(0, len(base) // 30)):
            copy[rng.randrange(len(copy))] = f"new{rng.randint(0, 99999)}"
        rows += [(i, " ".join(base)), (i + 1, " ".join(copy))]
        like.append(jaccard(*[t for _, t in rows[-2:]]))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for block in (4096, 16):
        got = {r.doc_id: r.component_id for r in near_duplicates(docs, cut_=similar_cut(0.8), shingle=5, block=block).collect()}
        together = [got[2 * i] == got[2 * i + 1] for i in range(len(like))]
        sure = [t for t, s in zip(together, like, strict=True) if s >= 0.87]
        some = [t for t, s in zip(together, like, strict=True) if s >= 0.8]
        assert sum(sure) >= 0.97 * len(sure) and sum(some) >= 0.9 * len(some) and len(some) > 300
        assert not any(t for t, s in zip(together, like, strict=True) if s < 0.5)
        assert len(set(got.values())) >= len(like)  # bases are unlike each other
    assert one_per_group(docs, cut_=similar_cut(0.8), shingle=5).count() == len(set(got.values()))


def test_groups_are_those_of_the_exact_similarity(spark):
    rng = random.Random(21)
    word = lambda: f"{rng.choice('abcdefgh')}{rng.randint(0, 3000)}"
    texts = []
    for _ in range(60):  # pairs around the mark, below it and above
        base = [word() for _ in range(200)]
        texts.append(" ".join(base))
        for changed in (3, 4, 5, 6, 9):
            copy = list(base)
            for at in rng.sample(range(0, 196, 6), changed):
                copy[at] = word() + "x"
            texts.append(" ".join(copy))
    line = [word() for _ in range(12)]
    texts += [" ".join(line * 60 + [word() for _ in range(80)]) for _ in range(3)]  # a repeated line rules the fingerprint
    sim = {(i, j): jaccard(texts[i], texts[j]) for i in range(len(texts)) for j in range(max(0, i - 6), i)}
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, j), s in sim.items():
        if s >= 0.8:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    assert sum(0.7 <= s < 0.8 for s in sim.values()) > 50 and sum(0.8 <= s < 0.85 for s in sim.values()) > 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for block in (4096, 16):
        got = {r.doc_id: r.component_id for r in near_duplicates(docs, cut_=similar_cut(0.8), shingle=5, block=block).collect()}
        assert got == {i: find(i) for i in range(len(texts))}


def family(rng, n, words=200, changed=(2, 3), mark=""):
    """Texts from one template with some words replaced: similarities lie on both sides of 0.8."""
    base = [f"{mark}w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for at in rng.sample(range(words), rng.choice(changed)):
            w[at] = f"x{rng.randrange(10**9)}"
        out.append(" ".join(w))
    return out


def similar_components(texts, similarity=0.8, k=5):
    sets = [{tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in map(str.split, texts)]
    number = {s: i for i, s in enumerate(dict.fromkeys(x for s in sets for x in s))}
    m = np.zeros((len(sets), len(number)), np.float32)
    for i, s in enumerate(sets):
        m[i, [number[x] for x in s]] = 1
    both, size = m @ m.T, m.sum(axis=1)
    near = both >= similarity * (size[:, None] + size[None, :] - both)
    root = np.arange(len(sets))
    while True:
        low = np.array([root[near[i]].min() for i in range(len(sets))])
        if (low == root).all():
            return root, int(np.triu(near, 1).sum())
        root = low


def test_families_of_templates_lose_no_link(spark):
    """Three families whose pairs are mostly just below the similarity, so that most proposals are refused."""
    rng = random.Random(17)
    texts = family(rng, 10, mark="a") + family(rng, 200, changed=(3,), mark="b") + family(rng, 80, changed=(3, 4), mark="c")
    want, pairs = similar_components(texts)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = near_duplicates(docs, cut_=similar_cut(0.8, docs.count()), shingle=5).select("doc_id", "component_id").collect()
    assert pairs > 150 and len(set(want)) > 20, (pairs, len(set(want)))
    assert [r.component_id for r in sorted(got)] == want.tolist()


def test_a_cluster_cut_into_blocks_keeps_its_links(spark):
    rng = random.Random(23)
    texts = family(rng, 60, changed=(3,))
    want, _ = similar_components(texts)
    cut_ = similar_cut(0.8, len(texts))
    fps = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "node bigint, text string")
    sets = spark.createDataFrame([(i, bytearray(np.unique(shingle_set(t, 5)[0].astype("<u4")).tobytes())) for i, t in enumerate(texts)], "node bigint, shingles binary")
    members = fps.selectExpr("node", "node as root", "node % 2 * 0 as cluster")
    marked = fingerprints(fps, cut_, 5)
    for block, size in ((4096, 10**9), (16, 10**9), (4096, 5_000)):
        links = cluster_links(members, sets, marked, cut_, block, size)
        assert links.count() < 3 * len(texts)
        root = {r.node: r.root for r in components(links).collect()}
        assert [root.get(i, i) for i in range(len(texts))] == want.tolist()
    assert cluster_links(members.limit(0), sets, marked, cut_).count() == 0
