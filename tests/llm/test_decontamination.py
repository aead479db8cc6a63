import hashlib
import random
import re

from skyvane.llm.decontamination import decontaminate, find_overlaps, op9_decontamination


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(text, items, window=10):
    w, hit, met = plain_words(text), set(), set()
    for i, t in items:
        x = plain_words(t)
        for s in range(max(1, len(x) - window + 1)) if x else ():
            piece = x[s : s + window]
            for a in range(len(w) - len(piece) + 1):
                if w[a : a + len(piece)] == piece:
                    hit.update(range(a, a + len(piece)))
                    met.add(str(i))
    return len(w), len(hit), sorted(met)


def maximal(text, items, window=10):
    """Every (item, item_start, start, length) that holds a window and that no word on either side extends."""
    w, out = plain_words(text), []
    for i, t in items:
        x = plain_words(t)
        for a in range(len(w)):
            for b in range(len(x)):
                if a and b and w[a - 1] == x[b - 1]:
                    continue
                n = 0
                while a + n < len(w) and b + n < len(x) and w[a + n] == x[b + n]:
                    n += 1
                if n >= min(window, len(x)):
                    out.append((str(i), b, a, n))
    return sorted(out)


def cases(rng):
    some = [f"w{i}" for i in range(6)] + ["É", "ß9"]
    items = [(i, " ".join(rng.choice(some) for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 14, 30])))) for i in range(25)] + [(90, None), (None, "w1 w2"), (91, "w0")]
    texts = [None, "", "...", "w0"]
    for _ in range(120):
        t = [rng.choice([*some, "zz", "qq"]) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.5:
            t += plain_words(rng.choice(items)[1])[: rng.choice([8, 9, 10, 40])]
            t += [rng.choice(some) for _ in range(5)]
        texts.append("--".join(t).upper() if rng.random() < 0.3 else ", ".join(t))
    return texts, items


def test_equals_brute_force_in_one_block_and_in_many(spark):
    texts, items = cases(random.Random(1))
    long_items = [(i, t) for i, t in items if t is None or len(plain_words(t)) != 1]
    docs = spark.createDataFrame([(i % 50, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, items string")
    for some in (items, long_items):
        bench = spark.createDataFrame(some, "item_id bigint, text string")
        for block in (10**6, 60):
            got = find_overlaps(docs, bench, block=block, spans=True).collect()
            known = [(i, t) for i, t in some if i is not None and t is not None]
            want = sorted((i % 50, *plain(t, known)) for i, t in enumerate(texts))
            assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got) == want
            for r in got:
                want = maximal(r.text, known)
                assert sorted((m.item, m.item_start, m.start, m.length) for m in r.matches) == want
                assert r.longest == max((x[3] for x in want), default=0)


def test_matches_of_repeated_words(spark):
    docs = spark.createDataFrame([(1, "w0 w0 w0"), (2, "a b c d e f g h i j x a b c d e f g h i j"), (3, "v " * 30)], "doc_id bigint, text string")
    items = [(1, "w0"), (2, "a b c d e f g h i j a b c d e f g h i j"), (3, "v " * 11)]
    got = {r.doc_id: r for r in find_overlaps(docs, spark.createDataFrame(items, "item_id bigint, text string"), spans=True).collect()}
    assert {i: r.longest for i, r in got.items()} == {1: 1, 2: 10, 3: 11}
    assert all(sorted((m.item, m.item_start, m.start, m.length) for m in r.matches) == maximal(r.text, items) for r in got.values())


def test_long_document_over_shard_cuts(spark, monkeypatch):
    from skyvane.llm import decontamination as d

    item = [f"a{i}" for i in range(12)]
    text = ["z"] * 35 + item + ["z"] * 20 + item[:10]
    test = d.TestSet([("7", " ".join(item))], 10)
    for most in (5, 11, 40, 10**6):
        starts, place, window = d.occurrences([[x.encode() for x in text], []], test, most)
        row, first, at, length = d.longest_matches(place, window, test)
        assert starts.tolist() == [0, len(text) + 1]
        assert sorted(zip(row.tolist(), first.tolist(), at.tolist(), length.tolist(), strict=True)) == [(0, 0, 35, 12), (0, 0, 67, 10)]


def test_query_and_empty_tables(spark, small):
    docs, bench = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    want = {}
    for r in docs.collect():
        n, hit, met = plain(r.text, items)
        longest = max((x[3] for x in maximal(r.text, items)), default=0) if hit else 0
        want[r.doc_id] = (n, hit, len(met), hashlib.sha256(",".join(met).encode()).hexdigest(), hit > 0, longest)
    got = {r.doc_id: tuple(r)[1:] for r in op9_decontamination(spark, small).collect()}
    assert got == want and any(x[4] for x in want.values())
    assert decontaminate(docs, bench).count() == sum(not x[4] for x in want.values())
    assert decontaminate(docs, bench.limit(0)).count() == docs.count()
    assert decontaminate(docs.limit(0), bench).columns == docs.columns


def test_decontamination_keeps_clashing_columns(spark):
    rows = [(1, "one two three four five six seven eight nine ten", 999, "a", 7), (2, None, 5, None, 8), (2, "", None, "b", 9), (3, "one two", 1, "c", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_words int, items string, hit int")
    bench = spark.createDataFrame([(1, "One, two; three four five six seven eight nine ten eleven")], "item_id bigint, text string")
    kept = decontaminate(docs, bench)
    assert kept.schema == docs.schema and sorted(map(tuple, kept.collect()), key=str) == sorted(rows[1:], key=str)
