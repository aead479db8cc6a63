import random
import zlib

import numpy as np
import pytest

from skyvane.llm.packing import Ids, byte_bpe, op6_packing, pack, pieces_of, plan, sequences


def plain_bins(lengths, capacity):
    """Best-fit decreasing, one piece at a time."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            i = min(fits, key=lambda i: room[i])
            room[i] -= n
        else:
            room.append(capacity - n)
    return len(room)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 16, 50, 100])
    lengths = [rng.randint(1, rng.choice([capacity, max(1, capacity // 3)])) for _ in range(rng.randint(0, 300))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    runs = plan(counts, capacity)
    bins, taken = {}, {}
    for n in counts:
        mine = sorted(r for r in runs.tolist() if r[0] == n)
        ends = [r[1] for r in mine[1:]] + [counts[n]]
        for (_, first, k, b, at), stop in zip(mine, ends, strict=True):
            for t in range(stop - first):
                bins.setdefault(b + t % k, []).append((at + t // k * n, n))
        taken[n] = sum(1 for v in bins.values() for x in v if x[1] == n)
    assert taken == counts
    for v in bins.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(bins) == plain_bins(lengths, capacity)


def test_pieces():
    assert pieces_of(1, 4) == [(0, 1)] and pieces_of(4, 4) == [(0, 4)] and pieces_of(9, 4) == [(0, 1), (1, 4), (5, 4)] and pieces_of(8, 4) == [(0, 4), (4, 4)]


def test_ids_equal_the_tokenizers_library():
    enc, rng = Ids(**byte_bpe()), random.Random(4)
    texts = ["", "<|endoftext|> a", "x" * 5000, " " * 4000 + "b", "\n" * 2100] + ["".join(rng.choice("ab \n\t '日0é.,!s") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    for t in texts:
        assert enc.encode(t).tolist() == enc.tok.encode(t, add_special_tokens=False).ids


def test_every_piece_has_its_place(spark, small):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(byte_bpe()["path"])
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "source")
    odd = spark.createDataFrame([(None, None, "a"), (-1, "", "b"), (-1, "", "b"), (-2, "long words " * 3000, "c")], docs.schema)
    docs = docs.unionByName(odd)
    got = pack(docs, **byte_bpe(), with_ids=True).collect()
    want = []
    for r in docs.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [0]
        want += [(str(r.doc_id), p, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()), ids[s : s + n]) for p, (s, n) in enumerate(pieces_of(len(ids), 2048))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32, r.ids) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in bins.values():
        assert [o for o, _ in sorted(v)] == np.cumsum([0] + [n for _, n in sorted(v)])[:-1].tolist() and sum(n for _, n in v) <= 2048
    assert len(bins) == plain_bins([r.length for r in got], 2048)
    whole = {r.sequence_id: r.ids for r in sequences(spark.createDataFrame(got)).collect()}
    assert sum(map(len, whole.values())) == sum(r.length for r in got)
    assert all(whole[r.sequence_id][r.offset : r.offset + r.length] == r.ids for r in got)


def test_query_and_empty(spark, small):
    assert op6_packing(spark, small).count() >= 200
    assert pack(spark.createDataFrame([], "doc_id bigint, text string"), **byte_bpe()).count() == 0
