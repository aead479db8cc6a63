"""Queries without SQL against plain readings of the whole small table."""

import re
import zlib

import numpy as np
import public_tokenizers
import xxhash

from skyvane.llm.packing import Ids, byte_bpe, op6_packing
from skyvane.llm.quality import fit_quality, op3_quality, statistics
from skyvane.llm.simhash import op4_simhash
from skyvane.llm.token_counts import op2_token_counts
from skyvane.llm.toxicity import fit_toxicity, op1_toxicity


def documents(spark, small):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


def test_token_counts_are_the_librarys(spark, small):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in op2_token_counts(spark, small).collect()}
    want = {}
    for i, t in documents(spark, small).items():
        n = len(sp.encode(t or ""))
        want[i] = (len((t or "").encode()), n, n > 4096)
    assert got == want


def test_fingerprints_and_components_are_the_plain_ones(spark, small):
    fps = {}
    for i, t in documents(spark, small).items():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        h = [xxhash.xxh64_intdigest(" ".join(words[s : s + 4]).encode(), 42) for s in range(max(1, len(words) - 3))] if words else []
        bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0) if h else np.zeros(64)
        fps[i] = sum(1 << b for b in range(64) if h and 2 * int(bits[b]) > len(h))
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op4_simhash(spark, small).collect()}
    assert got == {i: (f"{fps[i]:016x}", find(i)) for i in ids}


def fewest_by_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, k) for k, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


def test_pieces_are_the_librarys_and_packed_by_best_fit(spark, small):
    from tokenizers import Tokenizer

    tok, docs = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json"))), documents(spark, small)
    rows = op6_packing(spark, small).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == set(docs)
    for i, mine in by.items():
        ids = [*tok.encode(docs[i] or "", add_special_tokens=False).ids, 0]
        mine.sort(key=lambda r: r.piece)
        at = 0
        for n, r in enumerate(mine):
            assert (r.piece, r.start) == (n, at) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            assert r.length == 2048 or n == 0
            at += r.length
        assert at == len(ids)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        pieces.sort()
        assert [o for o, _ in pieces] == list(np.cumsum([0, *[n for _, n in pieces]])[:-1]) and sum(n for _, n in pieces) <= 2048
    assert len(bins) == fewest_by_best_fit([r.length for r in rows], 2048)


def test_every_code_point_has_the_librarys_ids():
    enc = Ids(**byte_bpe())
    assert enc.fast is not None
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [f"a {chr(c)}b{chr(c)}" for c in points]
    for at in range(0, len(texts), 50_000):
        part = texts[at : at + 50_000]
        for t, e in zip(part, enc.tok.encode_batch(part, add_special_tokens=False), strict=True):
            assert e.ids == enc.encode(t).tolist(), repr(t)


def test_scores_are_the_models(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    texts = documents(spark, small)
    q, t = fit_quality(docs, labels), fit_toxicity(docs, labels)
    for query, plain in ((op3_quality, lambda x: q.score(np.array([statistics(x)]))[0]), (op1_toxicity, lambda x: t.score([x])[0])):
        got = {r.doc_id: r.score for r in query(spark, small).collect()}
        assert set(got) == set(texts) and all(abs(got[i] - plain(x or "")) < 1e-6 for i, x in texts.items())
