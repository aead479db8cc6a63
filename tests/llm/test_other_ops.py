import random
import zlib

import public_tokenizers
from pyspark.sql import functions as F

from skyvane.llm.chat import op8_chat_format, read_back, reconstruct, render
from skyvane.llm.sharding import assign_shards
from skyvane.llm.token_counts import PieceCounter, count_tokens


def test_piece_counts_equal_the_library():
    c, rng = PieceCounter(public_tokenizers.path("piece_bpe_32k.model")), random.Random(8)
    assert c.exact_cuts and len(c.one) > 10_000
    for _ in range(4000):
        s = "".join(rng.choice(" \n\t\r▁abé<s></s>0{}*/;　ﬁ日\0") for _ in range(rng.randint(0, 14)))
        assert c.count(s) == len(c.sp.encode(s)), repr(s)


def test_token_counts_of_odd_rows(spark):
    rows = [(1, None, 1), (1, "", 2), (None, "hello world", 3), (2, "a " * 5000, 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    out = {r.n_bytes: r for r in count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert out[0].n_tokens == 0 and out[11].n_tokens == len(PieceCounter(public_tokenizers.path("piece_bpe_32k.model")).sp.encode("hello world")) and out[10000].over_limit and not out[11].over_limit
    assert count_tokens(docs.limit(0), public_tokenizers.path("piece_bpe_32k.model")).count() == 0
    assert count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).where("n_bytes = 11").first().n_tokens == 2


def test_shards_are_contiguous_and_balanced(spark, small):
    rng = random.Random(6)
    rows = [(i, "x" * rng.randint(0, 300) + "é") for i in range(700)] + [(350, "copy %d" % i) for i in range(400)] + [(None, None)] * 50 + [(9, "same")] * 3
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id bigint, text string, shard int")
    for some, n, buckets in ((docs, 8, 16), (docs, 3, 256), (docs.limit(2), 8, 16), (docs.where("doc_id = 350"), 8, 4)):
        got = assign_shards(some, shards=n, buckets=buckets).collect()
        assert len(got) == some.count()
        total, sizes = sum(r.size for r in got), [0] * n
        for r in got:
            sizes[r.shard] += r.size
            assert r.size == len((r.text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((r.text or "").encode())
        assert all(abs(x - total / n) <= max(r.size for r in got) for x in sizes)
        for k in range(n):
            assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
        order = [-1 if r.doc_id is None else r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))]
        assert order == sorted(order)
    assert assign_shards(docs.limit(0)).count() == 0


def test_events_fold_into_messages(spark):
    log = [
        (1, 0, "u1", "message", "user", "hi <|turn|> \\"), (1, 1, "a1", "delta", "assistant", "He"), (1, 2, "a1", "delta", None, "llo"), (1, 3, "u2", "message", "user", "more"),
        (1, 4, "a2", "message", "assistant", "old answer"), (1, 5, "a1", "regenerate", None, "New "), (1, 6, "a1", "delta", None, "reply"), (1, 7, "u3", "message", "user", "typo"),
        (1, 8, "u3", "edit", None, "fixed"), (1, 9, "a3", "message", "assistant", None), (1, 10, "u4", "message", "user", "x"), (1, 11, "u4", "delete", None, None), (1, 12, "u1", "like", None, "no"),
        (2, 0, "m", None, None, "role unknown"), (None, 0, "m", "message", "assistant", "no id"),
    ]
    ev = spark.createDataFrame(log, "conv_id bigint, seq bigint, message_id string, op string, role string, text string")
    m = reconstruct(ev)
    got = [(r.role, r.text) for r in m.where("conv_id = 1").orderBy("n").collect()]
    assert got == [("user", "hi <|turn|> \\"), ("assistant", "New reply"), ("user", "fixed"), ("assistant", "")]
    back = {r.conv_id: r for r in read_back(render(m)).collect()}
    assert back[1].n_turns == 4 and back[1].loss_chars == len("New reply") and back[2].n_turns == 1 and back[None].loss_chars == 5
    assert read_back(render(reconstruct(ev.limit(0)))).count() == 0


def test_chat_digests_of_hostile_rows(spark, tmp_path):
    import hashlib

    rng = random.Random(1)
    rows = [(c % 7, t % 5, rng.choice(["user", "assistant", "<|", "a\\", None]), "".join(rng.choice(["<|", "|>", "\\", "<", "|", "turn", "text", "end", "\n", "é", "😀"]) for _ in range(rng.randint(0, 9))) if t % 9 else None) for c, t in ((rng.randint(0, 9), rng.randint(0, 30)) for _ in range(300))]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("op", F.lit("z")).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in op8_chat_format(spark, str(tmp_path)).collect()}
    for c in {r[0] for r in rows}:
        # Equal turns go by role (null last), then text (null first).
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1], r[2] is None, r[2] or "", r[3] is not None, (r[3] or "").encode()))
        told = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert (got[c].n_turns, got[c].loss_chars) == (len(mine), len(loss))
        assert got[c].turns_sha256 == hashlib.sha256(told.encode()).hexdigest() and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert got[-7].n_turns == 2 and got[-7].loss_chars == 26
