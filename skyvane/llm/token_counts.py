"""Token counts by whole-token shortcut.

A sentencepiece BPE model merges symbols of the whole text, yet no merge can cross a place that no vocabulary string
spans. ``PieceCounter`` reads the vocabulary once and proves two such places: before a word mark that follows another
character, and around a line feed. It also proves, with the library itself, which vocabulary strings encode alone as
one token. Texts are then cut into pre-tokens; those of the proven set count one, and only the rest are merged by the
library, each distinct one once while it stays in a bounded memo.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, table

MARK = "▁"
MEMO = 400_000


class PieceCounter:
    """count(text) equals len(processor.encode(text)) for every text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.sp = SentencePieceProcessor(model_file=path)
        n = self.sp.get_piece_size()
        ids = [i for i in range(n) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) or self.sp.is_unused(i))]
        pieces = [self.sp.id_to_piece(i) for i in ids]
        # Words may be cut apart where no piece has a word mark after another character.
        self.cuts_words = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        self.cuts_lines = not any("\n" in p for p in pieces)
        # The model must leave the text as it is but for one mark in front: checked on the characters that could matter.
        probe = "a  b\tc \n d\r\n éﬁ "
        self.plain = self.sp.decode(self.sp.encode(probe)) == probe and self.sp.encode_as_pieces("ab")[0].startswith(MARK)
        self.memo: dict[str, int] = {}
        self.bare_memo: dict[str, int] = {}
        self.one: set[str] = set()
        if self.exact_cuts:
            words = [p[1:] for p in pieces if p.startswith(MARK) and MARK not in p[1:] and len(p) > 1]
            self.one = {w for w, got in zip(words, self.sp.encode(words, num_threads=1), strict=True) if len(got) == 1}

    @property
    def exact_cuts(self) -> bool:
        return self.cuts_words and self.cuts_lines and self.plain

    def merged(self, pre: str) -> int:
        """Tokens of a pre-token given without its word mark."""
        n = self.memo.get(pre)
        if n is None:
            n = len(self.sp.encode(pre, num_threads=1))
            self.keep(self.memo, pre, n)
        return n

    def bare(self, pre: str) -> int:
        """Tokens of a pre-token that follows a line feed and so has no word mark."""
        n = self.bare_memo.get(pre)
        if n is None:  # the library puts a mark before the line feed: one token for it, one for the line feed
            n = len(self.sp.encode("\n" + pre, num_threads=1)) - 2
            self.keep(self.bare_memo, pre, n)
        return n

    @staticmethod
    def keep(memo: dict[str, int], pre: str, n: int) -> None:
        if len(memo) >= MEMO:
            memo.clear()
        if len(pre) <= 200:
            memo[pre] = n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.exact_cuts:
            return len(self.sp.encode(text, num_threads=1))
        one, memo, merged = self.one, self.memo, self.merged
        total = 0
        if MARK in text:
            text = text.replace(MARK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            words = re.findall(" *[^ ]+| +$", " " + text)
            words = [w[1:] for w in words]
        else:
            words = text.split(" ")
        for w in words:
            if w in one or not w:  # nothing after the mark: the mark itself
                total += 1
            elif (n := memo.get(w)) is not None:
                total += n
            elif "\n" in w:
                head, *rest = w.split("\n")
                total += (merged(head) if head else 1) + len(rest)
                total += sum(map(self.bare, filter(None, rest)))
            else:
                total += merged(w)
        return total


class JsonCounter:
    """Counts by a ``tokenizers`` file, text by text, by that library itself."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)

    def count(self, text: str) -> int:
        return len(self.tok.encode(text, add_special_tokens=False).ids) if text else 0


@lru_cache(maxsize=4)
def counter(path: str) -> PieceCounter | JsonCounter:
    return PieceCounter(path) if path.endswith(".model") else JsonCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, text: str = "text") -> DataFrame:
    """Every column of docs but the text, with n_bytes, n_tokens and over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and 0 tokens. Each row is counted by itself, repeated ids and texts alike; an
    empty table gives an empty table. Columns of docs that have a new column's name are replaced. One narrow pass, no shuffle.
    """

    def run(texts: list[str]) -> dict:
        c = counter(path)
        n = [c.count(t) for t in texts]
        return {"n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return map_texts(docs, run, [("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")], text)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and token counts of every document; nulls, empty texts, repeated rows and extra columns as in ``count_tokens``."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
