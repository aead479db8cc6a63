"""Benchmark decontamination by suffix arrays of the training documents.

The documents are cut into shards (bounded slices of Arrow batches). A shard's words become numbers, equal words equal
numbers, and its suffix array orders the starts of all its suffixes. Words that occur in no benchmark item share the
number 0, at which every match ends, so suffixes that begin with it are left out. Every test suffix is binary-searched
in every shard's array as deep as a window; its run of equal neighbours are its occurrences. An occurrence is continued
along its diagonal, where the next suffix of the same item occurs at the next word, to the longest verbatim match, which
no word on either side extends. Numbers are packed five to a word for comparison: the array is ordered by the first
packed word, and where a test suffix's run in it is longer than five words it is ordered further, so only parts that a
search reaches are ever compared to full depth.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, slices, table

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PACK = 5
BITS = 12
#: Bytes of test text that are sent to the executors at once; a larger test set is searched block by block.
BLOCK = 16_000_000


def words(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode().lower()) if text else []  # bytes: lower() is A-Z only


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), first[1], ..."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


class TestSet:
    """Distinct test windows of one block in order, with all their places: ``window`` words from each start of an item,
    or all words of a shorter item."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.window = window
        texts = [(i, w) for i, t in items if (w := words(t))]
        self.items = sorted({i for i, _ in texts})
        at = {i: n for n, i in enumerate(self.items)}
        self.item = np.array([at[i] for i, _ in texts], np.int64)  # of each row of the block
        self.vocab: dict[bytes, int] = {}
        flat = np.array([self.vocab.setdefault(x, len(self.vocab) + 1) for _, w in texts for x in w], np.int64)
        size = np.array([len(w) for _, w in texts], np.int64)
        count = np.maximum(1, size - window + 1)
        row = np.repeat(np.arange(len(size)), count)
        start = ranges(np.zeros(len(size), np.int64), count)
        place, length = np.repeat(np.cumsum(size) - size, count) + start, np.minimum(size[row], window)
        self.bits = max(BITS, (len(self.vocab) + 1).bit_length())
        self.per = min(PACK, 62 // self.bits)
        self.parts = -(-window // self.per)
        low, high = np.zeros((2, self.parts, len(place)), np.int64)
        for j in range(self.parts * self.per):
            inside = j < length
            word = np.where(inside, flat[np.where(inside, place + j, 0)], 0) if len(flat) else place
            p = j // self.per
            low[p] = low[p] << self.bits | word
            high[p] = high[p] << self.bits | np.where(inside, word, (1 << self.bits) - 1)
        order = np.lexsort((start, row, *high[::-1], *low[::-1]))
        low, high = low[:, order], high[:, order]
        new = np.r_[True, (low[:, 1:] != low[:, :-1]).any(axis=0) | (high[:, 1:] != high[:, :-1]).any(axis=0)] if len(order) else np.zeros(0, bool)
        heads = np.flatnonzero(new)
        self.low, self.high, self.lengths = low[:, heads].T, high[:, heads].T, length[order][heads]
        self.row, self.start = row[order], start[order]  # places, those of window w from first[w] on
        self.first = np.r_[heads, len(order)]


class SuffixArray:
    """Suffixes of a shard's numbers, ordered by their first ``per`` numbers, and deeper where searches go."""

    def __init__(self, ids: np.ndarray, test: TestSet):
        self.test = test
        padded = np.concatenate([ids, np.zeros(test.per, np.int64)])
        key = np.zeros(len(ids), np.int64)
        for j in range(test.per):
            key = key << test.bits | padded[j : j + len(ids)]
        self.key = np.concatenate([key, np.zeros(test.parts * test.per, np.int64)])
        starts = np.flatnonzero(ids > 0)
        order = np.argsort(key[starts], kind="stable")
        self.order = starts[order]
        self.sorted = key[self.order]

    def search(self) -> Iterator[tuple[int, np.ndarray]]:
        """(test window, its starts in the shard) for the windows that occur."""
        t = self.test
        if not len(t.low):
            return
        lo = np.searchsorted(self.sorted, t.low[:, 0], "left")
        hi = np.searchsorted(self.sorted, t.high[:, 0], "right")
        refined: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]] = {}
        for w in np.flatnonzero(hi > lo):
            run, at = self.order[lo[w] : hi[w]], (int(lo[w]), int(hi[w]), 0)
            for p in range(1, -(-int(t.lengths[w]) // t.per)):
                if at not in refined:
                    deep = self.key[run + p * t.per]
                    o = np.argsort(deep, kind="stable")
                    refined[at] = run[o], deep[o]
                run, deep = refined[at]
                a, b = np.searchsorted(deep, t.low[w, p], "left"), np.searchsorted(deep, t.high[w, p], "right")
                run, at = run[a:b], (at[0] + int(a), at[0] + int(b), p)
                if not len(run):
                    break
            if len(run):
                yield int(w), run


def occurrences(texts: list[list[bytes]], test: TestSet, most: int = 1_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The offset of each document in the shard, and of every occurrence its first word's place in the shard and its window."""
    ends = np.cumsum([len(w) + 1 for w in texts])  # a 0 stands between documents
    starts = np.r_[0, ends[:-1]]
    ids, get = np.zeros(int(ends[-1]), np.int64), test.vocab.get
    for s, w in zip(starts, texts, strict=True):
        ids[s : s + len(w)] = [get(x, 0) for x in w]
    none = np.zeros(0, np.int64)
    place, window = [none], [none]
    for at in range(0, len(ids), most):  # a long shard is cut, with the overlap that windows need
        for w, run in SuffixArray(ids[at : at + most + test.window - 1], test).search():
            run = run[run < most] + at
            place.append(run)
            window.append(np.full(len(run), w))
    return starts, np.concatenate(place), np.concatenate(window)


def longest_matches(place: np.ndarray, window: np.ndarray, test: TestSet) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of the block, its first word, first word's place in the shard, words) of all matches that no word extends."""
    count = test.first[window + 1] - test.first[window]
    owner = ranges(test.first[window], count)
    place, length = np.repeat(place, count), np.repeat(test.lengths[window], count)
    row, start = test.row[owner], test.start[owner]
    order = np.lexsort((place, place - start, row))
    row, start, place, length = row[order], start[order], place[order], length[order]
    follows = (row[1:] == row[:-1]) & (place[1:] == place[:-1] + 1) & (start[1:] == start[:-1] + 1)
    head = np.flatnonzero(np.r_[True, ~follows]) if len(row) else np.zeros(0, np.int64)
    size = np.diff(np.r_[head, len(row)]) - 1
    return row[head], start[head], place[head], length[head] + size


def test_blocks(bench: DataFrame, id_col: str, text: str, size: int) -> Iterator[list[tuple[str, str]]]:
    """The test items in blocks of at most ``size`` bytes of text, read partition by partition; at least one block."""
    block, held = [], 0
    for r in bench.where(F.col(text).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("string"), text).toLocalIterator():
        if block and held + len(r[1]) > size:
            yield block
            block, held = [], 0
        block.append((r[0], r[1]))
        held += len(r[1])
    yield block


MATCH = pa.struct([("item", pa.string()), ("item_start", pa.int64()), ("start", pa.int64()), ("length", pa.int64())])
KINDS = {"n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(), "longest": pa.int64(), "items": pa.list_(pa.string()), "matches": pa.list_(MATCH), "__hit": pa.list_(pa.int64())}


def search_block(docs: DataFrame, block: list[tuple[str, str]], window: int, text: str, own: list[str], more: bool) -> DataFrame:
    """docs with what the block adds to the columns ``own`` (made, where docs lack them), and the hit words if more blocks follow."""
    sent = docs.sparkSession.sparkContext.broadcast(TestSet(block, window))
    given = {c for c in own if c in docs.columns}
    keep = [c for c in docs.columns if c not in (*own, "__hit")]
    new = own + ["__hit"] * more
    spark_type = {"items": "array<string>", "matches": "array<struct<item:string,item_start:bigint,start:bigint,length:bigint>>", "__hit": "array<bigint>"}
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema] + [f"`{c}` {spark_type.get(c, 'bigint')}" for c in new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = sent.value
        for batch in batches:
            for part in slices(batch, text):
                before = {c: part.column(part.schema.get_field_index(c)).to_pylist() for c in part.schema.names if c in given or c == "__hit"}
                texts = [words(t) for t in part.column(part.schema.get_field_index(text)).to_pylist()]
                starts, place, of = occurrences(texts, test)
                doc = lambda at: np.searchsorted(starts, at, "right") - 1  # noqa: E731, B023
                edge = np.zeros(int(starts[-1]) + len(texts[-1]) + 2, np.int64)
                np.add.at(edge, place, 1)
                np.add.at(edge, place + test.lengths[of], -1)
                hit = np.cumsum(edge[:-1]) > 0
                for d, places in enumerate(before.get("__hit", ())):
                    hit[np.array(places, np.int64) + starts[d]] = True
                row, first, at, length = longest_matches(place, of, test)
                d = doc(at)
                longest = np.array(before.get("longest", [0] * len(texts)), np.int64)
                np.maximum.at(longest, d, length)
                items = [set(x) for x in before["items"]] if before else [set() for _ in texts]
                for i, k in np.unique(np.stack([d, test.item[row]], axis=1), axis=0).tolist():
                    items[i].add(test.items[k])
                out = {
                    "n_words": [len(w) for w in texts], "n_hit": np.add.reduceat(hit.astype(np.int64), starts),
                    "n_items": [len(x) for x in items], "longest": longest, "items": [sorted(x) for x in items],
                }
                if "matches" in own:
                    out["matches"] = before["matches"] if before else [[] for _ in texts]
                    for i, r, f, a, n in zip(d.tolist(), row.tolist(), first.tolist(), at.tolist(), length.tolist(), strict=True):
                        out["matches"][i].append({"item": test.items[test.item[r]], "item_start": f, "start": a - int(starts[i]), "length": n})
                    out["matches"] = [sorted(m, key=lambda x: (x["item"], x["start"], x["item_start"], x["length"])) for m in out["matches"]]
                if more:
                    out["__hit"] = [np.flatnonzero(hit[s : s + len(w)]) for s, w in zip(starts, texts, strict=True)]
                kept = [part.column(part.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(out[c], KINDS[c]) for c in new)], names=[*keep, *new])

    return docs.mapInArrow(run, schema)


def find_overlaps(docs: DataFrame, bench: DataFrame, window: int = 10, id_col: str = "item_id", text: str = "text", block: int = BLOCK, spans: bool = False) -> DataFrame:
    """Every column of docs with n_words, n_hit, n_items, longest (words of the longest verbatim match) and items, an array
    of the ids (as text, sorted) of the items met.

    A test window is ``window`` consecutive words of an item, or all words of an item with fewer; a document word inside
    any occurrence counts once in n_hit. With ``spans`` an array matches of (item, item_start, start, length) follows,
    in words from 0: every verbatim match of at least a window that no word on either side extends, so a run of equal
    words matches at many offsets. Null and empty texts have no words and no hits; test items with null id or no words
    take no part, items alike are all named. Rows are treated one by one, so repeated ids are so many rows; columns of
    docs named like a new one are replaced. No shuffle: a test set within ``block`` bytes of text goes to the executors
    whole; a larger one block by block, with the documents and what was found written to the shared folder in between.
    """
    own = ["n_words", "n_hit", "n_items", "longest", "items"] + ["matches"] * spans
    out = docs.select(*[c for c in docs.columns if c not in (*own, "__hit")])
    blocks = test_blocks(bench, id_col, text, block)
    held = next(blocks)
    for after in blocks:
        out, held = cut(search_block(out, held, window, text, own, True)), after
    return search_block(out, held, window, text, own, False)


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = 10) -> DataFrame:
    """docs without the rows that hold a test window, every column as it was, also those named like a result. Null and
    empty texts stay, copies go or stay together, an empty test set or table removes nothing."""
    named = docs.toDF(*[c if c == "text" else f"__own_{c}" for c in docs.columns])
    found = find_overlaps(named, bench, window).where("n_hit = 0").select(*named.columns)
    return found.toDF(*docs.columns)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document; nulls, repeated rows and short items as in ``find_overlaps``. ``longest`` is the
    longest verbatim match in words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = find_overlaps(docs, table(spark, sf_dir, "benchmark"))
    ids = F.array_join("items", ",")
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "longest")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT row_number() OVER () AS r, item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
b AS (SELECT r, item_id, t, least(len(w), 10) AS n, array_to_string(w[t:t + 9], ' ') AS k FROM (SELECT r, item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t FROM i WHERE len(w) > 0)),
p AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM b)),
h AS (SELECT p.doc_id, p.s, p.n, b.item_id, b.r, b.t FROM p JOIN b ON b.n = p.n AND b.k = array_to_string(p.w[p.s:p.s + p.n - 1], ' ')),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS x FROM h) GROUP BY 1),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1),
g AS (SELECT doc_id, max(longest) AS longest FROM (SELECT doc_id, count(*) + any_value(n) - 1 AS longest FROM (SELECT *, s - row_number() OVER (PARTITION BY doc_id, r, s - t ORDER BY s) AS island FROM h) GROUP BY doc_id, r, s - t, island) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest, 0)::BIGINT AS longest
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN g USING (doc_id)
"""
