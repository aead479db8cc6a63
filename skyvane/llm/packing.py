"""Best-fit-decreasing packing of tokenised documents into sequences.

Pieces of one length are interchangeable, so best-fit decreasing over all pieces depends only on how many there are of
each length: at most ``capacity`` counts, whatever the corpus. ``plan`` runs it over these counts with a segment tree
over the remaining capacities that finds the tightest open bin in logarithmic time, and writes down runs: the ranks
r .. r + bins * each of a length go to bins b .. b + bins. Executors give each piece its rank in its length and look its
run up. Ranks are counted in parts of a length, dealt by row, so many that no part has much over 1 / PARTS of all pieces:
a length or a text that a third of all pieces have is no hot key, and there are at most PARTS + capacity parts.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, slices, table

PARTS = 8192
SHIFT = 44
#: Runs of one kind of character that tiktoken merges in quadratic time; the tokenizers library does not.
LONG = re.compile(r"\S{2000}|\s{2000}")


class Ids:
    """Token ids by a ``tokenizers`` file. With the same vocabulary as tiktoken ranks beside it, most texts are encoded by
    tiktoken, which gives the same ids several times faster; texts that hold a special token's string or very long
    unbroken runs go to the tokenizers library itself."""

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("same", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if self.fast is None or any(s in text for s in self.special) or len(text) >= 2000 and LONG.search(text):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())


@lru_cache(maxsize=2)
def ids(path: str, ranks: str | None, pattern: str | None) -> Ids:
    return Ids(path, ranks, pattern)


class Tightest:
    """Segment tree over remaining capacities: which is the least, at or above a length, that an open bin has?"""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.size)

    def set(self, at: int, on: bool) -> None:
        i = at + self.size
        self.any[i] = on
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def at_least(self, low: int) -> int | None:
        i = low + self.size
        if self.any[i]:
            return low
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Runs (length, first rank, bins, first bin, offset) of best-fit decreasing over ``counts`` pieces of each length.

    A tightest bin stays the tightest while a further piece of the same length fits, so it takes as many as fit before
    the next bin; equal bins do so alike and are kept as intervals of bin numbers.
    """
    tree, open_bins, runs, bins = Tightest(capacity), [[] for _ in range(capacity + 1)], [], 0

    def keep(room: int, first: int, n: int) -> None:
        if room and n:
            open_bins[room].append((first, n))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.at_least(length)
            if room is None:
                room, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = open_bins[room].pop()
                if not open_bins[room]:
                    tree.set(room, False)
            each = room // length
            full = min(n, left // each)
            if full:
                runs.append((length, rank, full, first, capacity - room))
                rank, left = rank + full * each, left - full * each
                keep(room - each * length, first, full)
            if left and full < n:  # fewer than fill one bin
                runs.append((length, rank, 1, first + full, capacity - room))
                keep(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            keep(room, first + full, n - full)
    return np.array(runs, np.int64).reshape(-1, 5)


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document of n tokens: whole, or in full pieces after a first one with what is over."""
    first = n % capacity or capacity
    return [(0, min(n, first))] + [(s, capacity) for s in range(first, n, capacity)]


def cut_pieces(docs: DataFrame, path: str, capacity: int, end: int, id_col: str, text: str, ranks: str | None, pattern: str | None, with_ids: bool) -> DataFrame:
    src = docs.select(id_col, F.col(text).alias("__text__"))
    kind = src.schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = ids(path, ranks, pattern)
        for batch in batches:
            for part in slices(batch, "__text__"):
                row, piece, start, length, crc, held = [], [], [], [], [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    a = np.append(enc.encode(t or ""), np.uint32(end)).astype("<u4")
                    for p, (s, n) in enumerate(pieces_of(len(a), capacity)):
                        row.append(i)
                        piece.append(p)
                        start.append(s)
                        length.append(n)
                        crc.append(zlib.crc32(a[s : s + n].tobytes()))
                        if with_ids:
                            held.append(a[s : s + n].astype(np.int32))
                cols = [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = [id_col, "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array(held, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return src.mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0, id_col: str = "doc_id", text: str = "text", ranks: str | None = None, pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids], sequence_id, offset): a row per piece of every document.

    A document is its text's ids and then ``end``; null and empty texts are that one id. Documents longer than
    ``capacity`` are cut into full pieces after a first one with the rest. Every piece lies whole in one sequence,
    pieces of a sequence without gaps from offset 0. Repeated and null ids are so many documents; an empty table gives
    no rows. Other columns are not returned. ids_crc32 is over the ids as little-endian unsigned 32-bit numbers.
    """
    made = cut(cut_pieces(docs, path, capacity, end, id_col, text, ranks, pattern, with_ids))
    made = made.withColumn("__row", F.monotonically_increasing_id())  # fixed by what was written
    # At most ``capacity`` counts come to the driver, and then those of at most PARTS + capacity parts.
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, total = plan(counts, capacity), max(1, sum(counts.values()))
    salts = docs.sparkSession.createDataFrame([(n, -(-c * PARTS // total)) for n, c in counts.items()], "length bigint, __salts bigint")
    made = made.join(F.broadcast(salts), "length").withColumn("__salt", F.pmod("__row", "__salts")).drop("__salts")
    parts = sorted((r["length"], r["__salt"], r["n"]) for r in made.groupBy("length", "__salt").agg(F.count("*").alias("n")).collect())
    part = np.array(parts, np.int64).reshape(-1, 3)
    upto = np.cumsum(part[:, 2]) - part[:, 2]
    first = upto - (upto[np.searchsorted(part[:, 0], part[:, 0], "left")] if len(part) else 0)  # pieces of the length in the parts before
    rank = F.row_number().over(Window.partitionBy("length", "__salt").orderBy("__row")) - 1
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    sent = docs.sparkSession.sparkContext.broadcast((runs, part[:, 0] << SHIFT | part[:, 1], first))
    names = [id_col, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.select(*names).schema) + ", sequence_id bigint, offset bigint"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, salted, before = sent.value
        keys = run[:, 0] << SHIFT | run[:, 1]
        for b in batches:
            length, salt, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "__salt", "__rank"))
            rank = rank + before[np.searchsorted(salted, length << SHIFT | salt)]
            r = run[np.searchsorted(keys, length << SHIFT | rank, "right") - 1]
            nth = rank - r[:, 1]
            new = [pa.array(r[:, 3] + nth % r[:, 2]), pa.array(r[:, 4] + nth // r[:, 2] * length)]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in names] + new, names=[*names, "sequence_id", "offset"])

    return made.withColumn("__rank", rank).select(*names, "__salt", "__rank").mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token ids of each sequence, from pieces packed ``with_ids``; at most capacity ids a row."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return rows.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))


def byte_bpe() -> dict:
    """Arguments of ``pack`` for the byte-level vocabulary of 50,257."""
    import public_tokenizers as p

    return {"path": p.path("byte_bpe_50k.json"), "ranks": p.path("byte_bpe_50k.tiktoken"), "pattern": p.PATTERN}


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document with their sequence and place; nulls, repeated rows and empty tables as in ``pack``."""
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), **byte_bpe())
