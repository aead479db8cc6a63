"""Vectors as short codes: product quantisation by exact integer k-means with partial-distance search.

A vector is cut into equal parts, and each part position has a codebook. The nearest entry is found dimension by
dimension, in descending variance of the codebook: accumulated squared differences only grow, so a (vector, entry) pair
is dropped as soon as its sum strictly exceeds the vector's best complete distance so far. What is left is exact, ties
included. Only codebooks, their sums and 256 starting ids come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: A sum of squared differences, and a sum of components, stay below this.
LARGEST = 2**62


def integers(lists: pa.Array, scale: int, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(mask of rows kept, their vectors floor(scale * x) as longs filled with zeros to ``width``). Null vectors and those
    with a null or non-finite component are not kept. Components too large for exact sums raise."""
    ok = lists.is_valid().to_numpy(zero_copy_only=False).copy()
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(n)), n)
    ok[row[~np.isfinite(flat)]] = False
    width = int(n[ok].max(initial=0)) if width is None else width
    flat = np.floor(np.where(np.isfinite(flat), flat, 0) * scale)
    if len(flat) and max(1, width) * (2 * np.abs(flat[ok[row]]).max(initial=0)) ** 2 >= LARGEST:
        raise OverflowError("components are too large for exact distances")
    out = np.zeros((len(n), width), np.int64)
    mine = ok[row]
    out[row[mine], (np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n))[mine]] = flat[mine]
    return ok, out[ok]


def nearest(x: np.ndarray, book: np.ndarray, block: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) for each row of x; ties go to the lower index. All in longs."""
    order = np.argsort(-book.var(axis=0), kind="stable")
    x, c = np.ascontiguousarray(x[:, order]), np.ascontiguousarray(book[:, order])
    n, d = x.shape
    if not d:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    # The entry next to a row in the first dimension gives its first complete distance.
    along = np.argsort(c[:, 0], kind="stable")
    code = along[np.minimum(np.searchsorted(c[along, 0], x[:, 0]), len(c) - 1)]
    best = ((x - c[code]) ** 2).sum(axis=1)
    for at in range(0, len(c), block):
        part = c[at : at + block]
        total = (x[:, :1] - part[:, 0]) ** 2
        r, e = np.nonzero(total <= best[:, None])
        total = total[r, e]
        for j in range(1, d):
            total += (x[r, j] - part[e, j]) ** 2
            keep = total <= best[r]
            if not keep.all():
                r, e, total = r[keep], e[keep], total[keep]
        e += at
        first = np.lexsort((e, total, r))
        first = first[np.r_[True, r[first][1:] != r[first][:-1]]] if len(r) else first
        r, e, total = r[first], e[first], total[first]
        better = (total < best[r]) | ((total == best[r]) & (e < code[r]))
        code[r[better]], best[r[better]] = e[better], total[better]
    return code, best


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def starts(vectors: DataFrame, entries: int, scale: int, id_col: str, vec_col: str) -> tuple[int, np.ndarray]:
    """(longest kept vector, the vectors of the ``entries`` smallest kept ids, ascending); of a repeated id the least vector."""

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, width = np.zeros(0, np.int64), -1
        for b in sliced(batches):
            ok, x = integers(b.column(1), scale)
            width = max(width, x.shape[1] if ok.any() else -1)
            mine = b.column(0).filter(pa.array(ok)).drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
            least = np.unique(np.concatenate([least, mine]))[:entries]
        if width >= 0:
            yield pa.RecordBatch.from_arrays([pa.array([*least.tolist(), None], pa.int64()), pa.array([width] * (len(least) + 1), pa.int32())], names=["id", "width"])

    both = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("v"))
    seen = cut(both.mapInArrow(ids, "id bigint, width int"))
    width = seen.agg(F.max("width")).first()[0] or 0
    first = [r[0] for r in seen.where("id is not null").select("id").distinct().orderBy("id").limit(entries).collect()]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            ok, x = integers(b.column(1), scale, width)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), pa.array(x.tolist(), pa.list_(pa.int64()))], names=["id", "v"])

    rows = both.where(F.col("id").isin(first)).mapInArrow(whole, "id bigint, v array<bigint>").groupBy("id").agg(F.min("v").alias("v")).orderBy("id").collect() if first else []
    return width, np.array([r["v"] for r in rows], np.int64).reshape(len(rows), width)


def part_sums(vectors: DataFrame, books: np.ndarray, scale: int, vec_col: str) -> list:
    """Rows (part, entry, n, sum of each component) over all vectors, at most a row for each part and entry."""
    parts, _, d = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((*books.shape[:2], d + 1), np.int64)
        for b in sliced(batches):
            _, x = integers(b.column(0), scale, parts * d)
            for p in range(parts if len(x) else 0):
                mine = x[:, p * d : p * d + d]
                code, _ = nearest(mine, books[p])
                order = np.argsort(code, kind="stable")
                heads = np.flatnonzero(np.r_[True, np.diff(code[order]) > 0])
                at = code[order][heads]
                total[p, at, 0] += np.diff(np.r_[heads, len(order)])
                total[p, at, 1:] += np.add.reduceat(mine[order], heads, axis=0)
        p, e = np.nonzero(total[:, :, 0])
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), *map(pa.array, total[p, e].T)], names=["part", "entry", *names])

    names = ["n", *(f"s{i}" for i in range(d))]
    out = vectors.select(vec_col).mapInArrow(run, ", ".join(f"{c} bigint" for c in ["part", "entry", *names]))
    return out.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in names]).collect()


def train(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> np.ndarray:
    """Codebooks (parts, entries, components), by ``rounds`` rounds over all vectors; entries without a vector stay."""
    width, first = starts(vectors, entries, scale, id_col, vec_col)
    d = -(-width // parts)
    first = np.pad(first, ((0, 0), (0, parts * d - width)))
    books = np.ascontiguousarray(first.reshape(len(first), parts, d).transpose(1, 0, 2))
    for _ in range(rounds if books.size else 0):
        for r in part_sums(vectors, books, scale, vec_col):
            books[r["part"], r["entry"]] = np.array(r[3:], np.int64) // r["n"]
    return books


def compress(vectors: DataFrame, books: np.ndarray, scale: int = 1024, vec_col: str = "embedding") -> DataFrame:
    """Columns of vectors but the vector, with code (two hex digits a part) and error (squared distances summed)."""
    parts, n, d = books.shape
    keep = [c for c in vectors.columns if c not in (vec_col, "code", "error")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.select(*keep).schema] + ["code string", "error bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            ok, x = integers(b.column(b.num_columns - 1), scale, parts * d)
            code, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts if n else 0):
                at, far = nearest(x[:, p * d : p * d + d], books[p])
                code[:, p], error = at, error + far
            text, mask = code.tobytes().hex(), pa.array(ok)
            codes = pa.array([text[i : i + 2 * parts] if n else None for i in range(0, 2 * parts * len(x), 2 * parts)], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(i).filter(mask) for i in range(len(keep))), codes, pa.array(error if n else [None] * len(x), pa.int64())], names=[*keep, "code", "error"])

    return vectors.select(*keep, vec_col).mapInArrow(run, schema)


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def coded(vectors: DataFrame, label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Columns of the kept vectors, with code, error, label_error and codebooks_sha256.

    Vectors null, or with a null or non-finite component, go. The width is that of the longest kept vector, filled up to
    equal parts; missing components of shorter ones count as 0. Fewer vectors than entries give shorter codebooks. A row
    with a null id is coded but starts no entry; without any id there is no codebook, and code and error are null. Of a
    repeated id the least vector starts; rows alike are so many rows. Null labels are one label. An empty table gives no
    rows. Columns named like a new one give way. Components so large that distances pass 62 bits raise. At most 256 entries.
    """
    if not 1 <= entries <= 256:
        raise ValueError("codes have two hex digits a part: 1 to 256 entries")
    books = train(vectors, parts, entries, rounds, scale, id_col, vec_col)
    kept = cut(compress(vectors.drop("label_error", "codebooks_sha256"), books, scale, vec_col))
    # One row a label, written before it is joined: a label with very many rows is exchanged and can be split.
    sums = cut(kept.groupBy(F.col(label).alias("__label")).agg(F.sum("error").alias("label_error")))
    return kept.join(sums, kept[label].eqNullSafe(sums["__label"])).drop("__label").withColumn("codebooks_sha256", F.lit(books_sha256(books)))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of every vector in four parts of 256 entries after four rounds; odd rows as in ``coded``."""
    return coded(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _sql(rounds: int = 4) -> str:
    near = lambda i: f"""
a{i} AS MATERIALIZED (SELECT rid, part, first(x) AS x, min({{'d': d, 'e': e}}) AS m FROM (
  SELECT p.rid, p.part, p.x, c.e, list_sum([(p.x[i] - c.c[i]) * (p.x[i] - c.c[i]) FOR i IN range(1, len(p.x) + 1)])::BIGINT AS d FROM p JOIN c{i} c USING (part)) GROUP BY 1, 2)"""  # noqa: E731
    step = lambda i: f""",
s{i} AS (SELECT part, m.e AS e, k, sum(v)::BIGINT AS s, count(*) AS n FROM (SELECT part, m, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS k FROM a{i}) GROUP BY 1, 2, 3),
u{i} AS (SELECT part, e, list((s - ((s % n) + n) % n) // n ORDER BY k) AS c FROM s{i} GROUP BY 1, 2),
c{i + 1} AS MATERIALIZED (SELECT c.part, c.e, coalesce(u.c, c.c) AS c FROM c{i} c LEFT JOIN u{i} u USING (part, e)),"""  # noqa: E731
    chain_ = "".join(near(i) + step(i) for i in range(rounds)) + near(rounds)
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS MATERIALIZED (SELECT rid, vec_id, part, v[part * (len(v) // 4) + 1 : (part + 1) * (len(v) // 4)] AS x FROM v, range(4) r(part)),
c0 AS MATERIALIZED (SELECT part, e, c FROM (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, min(x) AS c FROM p WHERE vec_id IS NOT NULL GROUP BY part, vec_id) WHERE e < 256),{chain_},
codes AS (SELECT rid, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY 1),
book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM v JOIN codes USING (rid), book"""


OP12_SQL = _sql()
