"""SimHash near-duplicates by deletion-variant signatures.

A ``Cut`` says which segments of a fingerprint are indexed. Each segment is indexed under its variants with one bit
wiped out; equal variants are an equality join on (wiped bit, rest of the segment), which meets all pairs that differ
in at most one bit of a segment, and every pair met is verified on the whole fingerprint.

* ``exact_cut(4)``: two 64-bit fingerprints within 4 bits differ in at most one bit of one of 3 segments (three with 2
  differing bits each would make 6), so no link is lost.
* ``similar_cut(0.8)``: for similarities at which single bits differ too often for that, six 64-bit words or more and so
  many short segments that a pair of the given Jaccard similarity meets with probability ``recall``. The fingerprint's
  estimate of the similarity, with three standard deviations of tolerance, only proposes: what links is the similarity
  of the shingle sets themselves, compared for each proposed pair (``verified``). Segments get longer with the number of
  documents, so that the number of unlike documents that one meets by chance stays bounded.

The join is done bucket by bucket over rows sorted by signature: the many links of a bucket go out as a spanning forest,
never as all pairs. Buckets larger than ``block`` fingerprints are cut into blocks, and each pair of blocks is a bucket
of its own, so no task holds more than two blocks and no link is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, map_texts, table
from .components import components


@dataclass(frozen=True)
class Cut:
    """Number of 64-bit words, segments as (word, first bit, bits), the largest distance that links, and the similarity
    of shingle sets that a link must have as well."""

    words: int
    segments: tuple[tuple[int, int, int], ...]
    distance: int
    similarity: float | None = None

    @property
    def names(self) -> list[str]:
        return ["fp", *(f"fp{i}" for i in range(1, self.words))]


def exact_cut(distance: int = 4) -> Cut:
    """The fewest segments of 64 bits of which one has at most one of ``distance`` differing bits."""
    if distance > 12:
        raise ValueError("at more than 12 bits the segments are too short to select")
    m = max(2, distance // 2 + 1)  # two at least: a bit's number is kept above the segment
    edges = [64 * i // m for i in range(m + 1)]
    return Cut(1, tuple((0, a, b - a) for a, b in zip(edges, edges[1:], strict=False)), distance)


def similar_cut(similarity: float = 0.8, documents: int = 0, recall: float = 0.999, words: int = 6, chance: int = 200_000) -> Cut:
    """Segments for a Jaccard similarity of shingle sets: a bit differs with probability p = angle / pi. Their width is the
    least from 12 on at which one of ``documents`` unlike fingerprints meets at most ``chance`` others."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    for width in range(12, 33, 2):
        meets = (1 - p) ** width + width * p * (1 - p) ** (width - 1)
        n, each = math.ceil(math.log(1 - recall) / math.log(1 - meets)), 64 // width
        if documents * n * width * 2 / 2**width <= chance:
            break
    words = max(words, -(-n // each))
    bits = 64 * words
    places = tuple((i % words, i // words * width, width) for i in range(n))
    return Cut(words, places, math.floor(bits * p + 3 * math.sqrt(bits * p * (1 - p))), similarity)


def mixed(h: np.ndarray, word: int) -> np.ndarray:
    """Another 64-bit hash of each hash, by a multiply-xorshift finaliser; word 0 is the hash itself."""
    if not word:
        return h
    x = h + np.uint64(word * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint_words(text: str, shingle: int = 4, seed: int = 42, words: int = 1, seen: list[np.ndarray] | None = None) -> np.ndarray:
    """64 bits a word; a bit is set if it is in over half of the shingles' hashes (XXH64 for the first word). No words: 0.
    Fewer words than a shingle: all of them are one. ``seen`` takes the hashes, if given."""
    w = text.encode().lower().split()  # bytes: lower() is A-Z only, split() is at \x20 and \x09-\x0D only
    if not w:
        return np.zeros(words, np.uint64)
    k = min(shingle, len(w))
    total, count, digest = np.zeros((words, 64), np.int64), len(w) - k + 1, xxhash.xxh64_intdigest
    for at in range(0, count, 65536):
        part = w[at : at + 65536 + k - 1]
        h = np.array([digest(s, seed) for s in map(b" ".join, zip(*(part[i:] for i in range(k)), strict=False))], "<u8")
        if seen is not None:
            seen.append(h)
        for j in range(words):
            total[j] += np.unpackbits(mixed(h, j).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(2 * total > count, axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    return int(fingerprint_words(text, shingle, seed)[0])


def shingle_set(text: str, shingle: int = 4, seed: int = 42, words: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of a text's shingles in order, and its fingerprint."""
    seen = [np.zeros(0, "<u8")]
    fp = fingerprint_words(text, shingle, seed, words, seen)
    return np.unique(np.concatenate(seen)), fp


def fingerprints(docs: DataFrame, cut_: Cut, shingle: int = 4, seed: int = 42, text: str = "text") -> DataFrame:
    """docs without the text, with the words of its fingerprint (fp, fp1, ...) as signed longs; for a cut with a
    similarity also with a hash of its shingle set (__set)."""
    n = cut_.words
    own = ["__set"] if cut_.similarity is not None else []

    def run(texts: list[str]) -> dict:
        f = np.zeros((len(texts), n + len(own)), np.uint64)
        for i, t in enumerate(texts):
            if own:
                shingles, f[i, :n] = shingle_set(t, shingle, seed, n)
                f[i, n] = xxhash.xxh64_intdigest(shingles.tobytes())
            else:
                f[i] = fingerprint_words(t, shingle, seed, n)
        f = f.view(np.int64)
        return {c: pa.array(np.ascontiguousarray(f[:, i])) for i, c in enumerate([*cut_.names, *own])}

    return map_texts(docs, run, [(c, "bigint") for c in [*cut_.names, *own]], text)


def segment(cut_: Cut, i: int) -> Column:
    word, start, width = cut_.segments[i]
    return F.shiftrightunsigned(cut_.names[word], start).bitwiseAND(F.lit((1 << width) - 1))


def signatures(cut_: Cut) -> Column:
    """Array of longs: for each bit of each segment, the rest of the segment under the numbers of both."""
    out = []
    for i, (_, _, width) in enumerate(cut_.segments):
        for b in range(width):
            out.append(segment(cut_, i).bitwiseAND(F.lit(((1 << width) - 1) ^ (1 << b))).bitwiseOR(F.lit((i * 64 + b) << 40)))
    return F.array(*out)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits over all words (first axis)."""
    return np.bitwise_count(a ^ b).sum(axis=0, dtype=np.int32) if len(a) > 1 else np.bitwise_count(a[0] ^ b[0])


def forest(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning-forest edges (indices) of the links among distinct fingerprints (words, n) of one bucket, by breadth-first search."""
    a, b, left = [], [], np.arange(fp.shape[1])
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = apart(fp[:, left], fp[:, x : x + 1]) <= distance
            if near.any():
                found, left = left[near], left[~near]
                a.append(np.full(len(found), x))
                b.append(found)
                queue.extend(found)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int), np.zeros(0, int))


def nearest_tree(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (indices) of a minimum spanning forest of the links in one bucket, so that each follows nearest neighbours."""
    n = fp.shape[1]
    near, parent, left = np.full(n, 1 << 20), np.full(n, -1), np.ones(n, bool)
    for _ in range(n):
        x = int(np.where(left, near, 1 << 21).argmin())
        left[x] = False
        d = apart(fp, fp[:, x : x + 1])
        closer = left & (d < near) & (d <= distance)
        near[closer], parent[closer] = d[closer], x
    at = np.flatnonzero(parent >= 0)
    return parent[at], at


def linked(fp: np.ndarray, distance: int, tree=forest) -> tuple[np.ndarray, np.ndarray, bool]:
    """Edges that connect what links connect in a bucket, and whether these are all links: all while they are few, else a forest."""
    n = fp.shape[1]
    if n <= 512:
        i, j = np.nonzero(np.triu(apart(fp[:, :, None], fp[:, None, :]) <= distance, 1))
        if len(i) <= 2 * n:
            return i, j, True
    return *tree(fp, distance), False


def bucket_links(batches: Iterator[pa.RecordBatch], distance: int, similar: bool) -> Iterator[pa.RecordBatch]:
    """Links of all buckets in a partition sorted by (sig, pair); the last bucket of a batch waits for the next batch.

    Columns are sig, pair, the words, and for ``similar`` the node before the words, where links are given with their
    distance, and a node of a bucket of which only a forest is given as linked to itself, with distance -1; else the
    first word is the node."""
    held: list[list[np.ndarray]] = []

    def links(cols: list[np.ndarray]) -> pa.RecordBatch:
        sig, pair, node, fp = cols[0], cols[1], cols[2].view(np.uint64), np.stack(cols[3 if similar else 2 :]).view(np.uint64)
        more = [np.zeros(0, np.int64)]
        heads = np.flatnonzero(np.r_[True, (sig[1:] != sig[:-1]) | (pair[1:] != pair[:-1])])
        sizes = np.diff(np.r_[heads, len(sig)])
        run = np.repeat(np.arange(len(heads)), sizes)
        few = np.repeat(sizes <= 8, sizes)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lag in range(1, min(8, int(sizes.max(initial=1)))):
            i = np.flatnonzero((run[lag:] == run[:-lag]) & few[lag:])
            i = i[apart(fp[:, i], fp[:, i + lag]) <= distance]
            a.append(i)
            b.append(i + lag)
        for h in np.flatnonzero(sizes > 8):
            x, y, whole = linked(fp[:, heads[h] : heads[h] + sizes[h]], distance, nearest_tree if similar else forest)
            a.append(x + heads[h])
            b.append(y + heads[h])
            if not whole:
                more.append(np.unique(np.concatenate([x, y])) + heads[h])
        a, b = np.concatenate(a), np.concatenate(b)
        pairs = np.stack([node[a], node[b]], axis=1).view(np.int64)
        pairs.sort(axis=1)
        if similar:
            pairs = np.c_[pairs, apart(fp[:, a], fp[:, b])]
        pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
        if similar:
            thin = np.unique(node[np.concatenate(more)]).view(np.int64)
            pairs = np.concatenate([pairs, np.stack([thin, thin, np.full(len(thin), -1)], axis=1)])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in pairs.T.astype(np.int64)], names=["a", "b", "d"][: pairs.shape[1]])

    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(cols[0]):
            continue
        if held and (held[0][0][0], held[0][1][0]) != (cols[0][0], cols[1][0]):
            yield links([np.concatenate(c) for c in zip(*held, strict=True)])
            held = []
        last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
        split = 0 if last.all() else int(np.flatnonzero(~last)[-1]) + 1
        if split:
            yield links([np.concatenate(c) for c in zip(*held, [c[:split] for c in cols], strict=True)])
            held = []
        held.append([c[split:] for c in cols])
    if held:
        yield links([np.concatenate(c) for c in zip(*held, strict=True)])


def fingerprint_links(fps: DataFrame, cut_: Cut, block: int = 4096) -> DataFrame:
    """(a, b) first words of fingerprints: links that connect the same components as all pairs that the cut meets within
    its distance. For a cut with a similarity a and b are nodes (column node of fps), and d is the distance of the pair,
    or -1 at a node alone that may have further ones, see ``bucket_links``."""
    similar, parts = cut_.similarity is not None, int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = ["node"] * similar + cut_.names
    fps = fps.select(*cols).repartition(parts)  # what was written may be few files, and each row becomes many
    sig = fps.select(*cols, F.explode(signatures(cut_)).alias("sig"))
    # A variant's bucket is the union of two exact segment values. Of a bucket larger than a block one of them has over
    # half a block, so counting those values finds every large bucket; the other value has at most half a block more.
    seg = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(w).alias("w"), segment(cut_, i).alias("x")) for i, (_, _, w) in enumerate(cut_.segments)])
    counts = fps.select(F.explode(seg).alias("g")).groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > block // 2)
    near = counts.select("g", "n", F.explode(F.sequence(F.lit(0), F.col("g.w") - 1)).alias("b"))
    near = near.select(F.expr("shiftleft(cast(g.i * 64 + b as bigint), 40) | (g.x & ~shiftleft(1L, b))").alias("sig"), "n")
    large = cut(near.groupBy("sig").agg(F.sum("n").alias("n")).select("sig", F.ceil((F.col("n") + block // 2) * 2 / block).cast("int").alias("blocks")))
    if large.isEmpty():
        dealt = sig.select("sig", F.lit(0).alias("pair"), *cols)
    else:
        mine = F.pmod(F.xxhash64(*cut_.names), F.col("blocks")).cast("int")
        other = F.sequence(F.lit(0), F.col("blocks") - 1)
        pairs = F.transform(other, lambda j: F.least(j, F.col("mine")) * F.col("blocks") + F.greatest(j, F.col("mine")))
        dealt = sig.join(large, "sig", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("mine", mine).select("sig", F.explode(pairs).alias("pair"), *cols)
    ordered = dealt.repartition(parts, "sig", "pair").sortWithinPartitions("sig", "pair")
    distance = cut_.distance
    return ordered.mapInArrow(lambda it: bucket_links(it, distance, similar), "a bigint, b bigint" + ", d bigint" * similar)


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets (node, shingles: distinct 32-bit hashes as bytes) have the Jaccard similarity or
    more. Each row is compared by itself, so no task holds a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4")
                both = np.concatenate([x, y])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                keep.append(same >= similarity * (len(both) - same))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("a", "b")], names=["a", "b"])

    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    met = met.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return met.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def similar_groups(docs: DataFrame, fps: DataFrame, cut_: Cut, shingle: int, block: int, text: str) -> DataFrame:
    """(node, root) of the nodes (distinct shingle sets) in groups that verified links connect.

    Of the proposed pairs each node's nearest is compared first; then those that these links have not connected. In
    buckets with very many proposals only a spanning forest of them was made. A group with a proposal that was refused
    may have lost links there, so the sets of its nodes of such buckets are compared with all others of their cluster of
    proposals (``cluster_links``): then every pair that meets is linked, refused, or inside one group. The text of a
    proposed node moves once to make its set, and a set to the pairs that need it.
    """
    proposed = cut(fingerprint_links(fps, cut_, block).distinct())
    pairs, thinned = proposed.where("d >= 0"), proposed.where("d < 0").select(F.col("a").alias("node"))
    ends = pairs.select(F.col("a").alias("node"), F.col("b").alias("other"), "d").unionAll(pairs.select("b", "a", "d"))
    nearest = cut(ends.groupBy("node").agg(F.min(F.struct("d", "other")).alias("n")).select("node", "n.other"))
    texts = docs.select(F.xxhash64(F.coalesce(text, F.lit(""))).alias("__key"), F.coalesce(text, F.lit("")).alias("text"))
    run = lambda found: {"shingles": pa.array([np.unique(shingle_set(t, shingle)[0].astype("<u4")).tobytes() for t in found], pa.binary())}
    keys = small(cut(fps.join(nearest.select("node"), "node", "left_semi").select("node", "__key")))
    sets = cut(map_texts(texts.join(keys, "__key").groupBy("node").agg(F.min("text").alias("text")), run, [("shingles", "binary")]))
    first = nearest.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    links = cut(verified(first, sets, cut_.similarity))
    # Pairs whose ends have one least neighbour are connected by now; the others are compared, too.
    both = links.unionAll(links.select("b", "a"))
    star = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    rest = cut(pairs.join(first, ["a", "b"], "left_anti").select("a", "b").transform(lambda d: across(d, star.withColumnRenamed("a", "node"), "m")))
    links = links.unionAll(compared(rest, sets, cut_.similarity))
    roots = fresh(cut(components(links)))
    if thinned.isEmpty():
        return roots
    refused = across(pairs.select("a", "b"), roots, "root", keep=True)
    refused = cut(refused.select(F.explode(F.array("root_a", "root_b")).alias("root")).distinct())
    named = thinned.distinct().join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    asked = fresh(cut(named.join(refused, "root", "left_semi").select("node", "root")))
    if asked.isEmpty():
        return roots
    one = small(asked.select("node"))
    near = pairs.join(one.withColumnRenamed("node", "a"), "a", "left_semi").join(one.withColumnRenamed("node", "b"), "b", "left_semi")
    members = components(near.select("a", "b")).withColumnRenamed("root", "cluster").join(small(asked), "node")
    return components(links.unionAll(cluster_links(members, sets, fps, cut_)))


def cluster_links(members: DataFrame, sets: DataFrame, fps: DataFrame, cut_: Cut, block: int = 4096, size: int = 32_000_000) -> DataFrame:
    """(a, b): verified links that connect what all verified links between nodes of a cluster connect.

    members: node, root (what is connected already), cluster. A cluster of more than ``block`` nodes or ``size`` bytes of sets
    is cut into blocks, and each pair of blocks is compared by itself: a task holds two blocks, and a set moves once for
    each block of its cluster. Only links come out, at most one fewer than nodes.
    """
    rows = cut(members.join(sets, "node").join(fps.select("node", *cut_.names), "node"))
    blocks = F.ceil(F.greatest(F.count("*") / block, F.sum(F.octet_length("shingles")) / size)).cast("int")
    many = small(cut(rows.groupBy("cluster").agg(blocks.alias("blocks")).withColumn("blocks", F.greatest("blocks", F.lit(1)))))
    mine, other = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.sequence(F.lit(0), F.col("blocks") - 1)
    dealt = rows.join(many, "cluster").withColumn("mine", mine)
    dealt = dealt.withColumn("pair", F.explode(F.transform(other, lambda j: F.least(j, F.col("mine")) * F.col("blocks") + F.greatest(j, F.col("mine")))))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = dealt.select("cluster", "pair", "node", "root", "shingles", *cut_.names).repartition(parts, "cluster", "pair").sortWithinPartitions("cluster", "pair")
    distance, similarity = cut_.distance, cut_.similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = lambda b, i: (b.column(0)[i].as_py(), b.column(1)[i].as_py())

        def links() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            at = compare_sets([np.frombuffer(x.as_buffer(), "<u4") for x in t.column(4)], t.column(3).to_numpy(), np.stack([t.column(c).to_numpy() for c in cut_.names]).view(np.uint64), distance, similarity)
            node = t.column(2).to_numpy()
            return pa.RecordBatch.from_arrays([pa.array(node[at[:, 0]]), pa.array(node[at[:, 1]])], names=["a", "b"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                if held and key(held[0], 0) != key(batch, at):
                    yield links()
                    held = []
                c, p = (batch.column(i).to_numpy()[at:] for i in (0, 1))
                other = np.flatnonzero((c != c[0]) | (p != p[0]))
                end = at + int(other[0]) if len(other) else batch.num_rows
                held.append(batch.slice(at, end - at))
                at = end
        if held:
            yield links()

    return fresh(cut(ordered.mapInArrow(run, "a bigint, b bigint")))


def compare_sets(sets: list[np.ndarray], group: np.ndarray, fp: np.ndarray, distance: int, similarity: float) -> np.ndarray:
    """(n, 2) indices of links between sets that have the similarity, enough to connect the groups that such links connect.

    Row by row the later ones within the distance and in another group are looked at; what they share with the row is
    counted by the lists of sets that have a shingle."""
    size = np.array([len(x) for x in sets])
    _, number, times = np.unique(np.concatenate([*sets, np.zeros(0, "<u4")]), return_inverse=True, return_counts=True)
    owner, order = np.repeat(np.arange(len(sets)), size), np.argsort(number, kind="stable")
    having, ends, starts = owner[order], np.cumsum(times), np.cumsum(size) - size
    label, out = np.unique(group, return_inverse=True)[1], []
    for i in range(len(sets)):
        far = sum(np.bitwise_count(w[i] ^ w[i + 1 :]).astype(np.int16) for w in fp)
        near = np.flatnonzero((far <= distance) & (label[i + 1 :] != label[i])) + i + 1
        if not len(near):
            continue
        mine = number[starts[i] : starts[i] + size[i]]
        mine = mine[times[mine] > 1]
        lists = [having[ends[m] - times[m] : ends[m]] for m in mine]
        same = np.bincount(np.concatenate(lists), minlength=len(sets))[near] if lists else np.zeros(len(near), np.int64)
        for j in near[same >= similarity * (size[i] + size[near] - same)]:
            if label[j] != label[i]:
                out.append((i, j))
                label[label == label[j]] = label[i]
    return np.array(out, np.int64).reshape(-1, 2)


def across(pairs: DataFrame, groups: DataFrame, root: str, keep: bool = False) -> DataFrame:
    """The pairs (a, b) whose ends are in different groups (node, root); a node without one is a group of its own."""
    side = lambda c: groups.select(F.col("node").alias(c), F.col(root).alias(f"root_{c}"))
    out = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").withColumns({f"root_{c}": F.coalesce(f"root_{c}", c) for c in "ab"})
    return out.where("root_a <> root_b").select("a", "b", *["root_a", "root_b"] * keep)


def compared(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``verified`` for written pairs, moving only the sets that they need."""
    needed = small(cut(pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct()))
    return fresh(cut(verified(pairs, sets.join(needed, "node", "left_semi"), similarity)))


def small(written: DataFrame, most: int = 500_000) -> DataFrame:
    """A written table of a few numbers a row, to be broadcast if it has at most ``most`` rows (some 20 MB); else as it is."""
    return F.broadcast(written) if written.count() <= most else written


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", cut_: Cut | None = None, shingle: int = 4, block: int = 4096, text: str = "text") -> DataFrame:
    """Columns of docs but the text, with fp, component_id (the smallest id reachable over links) and root.

    cut_: by default ``exact_cut(4)``. Null and empty texts have fingerprint 0 and link like any other. Copies share a
    fingerprint and are linked once, by it. Rows with a null id take part; a component of such rows only has
    component_id null. Repeated ids are so many rows. Extra columns are kept unless named like a new one. root is the
    least first word of the component's fingerprints; for a cut with a similarity, where links are between shingle sets,
    the least hash of these. Nothing of the corpus comes to the driver.
    """
    cut_ = cut_ or exact_cut()
    kept = docs.select(*[c for c in docs.columns if c not in (*cut_.names, "component_id", "root")])
    if cut_.similarity is not None:
        marked = cut(fingerprints(kept.withColumn("__key", F.xxhash64(F.coalesce(text, F.lit("")))), cut_, shingle, text=text))
        least = F.min(F.struct(*cut_.names)).alias("w")  # sets alike may differ in what repeats
        sets = cut(marked.groupBy(F.col("__set").alias("node")).agg(F.min(id_col).alias("first"), F.min("__key").alias("__key"), least).select("node", "first", "__key", "w.*"))
        roots = similar_groups(docs, sets, cut_, shingle, block, text)
        named = sets.join(roots, "node", "left").select(F.col("node").alias("__set"), F.coalesce("root", "node").alias("root"), "first")
        named = cut(named)
        least = cut(named.groupBy("root").agg(F.min("first").alias("component_id")))
        answer = cut(named.join(least, "root").select("__set", "component_id", "root"))
        return marked.join(answer, "__set").select(*[c for c in marked.columns if c not in (*cut_.names[1:], "__set", "__key")], "component_id", "root")
    marked = cut(fingerprints(kept, cut_, shingle, text=text))
    # Written, so that the join at the end exchanges both sides and can split a fingerprint with very many copies.
    fps = cut(marked.groupBy(*cut_.names).agg(F.min(id_col).alias("first")))
    roots = components(fingerprint_links(fps, cut_, block))
    named = fps.select("fp", "first").join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = cut(named.groupBy("root").agg(F.min("first").alias("component_id")))  # written for the same reason
    answer = cut(named.select("fp", "root").distinct().join(least, "root").select("fp", "component_id", "root"))
    return marked.join(answer, "fp").select(*[c for c in marked.columns if c not in cut_.names[1:]], "component_id", "root")


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **how: Cut | int) -> DataFrame:
    """docs with one row of each component of ``near_duplicates``: that of the smallest id (null last), then by a hash
    of the text; of rows alike in both, any one. Only ids, hashes and fingerprints are grouped; texts move once, to the
    ids that stay."""
    key = F.xxhash64(F.coalesce(text, F.lit("")))
    ids = docs.select(F.col(id_col).alias("id"), key.alias("__h"), F.col(text).alias("text"))
    marked = near_duplicates(ids, "id", text="text", **how)
    alike = marked.groupBy("root", "id", "__h").agg(F.count("*").alias("n"))
    first = alike.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "__h", "n")).alias("w"))
    stay = cut(first.select(F.col("w.id").alias("__id"), F.col("w.__h").alias("__wh"), F.col("w.n").alias("__n")))
    own = docs.withColumn("__key", key)
    kept = own.join(stay.select("__id", "__wh"), F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__wh")), "left_semi")
    if not stay.where("__n > 1").isEmpty():
        kept = kept.dropDuplicates([id_col, "__key"])
    return kept.select(*docs.columns)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of every document; nulls, empty texts, copies and ties as in ``near_duplicates``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = near_duplicates(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
