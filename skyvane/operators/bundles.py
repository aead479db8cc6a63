"""Consistency of capture bundles before anything is computed from them, for many captures at once.

A bundle is what four files say of one capture (manifest, grouping, features, hash list) and what is on disk. Each rule
is a line of a declared table: what is compared, and when it is broken. Inputs are brought together by equality on path,
on place in an episode, on place in the list and on capture, and each is aggregated once; nothing is compared pairwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The JSON files of a bundle. Grouping and sample parameters.
SOURCES = ("manifest", "grouping", "features")
GAP_S, COMPARISON, RATE_HZ, DTYPE, SAMPLE_BYTES = 4.0, ">", 25_000, "complex128", 16

#: (rule, broken when) over the counts of the joined inputs, in the order in which they are told.
RULES: tuple[tuple[str, str], ...] = (
    ("format", "bad_format > 0"), ("head missing", f"heads <> {len(SOURCES)} or sources <> {len(SOURCES)}"), ("capture id", "bad_capture > 0"), ("grouping parameters", "bad_grouping > 0"), ("sample parameters", "bad_samples > 0"),
    ("repeated manifest path", "path_repeats > 0"), ("manifest count", "manifest_count is distinct from manifest_rows"), ("grouping omits or repeats a file", "path_membership > 0"), ("grouping file count", "grouping_count is distinct from member_rows"),
    ("recorded time missing", "without_time > 0"), ("grouping size or hash", "member_differs > 0"), ("episode numbers", "episode_rows <> episode_ids or episode_least <> 1 or episode_most <> episode_ids"),
    ("episode count", "grouping_episodes is distinct from episode_rows or features_episodes is distinct from episode_rows"), ("episode file count", "bad_file_count > 0"), ("episode fragment count", "bad_fragment_count > 0"),
    ("features membership or order", "place_differs > 0"), ("fragment size", "fragment_size > 0"), ("fragment samples", "fragment_samples > 0"), ("hash list", "line_differs > 0"),
    ("raw file missing", "raw_missing > 0"), ("raw size", "raw_size > 0"), ("raw size is no whole number of samples", "raw_partial > 0"), ("raw hash", "raw_hash > 0"),
)


def tell(df: DataFrame, source: str, *keys: str, **values: str) -> DataFrame:
    """Rows of one input under common names: capture, keys, source, and a struct of the values that are compared."""
    return df.select("capture", *keys, F.lit(source).alias("source"), F.struct(*[F.col(c).alias(n) for n, c in values.items()]).alias(source))


def together(*inputs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), inputs)


def said(source: str) -> Column:
    return F.count(F.when(F.col("source") == source, 1)).alias(f"n_{source}")


def differs(a: str, b: str) -> Column:
    return ~F.col(a).eqNullSafe(F.col(b))


def bundle_problems(heads: DataFrame, files: DataFrame, members: DataFrame, episodes: DataFrame, fragments: DataFrame, hashes: DataFrame, disk: DataFrame, formats: dict[str, str]) -> DataFrame:
    """(capture, problems): the names of the broken rules of every capture that any input but disk names; none if all hold.

    formats: the format that each of SOURCES must name. heads: capture, source, format, capture_id, file_count, episode_count, gap_s, comparison,
    sample_rate_hz, iq_dtype. files (manifest) and hashes (line): capture, position from 0, ... members (grouping) and
    fragments (features): capture, episode, position, path, ... episodes: capture, episode, file_count, fragment_count.
    disk: path, size_bytes, sha256. A value that is missing on one side differs; null captures are left out.
    """
    files, members, fragments, episodes, hashes, heads = (d.where("capture is not null") for d in (files, members, fragments, episodes, hashes, heads))
    any_ = lambda c, n: F.count_if(F.coalesce(c, F.lit(True))).alias(n)
    first = lambda s: F.max(s).alias(s)
    # By path: what manifest and grouping say of a file.
    paths = together(tell(files, "manifest", "path", size="size_bytes", sha="sha256"), tell(members, "member", "path", size="size_bytes", sha="sha256", at="mtime_ns"))
    paths = paths.groupBy("capture", "path").agg(said("manifest"), said("member"), first("manifest"), F.min("member").alias("low"), first("member"), F.count_if(F.col("source").eqNullSafe("member") & F.col("member.at").isNull()).alias("untimed"))
    both = (F.col("n_manifest") > 0) & (F.col("n_member") > 0)
    unlike = reduce(lambda a, b: a | b, [differs(f"manifest.{x}", f"{m}.{x}") for x in ("size", "sha") for m in ("low", "member")])
    by_path = paths.groupBy("capture").agg(
        any_(F.col("n_manifest") > 1, "path_repeats"), any_((F.col("n_member") != 1) | (F.col("n_manifest") == 0), "path_membership"), F.sum("untimed").alias("without_time"), any_(both & unlike, "member_differs"))
    # By place in an episode: what grouping and features say of a fragment.
    places = together(tell(members, "member", "episode", "position", path="path", size="size_bytes"), tell(fragments, "fragment", "episode", "position", path="path", size="size_bytes", samples="samples"))
    places = places.groupBy("capture", "episode", "position").agg(first("member"), first("fragment"))
    met = F.col("member").isNotNull() & F.col("fragment").isNotNull()
    by_place = places.groupBy("capture").agg(any_(differs("member.path", "fragment.path"), "place_differs"), any_(met & differs("member.size", "fragment.size"), "fragment_size"), any_(met & ~(F.col("fragment.samples") * SAMPLE_BYTES).eqNullSafe(F.col("member.size")), "fragment_samples"))
    # By episode: its number and counts.
    counts = together(tell(episodes, "said", "episode", files="file_count", fragments="fragment_count"), tell(members, "member", "episode", path="path"))
    counts = counts.groupBy("capture", "episode").agg(F.count("said").alias("rows"), first("said"), said("member"))
    by_episode = counts.groupBy("capture").agg(
        F.sum("rows").alias("episode_rows"), F.count(F.when(F.col("rows") > 0, 1)).alias("episode_ids"), F.min("episode").alias("episode_least"), F.max("episode").alias("episode_most"),
        any_(differs("said.files", "n_member"), "bad_file_count"), any_(differs("said.fragments", "n_member"), "bad_fragment_count"))
    # By place in the list: the hash list has the manifest's files in its order.
    line = F.concat("sha256", F.lit("  "), "path")
    lists = together(tell(files.withColumn("line", line), "manifest", "position", line="line"), tell(hashes, "listed", "position", line="line"))
    by_line = lists.groupBy("capture", "position").agg(first("manifest"), first("listed")).groupBy("capture").agg(any_(differs("manifest.line", "listed.line"), "line_differs"))
    # By file on disk, and the heads with the numbers of rows they speak of.
    found = disk.groupBy("path").agg(F.max(F.struct("size_bytes", "sha256")).alias("found"))
    raw = files.join(found, "path", "left")
    here = F.col("found").isNotNull()
    by_raw = raw.groupBy("capture").agg(
        F.count("*").alias("manifest_rows"), any_(~here, "raw_missing"), any_(here & differs("size_bytes", "found.size_bytes"), "raw_size"), any_(here & (F.col("found.size_bytes") % SAMPLE_BYTES != 0), "raw_partial"), any_(here & differs("sha256", "found.sha256"), "raw_hash"))
    of = lambda source, c: F.max(F.when(F.col("source") == source, F.col(c)))
    right = reduce(lambda a, b: a | b, [F.col("source").eqNullSafe(s) & F.col("format").eqNullSafe(f) for s, f in formats.items()])
    by_head = heads.groupBy("capture").agg(
        F.count("*").alias("heads"), F.count_distinct("source").alias("sources"), any_(~right, "bad_format"), any_(differs("capture_id", "capture"), "bad_capture"),
        any_((F.col("source") == "grouping") & ~(F.col("gap_s").eqNullSafe(F.lit(GAP_S)) & F.col("comparison").eqNullSafe(COMPARISON)), "bad_grouping"),
        any_((F.col("source") == "features") & ~(F.col("sample_rate_hz").eqNullSafe(RATE_HZ) & F.col("iq_dtype").eqNullSafe(DTYPE)), "bad_samples"),
        of("manifest", "file_count").alias("manifest_count"), of("grouping", "file_count").alias("grouping_count"), of("grouping", "episode_count").alias("grouping_episodes"), of("features", "episode_count").alias("features_episodes"))
    by_member = members.groupBy("capture").agg(F.count("*").alias("member_rows"))
    out = reduce(lambda a, b: a.join(b, "capture", "full"), [by_head, by_path, by_place, by_episode, by_line, by_raw, by_member])
    out = out.fillna(0, subset=["heads", "sources", "manifest_rows", "member_rows", "episode_rows", "episode_ids"])
    broken = [F.when(F.expr(when), F.lit(rule)) for rule, when in RULES]
    return out.select("capture", F.array_compact(F.array(*broken)).alias("problems"))
