"""Capture provenance: file groups, manifest differences, verification, activations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def file_episodes(files: DataFrame, keys: list[str], gap_ns: int = 4_000_000_000) -> DataFrame:
    """Files in order of (mtime_ns, name), parted by gaps over gap_ns: episodes with their span and the gap before them.

    Times stay whole nanoseconds.
    """
    w = Window.partitionBy(*keys).orderBy("mtime_ns", "name")
    gap = F.col("mtime_ns") - F.lag("mtime_ns").over(w)
    run = files.withColumn("gap_ns", gap).withColumn("new", F.when(gap.isNull() | (gap > gap_ns), 1).otherwise(0)).withColumn("episode", F.sum("new").over(w))
    return run.groupBy(*keys, "episode").agg(
        F.count("*").alias("files"), F.min("mtime_ns").alias("start_ns"), F.max("mtime_ns").alias("end_ns"), (F.max("mtime_ns") - F.min("mtime_ns")).alias("span_ns"),
        F.max(F.when(F.col("new") == 1, F.col("gap_ns"))).alias("preceding_gap_ns"))


def manifest_diff(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows of either snapshot that differ: NEW, REMOVED or CHANGED (any of ``fields``, nulls equal to nulls)."""
    b = before.select(F.col(key).alias("k"), F.struct(*fields).alias("b"))
    a = after.select(F.col(key).alias("k"), F.struct(*fields).alias("a"))
    both = a.join(b, "k", "full").select(F.col("k").alias(key), F.when(F.col("b").isNull(), "NEW").when(F.col("a").isNull(), "REMOVED").when(~F.col("a").eqNullSafe(F.col("b")), "CHANGED").alias("change"))
    return both.where("change is not null")


def verify_files(manifest: DataFrame, disk: DataFrame) -> DataFrame:
    """Every manifest file against the disk: MISSING, else SIZE-FAIL, else HASH-FAIL (also where one side lacks the value),
    else UNKNOWN if neither side has it, else OK."""
    d = disk.select("path", F.col("size_bytes").alias("found_size"), F.col("sha256").alias("found_sha"), F.lit(True).alias("found"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    verdict = F.when(F.col("found").isNull(), "MISSING").when(~same("found_size", "size_bytes"), "SIZE-FAIL").when(~same("found_sha", "sha256"), "HASH-FAIL")
    verdict = verdict.when(F.col("size_bytes").isNull() | F.col("sha256").isNull(), "UNKNOWN").otherwise("OK")
    return manifest.join(d, "path", "left").select("path", verdict.alias("verdict"))


def window_join(marks: DataFrame, rows: DataFrame, keys: list[str], at: str, time: str, width: int) -> DataFrame:
    """marks joined to the rows with at < time <= at + width, as an equality join on time blocks of that width.

    A row lies in its own block or the next one of its mark, so a mark is copied to two blocks and a row to none.
    """
    block = lambda c: F.floor(c / width)
    m = marks.withColumn("__block", F.explode(F.array(block(F.col(at)), block(F.col(at)) + 1)))
    r = rows.withColumn("__block", block(F.col(time)))
    return m.join(r, [*keys, "__block"]).where((F.col(time) > F.col(at)) & (F.col(time) <= F.col(at) + width)).drop("__block")


def activation_acquired(marks: DataFrame, files: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Per activation the files within (at, at + width], ACQUIRED if there is one."""
    met = window_join(marks, files, keys, "at", "time", width).groupBy(*keys, "label", "at").agg(F.count("*").alias("files"))
    out = marks.select(*keys, "label", "at").join(met, [*keys, "label", "at"], "left").withColumn("files", F.coalesce("files", F.lit(0)))
    return out.withColumn("state", F.when(F.col("files") > 0, "ACQUIRED").otherwise("NOT_ACQUIRED"))


def acquisition_completeness(acquired: DataFrame, keys: list[str]) -> DataFrame:
    return acquired.groupBy(*keys).agg(F.count("*").alias("activations"), F.count_if(F.col("state") == "ACQUIRED").alias("acquired")).withColumn("completeness", F.col("acquired") / F.col("activations"))


def activation_position(marks: DataFrame, files: DataFrame, finish: DataFrame, keys: list[str]) -> DataFrame:
    """Files between each activation and the next (the last: the capture's finish): count, first and last delay.

    One ordered pass carries the latest mark to each file.
    """
    w = Window.partitionBy(*keys).orderBy("at", "label")
    m = marks.withColumn("until", F.lead("at").over(w)).join(finish, keys, "left").withColumn("until", F.coalesce("until", "finish"))
    line = m.select(*keys, F.col("at").alias("t"), F.lit(1).alias("kind"), F.struct("at", "label", "until").alias("mark")).unionByName(files.select(*keys, F.col("time").alias("t"), F.lit(0).alias("kind"), F.lit(None).cast("struct<at:bigint,label:string,until:bigint>").alias("mark")))
    order = Window.partitionBy(*keys).orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    met = line.withColumn("mark", F.last("mark", True).over(order)).where("kind = 0 and mark is not null and t < mark.until")
    per = met.groupBy(*keys, "mark").agg(F.count("*").alias("files"), F.min(F.col("t") - F.col("mark.at")).alias("first_delay"), F.max(F.col("t") - F.col("mark.at")).alias("last_delay"))
    per = per.select(*keys, F.col("mark.label").alias("label"), "files", "first_delay", "last_delay")
    return m.select(*keys, "label", "at").join(per, [*keys, "label"], "left").withColumn("files", F.coalesce("files", F.lit(0)))


def ordered_markers_inside(markers: DataFrame, keys: list[str], start: Column, finish: Column) -> DataFrame:
    """Errors of activation markers: not after the previous one, or outside the transfer."""
    w = Window.partitionBy(*keys).orderBy("ordinal")
    before = F.lag("monotonic_ns").over(w)
    errors = F.filter(F.array(F.when(before >= F.col("monotonic_ns"), "NOT_MONOTONIC"), F.when(F.col("monotonic_ns") < start, "BEFORE_START"), F.when(F.col("monotonic_ns") > finish, "AFTER_FINISH")), lambda e: e.isNotNull())
    return markers.withColumn("errors", errors)


def settings_change(a: Column, b: Column) -> Column:
    """A changed setting is an error, a changed revision a warning."""
    return F.when(~a["settings"].eqNullSafe(b["settings"]), "ERROR").when(~a["git_head"].eqNullSafe(b["git_head"]), "WARNING").otherwise("OK")


def slot_events(events: DataFrame, keys: list[str], start: str, slots: int = 6, slot_ns: int = 30_000_000_000, lead_ns: int = 5_000_000_000) -> DataFrame:
    """Activations against a timeline of half-open slots, each scheduled ``lead`` after its slot begins: lateness, or a problem.

    events: keys, ordinal from 1, actual_ns and the column with the capture's start in nanoseconds.
    """
    begin = F.col(start) + (F.col("ordinal") - 1) * slot_ns
    due = begin + lead_ns
    problem = F.when(~F.col("ordinal").between(1, slots), "ORDINAL").when((F.col("actual_ns") < due) | (F.col("actual_ns") >= begin + slot_ns), "OUTSIDE_SLOT")
    return events.withColumn("scheduled_ns", due).withColumn("problem", F.coalesce(problem, F.when(F.col("actual_ns").isNull(), "MISSING"))).withColumn("lateness_ns", F.when(F.col("problem").isNull(), F.col("actual_ns") - F.col("scheduled_ns")))


def session_grid(observed: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of an expected design that are missing, and observed ones that repeat or were not planned."""
    have = observed.groupBy(*keys).agg(F.count("*").alias("n"))
    both = expected.select(*keys).distinct().withColumn("__e", F.lit(1)).join(have, keys, "full")
    return both.withColumn("problem", F.when(F.col("n").isNull(), "MISSING").when(F.col("__e").isNull(), "UNPLANNED").when(F.col("n") > 1, "REPEATED")).where("problem is not null").select(*keys, "problem")


def hash_lists_equal(listed: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """By key whether a hash list names exactly the files found: the same (path, sha256), each once on either side."""
    side = lambda d, n: d.groupBy(*keys, "path", "sha256").agg(F.count("*").alias(n))
    both = side(listed, "l").join(side(found, "f"), [*keys, "path", "sha256"], "full")
    wrong = F.count_if((F.coalesce("l", F.lit(0)) != 1) | (F.coalesce("f", F.lit(0)) != 1))
    return both.groupBy(*keys).agg(F.count("l").alias("listed"), F.count("f").alias("found"), wrong.alias("wrong")).withColumn("equal", F.col("wrong") == 0)
