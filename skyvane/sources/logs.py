"""Text logs as DataFrames: key=value lines, session markers, activation logs, hash lists, ledgers, JSONL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyvane.functions.classify import once

QUALITIES = ["STABLE", "MULTIPATH", "LOW_QUALITY"]


def parts(line: Column) -> Column:
    return F.split(line, ",")


def lenient_map(line: Column) -> Column:
    """key=value parts of a line: parts without '=' are skipped, both sides trimmed, the last of equal keys wins."""
    pairs = F.transform(F.filter(parts(line), lambda p: F.contains(p, F.lit("="))), lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("k"), F.trim(F.substr(p, F.instr(p, "=") + 1)).alias("v")))
    # Of equal keys the last: a pair stays if from behind its key comes first at its own place.
    last = lambda ps, back: F.filter(ps, lambda p, i: F.array_position(back, p["k"]) == F.size(ps) - i)
    return F.map_from_entries(once(pairs, lambda ps: once(F.reverse(F.transform(ps, lambda p: p["k"])), lambda back: last(ps, back))))


def with_map(lines: DataFrame, line: str) -> DataFrame:
    """lines with m, the map of each; exploded, so that it is made once a line and not for every field that is read."""
    return lines.withColumn("m", F.explode(F.array(lenient_map(F.col(line)))))


def strict_error(line: Column) -> Column:
    """Why a line is no strict key=value record: a part without '=', an empty or a repeated key; null if it is one."""
    keys = F.transform(parts(line), lambda p: F.trim(F.substring_index(p, "=", 1)))
    return F.when(F.exists(parts(line), lambda p: ~F.contains(p, F.lit("="))), "part without =").when(F.exists(keys, lambda x: x == ""), "empty key").when(F.size(F.array_distinct(keys)) < F.size(keys), "repeated key")


def number(c: Column) -> Column:
    """A number, null where the text is empty, NA or NONE in any case, or no number; not finite counts as null."""
    v = F.when(~F.upper(F.trim(c)).isin("", "NA", "NONE"), F.trim(c).try_cast("double"))
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no from 1, value) of text files, without blank lines, which count.

    Files are read in splits. A line's number is its place in its split plus the lines of the splits before; a split is
    ordered inside one task, and only the counts of splits are added up by file.
    """
    at = ["path", "__start"]
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__at"), F.regexp_replace("value", "\r$", "").alias("value"))
    counts = lines.groupBy(*at).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("path").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    mine = lines.withColumn("__i", F.row_number().over(Window.partitionBy(*at).orderBy("__at")))
    out = mine.join(counts.select(*at, before.alias("__before")), at)
    return out.select("path", (F.col("__before") + F.col("__i")).cast("bigint").alias("line_no"), "value").where(F.trim("value") != "")


NUMBERS = ["frequency_mhz", "peak_power", "max_confidence", "doa_width", "median_doa_peaks", "bearing_spread", "median_confidence", "single_peak_ratio", "samples"]


def field(name: str) -> Column:
    """A field of the map column m, null if absent."""
    return F.try_element_at("m", F.lit(name))


def is_burst() -> Column:
    """Whether the map column m has a session and a known quality."""
    return F.coalesce((field("session_id") != "") & field("quality").isin(QUALITIES), F.lit(False))


def line_integrity(lines: DataFrame, keys: list[str], line: str = "value") -> DataFrame:
    """By key the lines that are neither blank nor markers, those of them that are bursts, and whether all are."""
    body = with_map(lines.where((F.trim(line) != "") & ~F.startswith(F.col(line), F.lit("SESSION_"))), line)
    out = body.groupBy(*keys).agg(F.count("*").alias("raw"), F.count_if(is_burst()).alias("parsed"))
    return out.withColumn("complete", F.col("raw") == F.col("parsed"))


def burst_log(lines: DataFrame, line: str = "value", drop_bad: bool = False) -> DataFrame:
    """Bursts of a log: records with a session and a known quality; bearings within [0, 360). With ``drop_bad`` a record
    with a field that is there but no number goes, as a report wants it; else the field is null."""
    m = with_map(lines.where(~F.startswith(F.col(line), F.lit("SESSION_"))), line)
    if drop_bad:
        bad = lambda n: F.coalesce(~F.upper(F.trim(field(n))).isin("", "NA", "NONE") & F.trim(field(n)).try_cast("double").isNull(), F.lit(False))
        m = m.where(~F.exists(F.array(*map(bad, ["bearing", *NUMBERS])), lambda x: x))
    text, nums = field, NUMBERS
    return m.select(
        text("session_id").alias("session_id"), F.try_to_timestamp(text("time")).alias("time"), F.pmod(number(text("bearing")), F.lit(360.0)).alias("bearing"),
        *[number(text(n)).alias(n) for n in nums], text("quality").alias("quality"), is_burst().alias("__burst"),
    ).where("__burst").drop("__burst")


def event_log(lines: DataFrame, names: list[str], line: str = "value") -> DataFrame:
    """(session_id, time, event, attrs) of the named events."""
    m = with_map(lines, line)
    get = lambda k: F.try_element_at("m", F.lit(k))
    return m.select(get("session_id").alias("session_id"), F.try_to_timestamp(get("time")).alias("time"), get("event").alias("event"), F.map_filter("m", lambda k, _: ~k.isin("session_id", "time", "event")).alias("attrs")).where(F.col("event").isin(names) & F.col("session_id").isNotNull())


EPISODE = (
    "version int, timestamp string, project string, session_id string, event string, episode_id int, observation_index int, reason string, "
    "summary struct<version:int,episode_id:int,status:string,start_index:bigint,end_index:bigint,end_reason:string,start_mean:double,latest_mean:double,max_support:bigint,degraded_seen:boolean>"
)


def episode_log(spark: SparkSession, path: str, session_id: str | None = None) -> DataFrame:
    """Episode events of a JSONL file; the first malformed line fails the query with its place, a missing file has none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop):
        return spark.createDataFrame([], EPISODE)
    parsed = numbered_lines(spark, path).withColumn("r", F.from_json("value", f"{EPISODE}, __bad string", {"columnNameOfCorruptRecord": "__bad"}))
    place = F.concat(F.col("path"), F.lit(":"), F.col("line_no").cast("string"), F.lit(": no episode event"))
    df = parsed.select(F.when(F.col("r").isNull() | F.col("r.__bad").isNotNull(), F.raise_error(place).cast(parsed.schema["r"].dataType)).otherwise(F.col("r")).alias("r")).select("r.*").drop("__bad")
    return df.where(F.col("session_id") == session_id) if session_id else df


def markers(lines: DataFrame, line: str = "value") -> DataFrame:
    """(line_no, kind, session_id, time) of SESSION_START and SESSION_END lines; a time that does not parse is null."""
    field = lambda k: F.trim(F.regexp_extract(line, rf"\|\s*{k}=([^|]*)", 1))
    return lines.where(F.col(line).rlike(r"^SESSION_(START|END)\b")).select("line_no", F.regexp_extract(line, r"^(SESSION_(?:START|END))", 1).alias("kind"), field("id").alias("session_id"), F.try_to_timestamp(field("time")).alias("time")).where("session_id <> ''")


def latest_session(marks: DataFrame) -> DataFrame:
    """The id of the last start marker."""
    return marks.where("kind = 'SESSION_START'").agg(F.max_by("session_id", "line_no").alias("session_id"))


def session_times(marks: DataFrame) -> DataFrame:
    """Start and end of each session; the last marker of a kind counts, of those with a time."""
    last = lambda kind: F.max_by("time", F.when((F.col("kind") == kind) & F.col("time").isNotNull(), F.col("line_no")))
    return marks.groupBy("session_id").agg(last("SESSION_START").alias("start_time"), last("SESSION_END").alias("end_time"))


def activation_log(lines: DataFrame, line: str = "value") -> DataFrame:
    """(label, wall, monotonic_ns) of A<n> marker lines."""
    f = F.split(F.col(line), r" \| ")
    return lines.where(F.col(line).rlike(r"^A\d+ \| ")).select(F.trim(f[0]).alias("label"), F.try_to_timestamp(F.regexp_extract(line, r"wall=([^ |]+)", 1)).alias("wall"), F.regexp_extract(line, r"monotonic_ns=(\d+)", 1).try_cast("bigint").alias("monotonic_ns"))


def hash_list(lines: DataFrame, line: str = "value") -> DataFrame:
    """(sha256, path) of '<hash>  <path>' lines, and whether the path repeats."""
    f = lines.select(F.regexp_extract(line, r"^([0-9a-f]{64})  (.+)$", 1).alias("sha256"), F.regexp_extract(line, r"^([0-9a-f]{64})  (.+)$", 2).alias("path")).where("sha256 <> ''")
    return f.join(f.groupBy("path").agg((F.count("*") > 1).alias("repeated")), "path")


def ledger(spark: SparkSession, path: str, schema: str, prefix: str | None = None, key: str = "session_id") -> DataFrame:
    df = spark.read.csv(path, schema=schema, header=True)
    return df.where(F.startswith(F.col(key), F.lit(prefix))) if prefix else df


def numbered_files(spark: SparkSession, folder: str, pattern: str, below: int, extension: str = "json") -> list[str]:
    """Paths in a folder whose number (first group of pattern in the name) is below a limit, found without opening any file."""
    import re

    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for s in fs.listStatus(hadoop):
        name = s.getPath().getName()
        m = re.search(pattern, name)
        if m and name.endswith(extension) and int(m.group(1)) < below:
            out.append(s.getPath().toString())
    return sorted(out)


def kv_text(df: DataFrame, fields: list[str]) -> DataFrame:
    """Records as key=value lines in the order of fields; null as NA, six decimals for the frequency."""
    shown = lambda f: F.coalesce(F.format_string("%.6f", F.col(f)) if f == "frequency_mhz" else F.col(f).cast("string"), F.lit("NA"))
    return df.select(F.concat_ws(",", *[F.concat(F.lit(f"{f}="), shown(f)) for f in fields]).alias("value"))


def in_key_order(value: Column, kind: T.DataType) -> Column:
    """The value with the fields of its structs and the keys of its maps in order of name, at every depth."""
    if isinstance(kind, T.StructType):
        inner = [in_key_order(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(value.isNotNull(), F.struct(*inner))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: in_key_order(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(F.transform_values(value, lambda _, v: in_key_order(v, kind.valueType)))))
    return value


def canonical_jsonl(df: DataFrame) -> DataFrame:
    """Rows as JSON objects without spaces, keys sorted at every depth; nulls are written."""
    fields = [in_key_order(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)]
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def strict_records(lines: DataFrame, line: str = "value") -> DataFrame:
    """lines with m, the record's map; the first line that is no strict record fails the query with its place.

    Session markers are no records and left out. lines: path, line_no, value.
    """
    body = lines.where(~F.startswith(F.col(line), F.lit("SESSION_")))
    why = strict_error(F.col(line))
    checked = F.when(why.isNotNull(), F.raise_error(F.concat(F.col("path"), F.lit(": line "), F.col("line_no").cast("string"), F.lit(": "), why)).cast("map<string,string>")).otherwise(lenient_map(F.col(line)))
    return body.withColumn("m", checked)


def present(spark: SparkSession, paths: list[str]) -> tuple[list[str], list[str]]:
    """The paths that are there, and those that are missing, by the file systems they name."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = [jvm.org.apache.hadoop.fs.Path(p).getFileSystem(conf).exists(jvm.org.apache.hadoop.fs.Path(p)) for p in paths]
    return [p for p, t in zip(paths, there, strict=True) if t], [p for p, t in zip(paths, there, strict=True) if not t]


def session_records(spark: SparkSession, logs: dict[str, str], session_id: str) -> tuple[dict[str, DataFrame], list[str]]:
    """One session's records of each log (kind to path), and the kinds whose file is missing.

    Kinds are bursts, track and episodes. Every line of a log is checked, also those of other sessions: the first bad one
    fails the query with its path and line. bursts and track: (path, line_no, m), m the record's map; records without a
    session are skipped. episodes: (path, line_no, r), r the event; one without a session is bad. Markers are no records.
    """
    there, missing = present(spark, list(logs.values()))
    out = {}
    for kind, path in logs.items():
        if path in missing:
            continue
        lines = numbered_lines(spark, path)
        if kind != "episodes":
            out[kind] = strict_records(lines).where(F.try_element_at("m", F.lit("session_id")) == session_id).select("path", "line_no", "m")
            continue
        r = lines.withColumn("r", F.from_json("value", f"{EPISODE}, __bad string", {"columnNameOfCorruptRecord": "__bad"}))
        why = F.when(F.col("r").isNull() | F.col("r.__bad").isNotNull(), "no episode event").when(F.coalesce(F.col("r.session_id"), F.lit("")) == "", "no session")
        place = F.concat(F.col("path"), F.lit(": line "), F.col("line_no").cast("string"), F.lit(": "), why)
        checked = F.when(why.isNotNull(), F.raise_error(place).cast(r.schema["r"].dataType)).otherwise(F.col("r"))
        out[kind] = r.select("path", "line_no", checked.alias("r")).where(F.col("r.session_id") == session_id).withColumn("r", F.col("r").dropFields("__bad"))
    return out, [k for k, path in logs.items() if path in missing]
