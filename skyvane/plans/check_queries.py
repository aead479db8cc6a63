"""Queries of readers, guards and checks over the whole tables, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyvane.functions import classify as k
from skyvane.operators import association, bundles, capture, evidence, ml, rollups
from skyvane.operators import families as fam
from skyvane.operators.bursts import decode_frames
from skyvane.sources import logs
from skyvane.sources.observations import spread


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def burst_lines(spark: SparkSession, sf: str) -> DataFrame:
    """An event as a log line: every tenth of an unknown quality, every seventh with a bearing that is no number."""
    e = F.col("event_id")
    line = F.concat(
        F.lit("session_id=S"), "user_id", F.lit(", bearing="), F.when(e % 7 == 0, "north").otherwise((e * 3 % 720).cast("string")), F.lit(", samples="), (e % 9).cast("string"),
        F.lit(",quality="), F.when(e % 10 == 0, "GOOD").otherwise("STABLE"))
    return spread(read(spark, sf, "events").select("user_id", "event_id"), 50_000).select("user_id", "event_id", line.alias("value"))


def line_integrity(spark: SparkSession, sf: str) -> DataFrame:
    return logs.line_integrity(burst_lines(spark, sf), ["user_id"])


INTEGRITY = "SELECT user_id, count(*) AS raw, count(*) FILTER (event_id % 10 <> 0) AS parsed, count(*) FILTER (event_id % 10 = 0) = 0 AS complete FROM events GROUP BY 1"


def report_log(spark: SparkSession, sf: str) -> DataFrame:
    return logs.burst_log(burst_lines(spark, sf), drop_bad=True).groupBy("session_id").agg(F.count("*").alias("bursts"), F.sum("bearing").alias("bearings"), F.sum("samples").alias("samples"))


REPORT_LOG = "SELECT 'S' || user_id AS session_id, count(*) AS bursts, sum(event_id * 3 % 720 % 360)::DOUBLE AS bearings, sum(event_id % 9)::DOUBLE AS samples FROM events WHERE event_id % 10 <> 0 AND event_id % 7 <> 0 GROUP BY 1"


def frame_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of 360 bins with one peak and a lower neighbour; every eleventh lacks a bin, every thirteenth has a bad number."""
    e, at = F.col("event_id"), (F.col("user_id") % 300 + 5).cast("int")
    before = F.expr("repeat('0,', cast(user_id % 300 + 5 as int))")
    after = F.expr("repeat(',0', 358 - cast(user_id % 300 + 5 as int) - case when event_id % 11 = 0 then 1 else 0 end)")
    head = F.concat_ws(",", F.lit("t"), (e % 360).cast("string"), F.lit("5"), F.when(e % 13 == 0, "x").otherwise((-(e % 40)).cast("string")), F.lit("433920000"), F.lit("0,0,0,0,0,0,0,0,0,0,0,0"))
    lines = spread(read(spark, sf, "events").select("event_id", "user_id"), 20_000).select("event_id", F.concat(head, F.lit(","), before, F.lit("10,"), F.when(e % 2 == 0, "6").otherwise("4"), after).alias("value"), at)
    return decode_frames(lines, keep=["event_id"]).select("event_id", "bearing", "power", "frequency_mhz", "width", "peaks")


FRAMES = "SELECT event_id, (event_id % 360)::DOUBLE AS bearing, (0 - event_id % 40)::DOUBLE AS power, 433.92::DOUBLE AS frequency_mhz, CASE WHEN event_id % 2 = 0 THEN 2.0 ELSE 1.0 END::DOUBLE AS width, 1::DOUBLE AS peaks FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0"


def daq_checks(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    flag = lambda n: F.when(e % n != 1, e % n != 0)  # unknown where the rest is 1
    d = read(spark, sf, "events").select("event_id", flag(5).alias("a"), flag(7).alias("b"), flag(11).alias("c"), (~flag(6)).alias("d"), flag(8).alias("e"), F.when(e % 9 != 1, e % 3).alias("f"))
    return d.select("event_id", F.array_join(k.daq_failures("a", "b", "c", "d", "e", "f"), ",").alias("failures"))


DAQ = f"""SELECT event_id, array_to_string([x FOR x IN [{', '.join(f"CASE WHEN event_id % {n} IN (0, 1) THEN '{name}' END" for n, name in ((5, 'frame_sync'), (7, 'sample_delay_sync'), (11, 'iq_sync'), (6, 'adc_overdrive'), (8, 'daq_ok')))},
CASE WHEN event_id % 9 = 1 OR event_id % 3 <> 0 THEN 'dropped_frames' END] IF x IS NOT NULL], ',') AS failures FROM events"""


def width_gate(spark: SparkSession, sf: str) -> DataFrame:
    item = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 400).cast("double").alias("width_hz"), (F.col("l_suppkey") % 3 > 0).alias("eligible"), F.when(F.col("l_suppkey") % 3 == 0, F.array(F.lit("REGION_BOUNDARY_COMPONENT"))).otherwise(F.array().cast("array<string>")).alias("reasons"))
    return association.width_gate(item, 200.0).withColumn("reasons", F.array_join("reasons", ","))


WIDTH_GATE = """SELECT l_orderkey, l_linenumber, (l_partkey % 400)::DOUBLE AS width_hz, l_suppkey % 3 > 0 AND l_partkey % 400 <= 200 AS eligible,
concat_ws(',', CASE WHEN l_suppkey % 3 = 0 THEN 'REGION_BOUNDARY_COMPONENT' END, CASE WHEN l_partkey % 400 > 200 THEN 'BROAD_COMPONENT' END) AS reasons FROM lineitem"""


def settings_equal(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.col("l_quantity"), F.col("l_quantity") + F.when(F.col("l_partkey") % 3 == 0, 1e-12).when(F.col("l_partkey") % 3 == 1, 1e-6).otherwise(0.0)
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", k.same_setting(a, b).alias("same"))


SETTINGS = "SELECT l_orderkey, l_linenumber, l_partkey % 3 <> 1 AS same FROM lineitem"


def ledger_append(spark: SparkSession, sf: str) -> DataFrame:
    """Events as rows of a ledger that has every third user already; some have no user."""
    e = read(spark, sf, "events").select(F.when(F.col("event_id") % 17 != 0, F.col("user_id")).alias("session_id"), "event_id")
    return ml.append_ledger(e.where("session_id % 3 = 0").select("session_id"), e)


LEDGER = "SELECT user_id AS session_id, min(event_id) AS event_id FROM events WHERE event_id % 17 <> 0 AND user_id % 3 <> 0 GROUP BY 1"


def repeated_keys(spark: SparkSession, sf: str) -> DataFrame:
    return ml.repeated_keys(read(spark, sf, "lineitem"), "l_orderkey")


REPEATED = "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1"


def hash_lists(spark: SparkSession, sf: str) -> DataFrame:
    """A hash list of each brand's parts against what is found: of some sizes a part lacks, repeats or differs."""
    p = read(spark, sf, "part").select(F.col("p_brand").alias("capture"), F.col("p_partkey").cast("string").alias("path"), F.sha2("p_name", 256).alias("sha256"), "p_size", "p_partkey")
    found = p.where("p_partkey % 211 <> 0").withColumn("sha256", F.when(F.col("p_partkey") % 223 == 0, "x").otherwise(F.col("sha256")))
    return capture.hash_lists_equal(p, found, ["capture"])


HASH_LISTS = """SELECT p_brand AS capture, count(*) AS listed, count(*) FILTER (p_partkey % 211 <> 0) AS found, (count(*) FILTER (p_partkey % 211 = 0) + 2 * count(*) FILTER (p_partkey % 211 <> 0 AND p_partkey % 223 = 0)) AS wrong,
count(*) FILTER (p_partkey % 211 = 0 OR p_partkey % 223 = 0) = 0 AS equal FROM part GROUP BY 1"""


def prefix_complete(spark: SparkSession, sf: str) -> DataFrame:
    numbers = read(spark, sf, "events").select(F.col("user_id").cast("int").alias("number")).union(spark.createDataFrame([(900001,)], "number int"))
    return evidence.prefix_problem(numbers, [5, 6, 900001, 900002, 900003], 900002)


PREFIX = "SELECT 900002 AS number, 'MISSING' AS problem UNION ALL SELECT user_id::INT, 'REPEATED' FROM events GROUP BY 1 HAVING count(*) > 1"


def json_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Strict JSON with its keys out of order; every fifth repeats a key, every seventh has NaN."""
    e = F.col("event_id")
    t = F.concat(F.lit('{"n" : '), "event_id", F.lit(', "b": [1, null], "a": "é'), "event_type", F.when(e % 5 == 0, F.lit('", "n": 1}')).when(e % 7 == 0, F.lit('", "x": NaN}')).otherwise(F.lit('"}')))
    d = read(spark, sf, "events").select("event_id", evidence.json_digest(t).alias("d"))
    return d.select("event_id", "d.sha256", F.col("d.error").isNotNull().alias("refused"))


DIGESTS = """SELECT event_id, CASE WHEN event_id % 5 <> 0 AND event_id % 7 <> 0 THEN sha256('{"a":"é' || event_type || '","b":[1,null],"n":' || event_id || '}') END AS sha256, event_id % 5 = 0 OR event_id % 7 = 0 AS refused FROM events"""


def evidence_join(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").withColumn("session_id", F.concat(F.lit("S"), "user_id"))
    summary = e.groupBy("session_id").agg(F.count("*").alias("bursts"), F.max("event_id").alias("a_last"))
    scored = e.where("user_id % 4 <> 0").groupBy("session_id").agg((F.min("event_id") % 3).alias("cluster"))
    return evidence.evidence_bundle(summary, scored)


EVIDENCE = """WITH s AS (SELECT 'S' || user_id AS session_id, count(*) AS n, max(event_id) AS m, min(event_id) % 3 AS c FROM events WHERE user_id % 4 <> 0 GROUP BY 1)
SELECT session_id, '{"bursts":' || n || ',"a_last":' || m || '}' AS summary, '{"cluster":' || c || '}' AS model, sha256('{"a_last":' || m || ',"bursts":' || n || '}') AS summary_sha256, sha256('{"cluster":' || c || '}') AS model_sha256 FROM s"""


def record_problems(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    d = read(spark, sf, "events").select(
        "event_id", F.when(e % 13 != 0, e % 4).alias("cluster"), F.when(e % 11 != 0, (e % 9).cast("double") - 1).alias("nearest"), (e % 6).cast("double").alias("second"), (e % 5 / 2).alias("ratio"),
        F.when(e % 3 == 0, "WITHIN_OBSERVED_TRAINING_RANGE").otherwise("OUTSIDE_OBSERVED_TRAINING_RANGE").alias("novelty"))
    return evidence.model_record_problems(d).select("event_id", F.array_join("problems", ",").alias("problems"))


RECORDS = """SELECT event_id, concat_ws(',', CASE WHEN event_id % 13 = 0 OR event_id % 4 = 3 THEN 'cluster' END, CASE WHEN event_id % 11 = 0 OR event_id % 9 = 0 THEN 'nearest' END,
CASE WHEN event_id % 11 = 0 OR event_id % 6 < event_id % 9 - 1 THEN 'order' END, CASE WHEN (event_id % 5 <= 2) <> (event_id % 3 = 0) THEN 'novelty' END) AS problems FROM events"""


def spectral_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as fragments of an episode: medians of their features and of the gaps between them."""
    n = F.col("l_linenumber")
    num = lambda c, m: (F.col(c) % m).cast("double")
    f = read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("episode"), (n.cast("bigint") * n * 1_000_000_000).alias("mtime_ns"), num("l_partkey", 1000).alias("centroid_hz"), num("l_suppkey", 90).alias("spread_hz"),
        F.col("l_quantity").cast("double").alias("entropy"), num("l_partkey", 77).alias("occupied_hz"), F.array(num("l_partkey", 50) - 25, num("l_suppkey", 40) - 20).alias("offsets_hz"),
        F.when(n % 3 != 0, F.array(num("l_partkey", 31), num("l_suppkey", 17), num("l_partkey", 13), num("l_suppkey", 7))).otherwise(F.array().cast("array<double>")).alias("spacings_hz"))
    out = rollups.spectral_episodes(f, ["episode"])
    return out.select("episode", "fragments", *[F.round(c, 4).alias(c) for c in out.columns[2:]])


ROLLUP = f"""WITH f AS (SELECT l_orderkey AS episode, l_linenumber AS n, (l_partkey % 1000)::DOUBLE AS centroid_hz, (l_suppkey % 90)::DOUBLE AS spread_hz, l_quantity::DOUBLE AS entropy, (l_partkey % 77)::DOUBLE AS occupied_hz,
least(abs(l_partkey % 50 - 25), abs(l_suppkey % 40 - 20))::DOUBLE AS nearest_offset_hz, CASE WHEN l_linenumber % 3 <> 0 THEN list_aggregate([l_partkey % 31, l_suppkey % 17, l_partkey % 13, l_suppkey % 7], 'median')::DOUBLE END AS spacing_hz,
l_linenumber * l_linenumber - lag(l_linenumber * l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS gap_s FROM lineitem)
SELECT episode, count(*) AS fragments, {', '.join(f'round(median({c}), 4)::DOUBLE AS {c}' for c in ('centroid_hz', 'spread_hz', 'entropy', 'occupied_hz', 'nearest_offset_hz', 'spacing_hz', 'gap_s'))} FROM f GROUP BY 1"""


def distinct_centres(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "lineitem").select((F.col("l_orderkey") % 500).alias("class"), (F.col("l_partkey") * 7 + F.col("l_suppkey") * 13 + F.col("l_orderkey")).alias("centre"), "l_quantity")
    return fam.distinct_centres(c.groupBy("class", F.col("centre") % 20_000).agg(F.sum("l_quantity").alias("support")).toDF("class", "centre", "support"), ["class"], 100.0)


CENTRES = """WITH RECURSIVE c AS (SELECT l_orderkey % 500 AS class, ((l_partkey * 7 + l_suppkey * 13 + l_orderkey) % 20000)::DOUBLE AS centre, sum(l_quantity)::DOUBLE AS support FROM lineitem GROUP BY ALL),
p AS (SELECT a.class, a.centre AS seed, max({'s': b.support, 'c': -b.centre}) AS m FROM c a JOIN c b ON b.class = a.class AND b.centre BETWEEN a.centre AND a.centre + 100 GROUP BY ALL),
n AS (SELECT p.class, p.seed, 0.0 - p.m.c AS centre, p.m.s AS support, min(c.centre) AS nxt FROM p LEFT JOIN c ON c.class = p.class AND c.centre > 100 - p.m.c GROUP BY ALL),
r AS (SELECT n.* FROM n JOIN (SELECT class, min(seed) AS seed FROM n GROUP BY 1) USING (class, seed) UNION ALL SELECT n.* FROM r JOIN n ON n.class = r.class AND n.seed = r.nxt)
SELECT class, row_number() OVER (PARTITION BY class ORDER BY centre)::INT AS place, centre, support FROM r"""


def top_loadings(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 40).alias("component"), F.concat(F.lit("f"), F.col("l_partkey") % 30).alias("feature")).agg((F.sum("l_linenumber") % 21 - 10).cast("double").alias("loading"))
    return ml.top_loadings(c)


LOADINGS = """WITH c AS (SELECT l_suppkey % 40 AS component, 'f' || l_partkey % 30 AS feature, (sum(l_linenumber) % 21 - 10)::DOUBLE AS loading FROM lineitem GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY abs(loading) DESC, feature)::INT AS rank FROM c) WHERE rank <= 5"""

def bundle_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Every order as a capture of its lines, one episode each; some lack a file on disk, or differ between their lists."""
    k, n = F.col("k"), F.floor(F.col("size_bytes") / 16)
    of = lambda m: (k % m == 0) & (F.col("position") == 0)
    # Dealt by capture once, before hashes are made: all lists of a capture come from this one shuffle of a few numbers.
    item = read(spark, sf, "lineitem").where("l_orderkey is not null").select(F.col("l_orderkey").alias("k"), F.col("l_orderkey").cast("string").alias("capture"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").repartition("capture")
    item = item.withColumn("sha256", F.sha2(F.concat_ws(" ", "l_partkey", "l_suppkey"), 256)).withColumn("size_bytes", (F.col("l_partkey") + 1) * 16)
    place = F.row_number().over(Window.partitionBy("capture").orderBy("l_linenumber", "sha256", "l_extendedprice")) - 1
    f = item.withColumn("position", place).withColumn("path", F.concat_ws("/", "k", "position")).withColumn("episode", F.lit(1))
    formats = {s: s.upper() for s in bundles.SOURCES}
    per = f.groupBy("k", "capture").agg(F.count("*").alias("n"))
    head = lambda s, files, episodes, gap, rate: per.select("capture", F.lit(s).alias("source"), F.lit(formats[s]).alias("format"), F.col("capture").alias("capture_id"), files.cast("bigint").alias("file_count"), F.lit(episodes).cast("bigint").alias("episode_count"), F.lit(gap).cast("double").alias("gap_s"), F.lit(">").alias("comparison"), F.lit(rate).cast("int").alias("sample_rate_hz"), F.lit("complex128").alias("iq_dtype"))
    heads = head("manifest", F.col("n"), None, None, None).unionAll(head("grouping", F.col("n") + F.when(k % 13 == 0, 1).otherwise(0), 1, 4.0, None)).unionAll(head("features", F.lit(None), 1, None, F.when(k % 23 == 0, 24_000).otherwise(25_000)))
    out = bundles.bundle_problems(
        heads, f.select("capture", "position", "path", "size_bytes", "sha256"), f.select("capture", "episode", "position", "path", "size_bytes", F.when(of(7), "x").otherwise(F.col("sha256")).alias("sha256"), F.col("size_bytes").alias("mtime_ns")),
        per.select("capture", F.lit(1).alias("episode"), F.col("n").alias("file_count"), F.col("n").alias("fragment_count")), f.select("capture", "episode", "position", "path", "size_bytes", F.when(of(17), n + 1).otherwise(n).cast("bigint").alias("samples")),
        f.select("capture", "position", F.concat("sha256", F.when(of(19), " ").otherwise("  "), "path").alias("line")), f.where(~of(11)).select("path", "size_bytes", "sha256"), formats)
    return out.select("capture", F.array_join("problems", ", ").alias("problems"))


BUNDLES = """SELECT DISTINCT l_orderkey::VARCHAR AS capture, concat_ws(', ', CASE WHEN l_orderkey % 23 = 0 THEN 'sample parameters' END, CASE WHEN l_orderkey % 13 = 0 THEN 'grouping file count' END, CASE WHEN l_orderkey % 7 = 0 THEN 'grouping size or hash' END,
CASE WHEN l_orderkey % 17 = 0 THEN 'fragment samples' END, CASE WHEN l_orderkey % 19 = 0 THEN 'hash list' END, CASE WHEN l_orderkey % 11 = 0 THEN 'raw file missing' END) AS problems FROM lineitem"""

QUERIES = {
    "bundle_checks": bundle_checks, "line_integrity": line_integrity, "report_log": report_log, "frame_decode": frame_decode, "daq_checks": daq_checks, "width_gate": width_gate, "settings_equal": settings_equal, "ledger_append": ledger_append,
    "repeated_keys": repeated_keys, "hash_lists": hash_lists, "prefix_complete": prefix_complete, "json_digests": json_digests, "evidence_join": evidence_join, "record_problems": record_problems,
    "spectral_rollup": spectral_rollup, "distinct_centres": distinct_centres, "top_loadings": top_loadings,
}
SQL = {
    "bundle_checks": BUNDLES, "line_integrity": INTEGRITY, "report_log": REPORT_LOG, "frame_decode": FRAMES, "daq_checks": DAQ, "width_gate": WIDTH_GATE, "settings_equal": SETTINGS, "ledger_append": LEDGER,
    "repeated_keys": REPEATED, "hash_lists": HASH_LISTS, "prefix_complete": PREFIX, "json_digests": DIGESTS, "evidence_join": EVIDENCE, "record_problems": RECORDS,
    "spectral_rollup": ROLLUP, "distinct_centres": CENTRES, "top_loadings": LOADINGS,
}
