"""Queries of logs, captures, histories, models and associations over the test tables, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyvane.functions.stats import shown
from skyvane.operators import association as a
from skyvane.operators import partitions
from skyvane.operators import capture as c
from skyvane.operators import families as fam
from skyvane.operators import history as h
from skyvane.operators import ml, rollups
from skyvane.plans import sqltext as q
from skyvane.sources import logs
from skyvane.sources.observations import bursts

B, show = q.B, q.shown


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[shown(x).alias(x) if x in names else F.col(x) for x in df.columns])


def kv_lenient(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with spaces, parts without '=', values with '=' and repeated keys."""
    n = F.col("event_id")
    line = F.concat(F.lit("session_id= S"), F.col("user_id"), F.when(n % 3 == 0, ",noise").otherwise(""), F.lit(", quality ="), F.when(n % 4 == 0, "STABLE").otherwise("odd=x"), F.lit(",n=1,n="), n, F.lit(",bearing="), F.when(n % 5 == 0, "NA").otherwise(n.cast("string")))
    m = read(spark, sf, "events").select("event_id", logs.lenient_map(line).alias("m"))
    return m.select("event_id", *[F.col("m")[k].alias(k) for k in ("session_id", "quality", "n")], logs.number(F.col("m")["bearing"]).alias("bearing"), F.size("m").alias("keys"))


KV = """SELECT event_id, 'S' || user_id AS session_id, CASE WHEN event_id % 4 = 0 THEN 'STABLE' ELSE 'odd=x' END AS quality, event_id::VARCHAR AS n, CASE WHEN event_id % 5 <> 0 THEN event_id::DOUBLE END AS bearing, 4 AS keys FROM events"""


def files(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01"))
    return o.select((F.col("o_custkey") % 50).alias("capture"), F.concat(F.lit("f"), "o_orderkey").alias("name"), (day.cast("bigint") * 1_000_000_000 + F.col("o_orderkey") % 1000).alias("mtime_ns"))


FILES = "fl AS (SELECT o_custkey % 50 AS capture, 'f' || o_orderkey AS name, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::BIGINT * 1000000000 + o_orderkey % 1000 AS mtime_ns FROM orders)"


def file_episodes(spark: SparkSession, sf: str) -> DataFrame:
    return c.file_episodes(files(spark, sf), ["capture"], 10_000_000_000)


FILE_EPISODES = f"""
WITH {FILES}, g AS (SELECT *, mtime_ns - lag(mtime_ns) OVER w AS gap, CASE WHEN mtime_ns - lag(mtime_ns) OVER w <= 10000000000 THEN 0 ELSE 1 END AS nw FROM fl WINDOW w AS (PARTITION BY capture ORDER BY mtime_ns, name)),
e AS (SELECT *, sum(nw) OVER (PARTITION BY capture ORDER BY mtime_ns, name) AS episode FROM g)
SELECT capture, episode::BIGINT AS episode, count(*)::BIGINT AS files, min(mtime_ns) AS start_ns, max(mtime_ns) AS end_ns, max(mtime_ns) - min(mtime_ns) AS span_ns, max(gap) FILTER (nw = 1) AS preceding_gap_ns FROM e GROUP BY ALL"""


def manifest_diff(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("size_bytes"), F.col("p_brand").alias("sha256"))
    after = p.where("path % 7 <> 0").withColumn("size_bytes", F.when(F.col("path") % 11 == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")))
    return c.manifest_diff(p.where("path % 5 <> 0"), after, "path", ["size_bytes", "sha256"])


DIFF = """SELECT p_partkey AS path, CASE WHEN p_partkey % 5 = 0 THEN 'NEW' WHEN p_partkey % 7 = 0 THEN 'REMOVED' ELSE 'CHANGED' END AS change FROM part
WHERE (p_partkey % 5 = 0 AND p_partkey % 7 <> 0) OR (p_partkey % 7 = 0 AND p_partkey % 5 <> 0) OR (p_partkey % 11 = 0 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0)"""


def verify_files(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("size_bytes"), F.col("p_brand").alias("sha256"))
    disk = p.where("path % 7 <> 0").withColumn("size_bytes", F.when(F.col("path") % 11 == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes"))).withColumn("sha256", F.when(F.col("path") % 13 == 0, "x").otherwise(F.col("sha256")))
    return c.verify_files(p, disk)


VERIFY = "SELECT p_partkey AS path, CASE WHEN p_partkey % 7 = 0 THEN 'MISSING' WHEN p_partkey % 11 = 0 THEN 'SIZE-FAIL' WHEN p_partkey % 13 = 0 THEN 'HASH-FAIL' ELSE 'OK' END AS verdict FROM part"
DAY_US = 86_400_000_000


def marks_and_files(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    b = bursts(spark, sf).withColumn("capture", F.col("event_id") % 20).withColumn("at", F.unix_micros("time"))
    marks = b.where("quality = 'LOW_QUALITY'").select("capture", F.concat(F.lit("A"), "event_id").alias("label"), "at")
    return marks, b.where("frequency_mhz > 434.5").select("capture", F.col("at").alias("time"))


MARKS = '''mk AS (SELECT event_id % 20 AS capture, 'A' || event_id AS label, epoch_us(time) AS "at" FROM bursts WHERE quality = 'LOW_QUALITY'), fi AS (SELECT event_id % 20 AS capture, epoch_us(time) AS time FROM bursts WHERE frequency_mhz > 434.5)'''


def activation_acquired(spark: SparkSession, sf: str) -> DataFrame:
    return c.activation_acquired(*marks_and_files(spark, sf), ["capture"], 6 * 3_600_000_000)


ACQUIRED = f"""WITH {B}, {MARKS} SELECT m.capture, m.label, m."at", count(f.time)::BIGINT AS files, CASE WHEN count(f.time) > 0 THEN 'ACQUIRED' ELSE 'NOT_ACQUIRED' END AS state
FROM mk m LEFT JOIN fi f ON f.capture = m.capture AND f.time > m."at" AND f.time <= m."at" + 21600000000 GROUP BY ALL"""


def acquisition_completeness(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(c.acquisition_completeness(activation_acquired(spark, sf), ["capture"]), "completeness")


COMPLETENESS = f"SELECT capture, count(*)::BIGINT AS activations, count(*) FILTER (files > 0) AS acquired, {show('(count(*) FILTER (files > 0))::DOUBLE / count(*)')} AS completeness FROM ({ACQUIRED}) GROUP BY 1"


def activation_position(spark: SparkSession, sf: str) -> DataFrame:
    marks, found = marks_and_files(spark, sf)
    finish = found.groupBy("capture").agg((F.max("time") + 1).alias("finish"))
    return c.activation_position(marks, found, finish, ["capture"])


POSITION = f"""WITH {B}, {MARKS}, n AS (SELECT *, lead("at") OVER (PARTITION BY capture ORDER BY "at", label) AS nx FROM mk), e AS (SELECT capture, max(time) + 1 AS fin FROM fi GROUP BY 1)
SELECT n.capture, n.label, n."at", count(f.time)::BIGINT AS files, min(f.time - n."at") AS first_delay, max(f.time - n."at") AS last_delay FROM n LEFT JOIN e USING (capture) LEFT JOIN fi f ON f.capture = n.capture AND f.time >= n."at" AND f.time < coalesce(nx, fin) GROUP BY ALL"""

FEATURES = ["peak_power", "max_confidence", "doa_width", "single_peak_ratio"]


def history_knn(spark: SparkSession, sf: str) -> DataFrame:
    b = bursts(spark, sf).withColumn("doa_width", F.coalesce("doa_width", F.lit(1.0)))
    return rounded(h.history_neighbours(b, ["session_id"], "event_id", FEATURES), "distance")


KNN = f"""
WITH {B}, x AS (SELECT session_id, event_id, peak_power, max_confidence, coalesce(doa_width, 1) AS doa_width, single_peak_ratio FROM bursts),
t AS (SELECT *, {', '.join(f'stddev_pop({f}) OVER w AS s_{f}' for f in FEATURES)} FROM x WINDOW w AS (PARTITION BY session_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT t.session_id, t.event_id AS target, x.event_id AS prior, sqrt(({' + '.join(f'CASE WHEN s_{f} > 0 THEN pow((t.{f} - x.{f}) / s_{f}, 2) ELSE 0 END' for f in FEATURES)}) / nullif({' + '.join(f'(s_{f} > 0)::INT' for f in FEATURES)}, 0)) AS distance FROM t JOIN x ON x.session_id = t.session_id AND x.event_id < t.event_id)
SELECT session_id, target, rank::INT AS rank, prior, {show('distance')} AS distance FROM (SELECT *, row_number() OVER (PARTITION BY session_id, target ORDER BY distance NULLS LAST, prior) AS rank FROM p) WHERE rank <= 3"""


def history_scope(spark: SparkSession, sf: str) -> DataFrame:
    out = h.prior_scope(bursts(spark, sf).select("session_id", "event_id", "peak_power"), ["session_id"], "event_id", "peak_power")
    return rounded(out, "peak_power", "prior_mean", "prior_std")


SCOPE = f"""WITH {B} SELECT session_id, event_id, {show('peak_power')} AS peak_power, count(peak_power) OVER w AS prior_n, {show('avg(peak_power) OVER w')} AS prior_mean, {show('stddev_pop(peak_power) OVER w')} AS prior_std
FROM bursts WINDOW w AS (PARTITION BY session_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


def scored_sessions(spark: SparkSession, sf: str) -> DataFrame:
    b = bursts(spark, sf)
    return b.select("session_id", F.col("event_id").alias("n"), (F.col("event_id") * 7 % 5 % 3).alias("cluster"), F.concat(F.lit("B"), F.col("event_id") % 6).alias("block"), (F.col("peak_power") / -40).alias("ratio"), F.col("max_confidence").alias("nearest"), (F.col("max_confidence") + 1).alias("second"))


SCORED = "sc AS (SELECT session_id, event_id AS n, event_id * 7 % 5 % 3 AS cluster, 'B' || event_id % 6 AS block, peak_power / -40 AS ratio, max_confidence AS nearest, max_confidence + 1 AS second FROM bursts)"


def cluster_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return h.cluster_transitions(scored_sessions(spark, sf), ["session_id"])


TRANSITIONS = f"WITH {B}, {SCORED}, l AS (SELECT session_id, cluster, lead(cluster) OVER (PARTITION BY session_id ORDER BY n) AS nx FROM sc) SELECT session_id, cluster AS from_cluster, nx AS to_cluster, count(*)::BIGINT AS n FROM l WHERE nx IS NOT NULL GROUP BY ALL"


def block_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = scored_sessions(spark, sf).withColumn("block", F.concat("block", "session_id"))
    return rounded(h.block_summary(s), "mean_nearest", "mean_second", "mean_ratio")


BLOCKS = f"""WITH {B}, {SCORED} SELECT block || session_id AS block, count(*)::BIGINT AS sessions, string_agg('C' || cluster, ' → ' ORDER BY n) AS sequence, count(*) FILTER (ratio <= 1) AS within, count(*) FILTER (NOT ratio <= 1) AS outside,
  {show('avg(nearest)')} AS mean_nearest, {show('avg(second)')} AS mean_second, {show('avg(ratio)')} AS mean_ratio FROM sc GROUP BY block || session_id"""


def common_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return h.cluster_sets(scored_sessions(spark, sf).where("not (block = 'B2' and cluster = 1)"))


COMMON = f"WITH {B}, {SCORED} SELECT cluster, count(DISTINCT block)::BIGINT AS blocks, count(DISTINCT block) = (SELECT count(DISTINCT block) FROM sc) AS common FROM sc WHERE NOT (block = 'B2' AND cluster = 1) GROUP BY 1"


def session_number(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id")
    sid = F.concat(F.when(n % 10 == 0, "OTHER-").otherwise("TPMS-NATURAL-"), F.lpad((n % 20).cast("string"), 3, "0"), F.lit("-2026"), F.lpad((n % 14 + 1).cast("string"), 2, "0"), F.lpad((n % 28 + 1).cast("string"), 2, "0"), F.lit("-101112"))
    number = h.session_number(sid)
    return read(spark, sf, "events").select("event_id", number.alias("number"), h.block_of(number).alias("block"))


NUMBER = """WITH x AS (SELECT event_id, CASE WHEN event_id % 10 <> 0 AND event_id % 14 + 1 <= 12 AND NOT (event_id % 14 + 1 = 2 AND event_id % 28 + 1 > 28) THEN (event_id % 20)::INT END AS number FROM events)
SELECT event_id, number, CASE WHEN number IN (5, 6, 7) THEN 'A' WHEN number IN (8, 9, 10) THEN 'B' WHEN number IN (11, 12, 13) THEN 'C' WHEN number IN (15, 16, 17) THEN 'D' END AS block FROM x"""



def history_bundle(spark: SparkSession, sf: str) -> DataFrame:
    b = bursts(spark, sf).withColumn("cluster", F.col("event_id") % 3)
    out = h.history_bundle(b, ["session_id"], "event_id", "cluster", ["peak_power", "max_confidence"])
    return rounded(out, *[f"{p}_{f}" for p in ("mean", "delta") for f in ("peak_power", "max_confidence")])


BUNDLE = f"""WITH {B}, x AS (SELECT session_id, event_id, event_id % 3 AS cluster, peak_power, max_confidence FROM bursts)
SELECT session_id, event_id, cluster, count(*) OVER w AS prior_count, count(*) OVER o AS same_cluster_count, {', '.join(show(f'avg({f}) OVER o') + f' AS mean_{f}, ' + show(f'{f} - avg({f}) OVER o') + f' AS delta_{f}' for f in ('peak_power', 'max_confidence'))} FROM x
WINDOW w AS (PARTITION BY session_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), o AS (PARTITION BY session_id, cluster ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


def prior_cluster_counts(spark: SparkSession, sf: str) -> DataFrame:
    b = bursts(spark, sf).withColumn("cluster", F.col("event_id") % 3)
    return h.prior_cluster_counts(b, ["session_id"], "event_id", "cluster")


PRIOR = f"""WITH {B}, x AS (SELECT session_id, event_id, event_id % 3 AS cluster FROM bursts), k AS (SELECT DISTINCT session_id, cluster AS of_cluster FROM x),
c AS (SELECT x.session_id, x.event_id, k.of_cluster, count(*) FILTER (x.cluster = k.of_cluster) OVER (PARTITION BY x.session_id, k.of_cluster ORDER BY x.event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM x JOIN k USING (session_id))
SELECT * FROM c WHERE n > 0"""


def track_spacings(spark: SparkSession, sf: str) -> DataFrame:
    item = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("episode"), (F.col("l_suppkey") % 4).alias("track_id"), F.col("l_linenumber").alias("fragment")).agg(F.min("l_partkey").cast("double").alias("frequency_hz"))
    return rollups.track_spacings(item, ["episode"])


SPACINGS = """WITH m AS (SELECT l_orderkey AS episode, l_suppkey % 4 AS track_id, l_linenumber AS fragment, min(l_partkey)::DOUBLE AS f FROM lineitem GROUP BY ALL)
SELECT a.episode, a.track_id AS lower, b.track_id AS higher, count(*)::BIGINT AS common, median(b.f - a.f) AS median_hz, min(b.f - a.f) AS min_hz, max(b.f - a.f) AS max_hz FROM m a JOIN m b ON a.episode = b.episode AND a.fragment = b.fragment AND a.track_id < b.track_id GROUP BY ALL HAVING count(*) >= 2"""


def sample_median(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.sample_median(read(spark, sf, "lineitem"), ["l_suppkey"], "l_quantity")


MEDIAN = "SELECT l_suppkey, median(l_quantity) AS median FROM lineitem GROUP BY 1"


def fragments(spark: SparkSession, sf: str) -> DataFrame:
    item = read(spark, sf, "lineitem")
    return item.select((F.col("l_orderkey") % 500).alias("episode"), (F.col("l_quantity") * 100).cast("bigint").alias("samples"), (F.col("l_discount") + 1).alias("rms"), (F.col("l_tax") + 1).alias("mean"), F.col("l_discount").alias("peak"), (F.col("l_partkey") % 997).cast("double").alias("strongest_hz"))


def episode_magnitudes(spark: SparkSession, sf: str) -> DataFrame:
    out = rollups.magnitude_episodes(fragments(spark, sf), ["episode"])
    return rounded(out, *[c for c in out.columns if c not in ("episode", "fragments", "samples")])


MAGNITUDES = f"""WITH f AS (SELECT l_orderkey % 500 AS episode, (l_quantity * 100)::BIGINT AS samples, l_discount + 1 AS rms, l_tax + 1 AS mean, l_discount AS peak, (l_partkey % 997)::DOUBLE AS strongest FROM lineitem)
SELECT episode, count(*)::BIGINT AS fragments, sum(samples)::BIGINT AS samples, {', '.join(show(x) + f' AS {n}' for n, x in (('duration_s', 'sum(samples) / 25000'), ('min_duration_s', 'min(samples) / 25000'), ('max_duration_s', 'max(samples) / 25000'), ('median_duration_s', 'median(samples / 25000)'), ('rms', 'sqrt(sum(rms * rms * samples) / sum(samples))'), ('mean', 'sum(mean * samples) / sum(samples)'), ('peak', 'max(peak)'), ('median_offset_hz', 'median(strongest)'), ('min_offset_hz', 'min(strongest)'), ('max_offset_hz', 'max(strongest)'), ('offset_spread_hz', 'max(strongest) - min(strongest)')))} FROM f GROUP BY 1"""


def slot_events(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").select("event_id", (F.col("event_id") % 8).alias("ordinal"), F.lit(1000).cast("bigint").alias("start_ns"), (F.col("event_id") * 20_000_000).alias("actual_ns"))
    return c.slot_events(e, ["event_id"], "start_ns").select("event_id", "scheduled_ns", "problem", "lateness_ns")


SLOTS = """WITH x AS (SELECT event_id, event_id % 8 AS o, event_id * 20000000 AS a FROM events), y AS (SELECT *, 1000 + (o - 1) * 30000000000 AS b FROM x)
SELECT event_id, b + 5000000000 AS scheduled_ns, CASE WHEN o NOT BETWEEN 1 AND 6 THEN 'ORDINAL' WHEN a < b + 5000000000 OR a >= b + 30000000000 THEN 'OUTSIDE_SLOT' END AS problem, CASE WHEN o BETWEEN 1 AND 6 AND a >= b + 5000000000 AND a < b + 30000000000 THEN a - b - 5000000000 END AS lateness_ns FROM y"""

DIMS = [f"f{i}" for i in range(11)]


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "embeddings")
    x = lambda i: F.floor(F.col("embedding")[i].cast("double") * 4096) / 4096
    return e.select("vec_id", F.col("label").alias("cluster"), *[F.when((F.col("vec_id") % 17 != 0) | F.lit(i != 3), x(i) * (i + 1)).alias(f) for i, f in enumerate(DIMS)])


def score_sessions(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    train = v.where("vec_id % 2 = 0")
    params = ml.model_params(train, DIMS)
    model = ml.freeze(ml.standardized(train, DIMS, params))
    out = ml.score(ml.standardized(v.where("vec_id % 2 = 1").drop("cluster"), DIMS, params), model)
    return rounded(out.select("vec_id", "cluster", "nearest", "second", "ratio", "separation", "novelty"), "nearest", "second", "ratio", "separation")


SCORE = f"""
WITH v AS (SELECT vec_id, label AS cluster, {', '.join((f'CASE WHEN vec_id % 17 <> 0 THEN floor(embedding[{i + 1}]::DOUBLE * 4096) / 4096 * {i + 1} END' if i == 3 else f'floor(embedding[{i + 1}]::DOUBLE * 4096) / 4096 * {i + 1}') + f' AS {f}' for i, f in enumerate(DIMS)) } FROM embeddings),
m AS (SELECT {', '.join(f'median({f}) AS m_{f}' for f in DIMS)} FROM v WHERE vec_id % 2 = 0),
z AS (SELECT vec_id, cluster, {', '.join(f'coalesce({f}, m_{f}) AS {f}' for f in DIMS)} FROM v, m),
p AS (SELECT {', '.join(f'avg({f}) AS a_{f}, CASE WHEN stddev_pop({f}) > 0 THEN stddev_pop({f}) ELSE 1 END AS s_{f}' for f in DIMS)} FROM z WHERE vec_id % 2 = 0),
x AS (SELECT vec_id, cluster, {', '.join(f'({f} - a_{f}) / s_{f} AS {f}' for f in DIMS)} FROM z, p),
c AS (SELECT cluster, {', '.join(f'avg({f}) AS {f}' for f in DIMS)} FROM x WHERE vec_id % 2 = 0 GROUP BY 1),
d AS (SELECT x.vec_id, x.cluster AS own, c.cluster, sqrt({' + '.join(f'pow(x.{f} - c.{f}, 2)' for f in DIMS)}) AS d FROM x, c),
r AS (SELECT cluster, max(d) AS mx FROM d WHERE vec_id % 2 = 0 AND own = cluster GROUP BY 1),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) AS rn, lead(d) OVER (PARTITION BY vec_id ORDER BY d, cluster) AS nx FROM d WHERE vec_id % 2 = 1)
SELECT vec_id, cluster, {show('d')} AS nearest, {show('nx')} AS second, {show('CASE WHEN mx > 0 THEN d / mx ELSE 1e999 END')} AS ratio, {show('CASE WHEN d > 0 THEN nx / d ELSE 1e999 END')} AS separation, CASE WHEN d / mx <= 1 THEN 'WITHIN_OBSERVED_TRAINING_RANGE' ELSE 'OUTSIDE_OBSERVED_TRAINING_RANGE' END AS novelty FROM k JOIN r USING (cluster) WHERE rn = 1"""


def ari(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").select((F.col("user_id") % 30).alias("trial"), F.col("event_type").alias("a"), (F.col("event_id") % 4 + F.when(F.col("event_type") == "view", 9).otherwise(0)).alias("b"))
    return rounded(ml.adjusted_rand(e, "a", "b", ["trial"]), "ari")


ARI = f"""
WITH e AS (SELECT user_id % 30 AS trial, event_type AS a, event_id % 4 + CASE WHEN event_type = 'view' THEN 9 ELSE 0 END AS b FROM events), c AS (SELECT trial, a, b, count(*) AS n FROM e GROUP BY ALL),
x AS (SELECT trial, sum(n * (n - 1) / 2) AS s, sum(n) * (sum(n) - 1) / 2 AS t FROM c GROUP BY 1), y AS (SELECT trial, sum(n * (n - 1) / 2) AS sa FROM (SELECT trial, a, sum(n) AS n FROM c GROUP BY ALL) GROUP BY 1), w AS (SELECT trial, sum(n * (n - 1) / 2) AS sb FROM (SELECT trial, b, sum(n) AS n FROM c GROUP BY ALL) GROUP BY 1)
SELECT trial, {show('(s - sa * sb / t) / ((sa + sb) / 2 - sa * sb / t)')} AS ari FROM x JOIN y USING (trial) JOIN w USING (trial)"""


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Rows alike are one candidate."""
    return read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("episode"), F.concat_ws("-", F.lit("c"), "l_linenumber", "l_partkey", "l_suppkey").alias("candidate_id"),
        (F.col("l_linenumber") - F.col("l_suppkey") % 2).cast("int").alias("fragment"), (F.col("l_partkey") * 37 % 160).cast("double").alias("frequency_hz"), (F.col("l_partkey") % 9 > 0).alias("eligible"))


def components(spark: SparkSession, sf: str) -> DataFrame:
    return candidates(spark, sf).distinct()


COMP = "co AS (SELECT DISTINCT l_orderkey AS episode, 'c-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS candidate_id, (l_linenumber - l_suppkey % 2)::INT AS fragment, (l_partkey * 37 % 160)::DOUBLE AS frequency_hz, l_partkey % 9 > 0 AS eligible FROM lineitem)"
EDGE = "ed AS (SELECT a.episode, a.candidate_id AS from_id, b.candidate_id AS to_id, b.fragment - a.fragment AS gap, b.frequency_hz - a.frequency_hz AS difference_hz FROM co a JOIN co b ON a.episode = b.episode AND b.fragment - a.fragment IN (1, 2) AND abs(b.frequency_hz - a.frequency_hz) <= 50 AND a.eligible AND b.eligible)"


def assoc_edges(spark: SparkSession, sf: str) -> DataFrame:
    return a.association_edges(components(spark, sf), ["episode"])


def track_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Connected groups of every episode with their support, range and verdicts."""
    comp = components(spark, sf)
    out = a.track_episodes(comp, comp.select("episode", "fragment", F.lit(True).alias("usable")), ["episode"])
    t = out.select("episode", "status", F.explode_outer("tracks").alias("t")).where("t is not null")
    return rounded(t.select("episode", "status", "t.track_id", F.array_join(F.array_sort("t.members"), ",").alias("members"), "t.support", "t.coverage", "t.median_hz", "t.range_hz", "t.coherent", "t.persistent"), "coverage", "median_hz", "range_hz")


GROUPS = f"""
WITH RECURSIVE {COMP}, {EDGE}, un AS (SELECT episode, from_id AS x, to_id AS y FROM ed UNION ALL SELECT episode, to_id, from_id FROM ed),
rc AS (SELECT episode, candidate_id AS x, candidate_id AS y FROM co WHERE eligible UNION SELECT rc.episode, rc.x, un.y FROM rc JOIN un ON un.episode = rc.episode AND un.x = rc.y),
gr AS (SELECT episode, x AS candidate_id, min(y) AS root FROM rc GROUP BY ALL), fr AS (SELECT episode, count(DISTINCT fragment) AS nf FROM co GROUP BY 1),
g AS (SELECT episode, root, string_agg(candidate_id, ',' ORDER BY candidate_id) AS members, count(DISTINCT fragment)::INT AS support, count(*) AS n, median(frequency_hz) AS median_hz, max(frequency_hz) - min(frequency_hz) AS range_hz, min(fragment) AS mf FROM gr JOIN co USING (episode, candidate_id) GROUP BY ALL),
v AS (SELECT *, support / nf AS coverage, n = support AND range_hz <= 100 AS coherent, n = support AND range_hz <= 100 AND support >= 3 AND support / nf >= 0.6 AS persistent FROM g JOIN fr USING (episode)),
s AS (SELECT episode, CASE WHEN count(*) FILTER (persistent) > 1 THEN 'MULTIPLE_PERSISTENT_TRACKS' WHEN count(*) FILTER (NOT coherent AND support >= 2) > 0 OR count(*) FILTER (coherent AND support >= 2) > 1 THEN 'AMBIGUOUS_ASSOCIATION' WHEN count(*) FILTER (persistent) = 0 THEN 'INSUFFICIENT_SUPPORT' ELSE 'UNIQUE_PERSISTENT_TRACK' END AS status FROM v GROUP BY 1)
SELECT episode, status, 'T' || printf('%03d', row_number() OVER (PARTITION BY episode ORDER BY median_hz, mf, root)) AS track_id, members, support, {show('coverage')} AS coverage, {show('median_hz')} AS median_hz, {show('range_hz')} AS range_hz, coherent, persistent FROM v JOIN s USING (episode)"""


def association_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Exact partitions of every episode within a margin of 0.25: counts and primary tracks."""
    comp = candidates(spark, sf)
    out = partitions.associate(comp, comp.select("episode", "fragment", F.lit(True).alias("usable")), ["episode"], 0.25, alike=False)
    return rounded(out.select("episode", "state", "status", "links", "cost", "hypotheses", F.size("invariant").alias("invariant_paths"), F.size("possible").alias("possible_paths"), F.array_join("primary", ",").alias("primary")), "cost")


def peak_pairwise(spark: SparkSession, sf: str) -> DataFrame:
    item = read(spark, sf, "lineitem")
    return fam.peak_pairs(item.select(F.col("l_orderkey").alias("event"), F.col("l_linenumber").alias("rank"), (F.col("l_partkey") % 5000 - 2500).cast("double").alias("frequency_hz")), ["event"])


PAIRS = "WITH p AS (SELECT l_orderkey AS event, l_linenumber AS rank, (l_partkey % 5000 - 2500)::DOUBLE AS f FROM lineitem) SELECT a.event, a.rank AS rank_a, b.rank AS rank_b, b.f - a.f AS difference_hz, abs(b.f - a.f) AS spacing_hz FROM p a JOIN p b ON a.event = b.event AND a.rank < b.rank"


def spacings(spark: SparkSession, sf: str) -> DataFrame:
    item = read(spark, sf, "lineitem")
    return item.select(F.concat(F.lit("S"), F.col("l_suppkey") % 2 + 1).alias("sensor"), (F.col("l_suppkey") % 6).alias("capture"), F.col("l_orderkey").alias("event"), F.floor(F.col("l_partkey") * 13 % 4000 / 20).cast("double").alias("spacing_hz"))


SPACE = "sp AS (SELECT 'S' || (l_suppkey % 2 + 1) AS sensor, l_suppkey % 6 AS capture, l_orderkey AS event, floor((l_partkey * 13 % 4000)::DOUBLE / 20) AS spacing_hz FROM lineitem)"
RECUR = f"""
WITH {SPACE}, ce AS (SELECT DISTINCT spacing_hz AS centre FROM sp), ev AS (SELECT sensor, capture, count(DISTINCT event) AS n FROM sp GROUP BY ALL),
hi AS (SELECT s.sensor, s.capture, c.centre, count(DISTINCT s.event) AS hits FROM sp s JOIN ce c ON abs(s.spacing_hz - c.centre) <= 5 GROUP BY ALL),
fr AS (SELECT e.sensor, e.capture, c.centre, coalesce(h.hits, 0)::BIGINT AS hits, coalesce(h.hits, 0) / e.n AS fraction FROM ev e CROSS JOIN ce c LEFT JOIN hi h USING (sensor, capture, centre))"""


def family_recurrence(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(fam.recurrence(spacings(spark, sf), 5.0).drop("captures"), "fraction")


def family_class(spark: SparkSession, sf: str) -> DataFrame:
    return fam.classify(fam.recurrence(spacings(spark, sf), 5.0), 0.06, 0.05)


FAMILY = f"""{RECUR}, x AS (SELECT centre, {', '.join(f"min(fraction) FILTER (sensor = '{s}') AS lo_{s}, max(fraction) FILTER (sensor = '{s}') AS hi_{s}" for s in ('S1', 'S2'))} FROM fr GROUP BY 1)
SELECT centre, CASE WHEN lo_S1 >= 0.06 AND lo_S2 >= 0.06 THEN 'SHARED' WHEN lo_S1 >= 0.06 AND hi_S2 < 0.05 THEN 'S1_ONLY' WHEN lo_S2 >= 0.06 AND hi_S1 < 0.05 THEN 'S2_ONLY' ELSE 'UNSTABLE' END AS family FROM x"""


def dice_concordance(spark: SparkSession, sf: str) -> DataFrame:
    item = read(spark, sf, "lineitem")
    m = item.select((F.col("l_orderkey") / 2).cast("bigint").alias("pair"), (F.col("l_orderkey") % 2).alias("side"), F.col("l_linenumber").alias("ordinal"), (F.col("l_partkey") % 120).cast("double").alias("frequency_hz"))
    m = m.groupBy("pair", "side", "ordinal").agg(F.min("frequency_hz").alias("frequency_hz"))
    return rounded(fam.dice(m.where("side = 0"), m.where("side = 1"), ["pair"]), "dice")


DICE = f"""
WITH m AS (SELECT l_orderkey // 2 AS pair, l_orderkey % 2 AS side, l_linenumber AS ordinal, min((l_partkey % 120)::DOUBLE) AS f FROM lineitem GROUP BY ALL), n AS (SELECT pair, count(*) FILTER (side = 0) AS p, count(*) FILTER (side = 1) AS q FROM m GROUP BY 1),
h AS (SELECT a.pair, count(*) AS k FROM m a JOIN m b ON a.pair = b.pair AND a.side = 0 AND b.side = 1 AND a.ordinal = b.ordinal AND abs(a.f - b.f) <= 25 GROUP BY 1)
SELECT pair, p::BIGINT AS left_members, q::BIGINT AS right_members, coalesce(k, 0)::BIGINT AS matched, {show('2.0 * coalesce(k, 0) / (p + q)')} AS dice FROM n LEFT JOIN h USING (pair)"""


def capture_delta(spark: SparkSession, sf: str) -> DataFrame:
    item = read(spark, sf, "lineitem").select((F.col("l_suppkey") % 40).alias("capture"), F.col("l_orderkey").alias("episode"), (F.col("l_partkey") % 997).cast("double").alias("value"))
    return rounded(fam.capture_delta(item), "median", "range", "signed", "absolute")


DELTA = f"""
WITH e AS (SELECT l_suppkey % 40 AS capture, l_orderkey AS episode, median((l_partkey % 997)::DOUBLE) AS m FROM lineitem GROUP BY ALL), c AS (SELECT capture, median(m) AS median, max(m) - min(m) AS range FROM e GROUP BY 1),
p AS (SELECT a.capture, a.median, a.range, b.capture AS nearest, a.median - b.median AS signed, row_number() OVER (PARTITION BY a.capture ORDER BY abs(a.median - b.median), b.capture) AS rn FROM c a LEFT JOIN c b ON b.capture < a.capture)
SELECT capture, {show('median')} AS median, {show('range')} AS range, nearest AS nearest_capture, {show('signed')} AS signed, {show('abs(signed)')} AS absolute FROM p WHERE rn = 1"""


def contrast_runs(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("bin", "v")).withColumn("contrast", F.floor(F.col("v").cast("double") * 1000) / 10)
    return fam.runs_above(e, ["vec_id"], "bin", "contrast", 6.0)


RUNS = """WITH e AS (SELECT vec_id, i - 1 AS bin, floor(embedding[i]::DOUBLE * 1000) / 10 AS c FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
g AS (SELECT *, bin - row_number() OVER (PARTITION BY vec_id ORDER BY bin) AS k FROM e WHERE c >= 6) SELECT vec_id, min(bin)::INT AS first, max(bin)::INT AS last, count(*)::BIGINT AS length, max(c) AS top FROM g GROUP BY vec_id, k"""


def envelope_events(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").where("o_totalprice > 150000").select((F.col("o_custkey") % 25).alias("file"), F.col("o_orderkey").alias("sample"))
    return fam.join_active(o, ["file"], "sample", 26, 30)


EVENTS = """WITH a AS (SELECT o_custkey % 25 AS file, o_orderkey AS sample FROM orders WHERE o_totalprice > 150000), g AS (SELECT *, CASE WHEN sample - lag(sample) OVER (PARTITION BY file ORDER BY sample) <= 26 THEN 0 ELSE 1 END AS n FROM a),
e AS (SELECT *, sum(n) OVER (PARTITION BY file ORDER BY sample) AS k FROM g) SELECT file, min(sample) AS start, max(sample) AS "end", count(*)::BIGINT AS active FROM e GROUP BY file, k HAVING max(sample) - min(sample) + 1 >= 30"""


def multiset_equal(spark: SparkSession, sf: str) -> DataFrame:
    """Values whose number differs between two bags."""
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderpriority")
    left, right = o.where("o_orderpriority <> '5-LOW'").select("k"), o.where("o_orderpriority <> '1-URGENT'").select("k")
    return left.exceptAll(right).select("k", F.lit("left").alias("side")).unionAll(right.exceptAll(left).select("k", F.lit("right").alias("side"))).groupBy("k", "side").agg(F.count("*").alias("n"))


BAGS = """WITH c AS (SELECT o_custkey AS k, count(*) FILTER (o_orderpriority <> '5-LOW') - count(*) FILTER (o_orderpriority <> '1-URGENT') AS d FROM orders GROUP BY 1) SELECT k, CASE WHEN d > 0 THEN 'left' ELSE 'right' END AS side, abs(d)::BIGINT AS n FROM c WHERE d <> 0"""


def parameter_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return a.parameter_matrix(spark, ("representation", ["native", "grid_sigma0", "grid_sigma5", "grid_sigma10", "grid_sigma20"]), ("width_hz", [100.0, 150.0, 200.0, 250.0, 300.0, 400.0, 500.0, float("inf")]), ("association", ["connected", "paths_margin0", "paths_margin0.25", "paths_margin1"]))


MATRIX = """SELECT (r.i * 32 + w.i * 4 + a.i)::INT AS arm, r.v AS representation, w.v AS width_hz, a.v AS association FROM (VALUES (0, 'native'), (1, 'grid_sigma0'), (2, 'grid_sigma5'), (3, 'grid_sigma10'), (4, 'grid_sigma20')) r(i, v),
(VALUES (0, 100.0::DOUBLE), (1, 150), (2, 200), (3, 250), (4, 300), (5, 400), (6, 500), (7, 'inf'::DOUBLE)) w(i, v), (VALUES (0, 'connected'), (1, 'paths_margin0'), (2, 'paths_margin0.25'), (3, 'paths_margin1')) a(i, v)"""

QUERIES = {
    "kv_lenient": kv_lenient, "file_episodes": file_episodes, "manifest_diff": manifest_diff, "verify_files": verify_files, "activation_acquired": activation_acquired, "acquisition_completeness": acquisition_completeness,
    "activation_position": activation_position, "history_knn": history_knn, "history_scope": history_scope, "cluster_transitions": cluster_transitions, "block_summary": block_summary, "common_clusters": common_clusters,
    "session_number": session_number, "score_sessions": score_sessions, "ari": ari, "assoc_edges": assoc_edges, "track_groups": track_groups, "association_exact": association_exact, "peak_pairwise": peak_pairwise,
    "family_recurrence": family_recurrence, "family_class": family_class, "dice_concordance": dice_concordance, "capture_delta": capture_delta, "contrast_runs": contrast_runs, "envelope_events": envelope_events,
    "multiset_equal": multiset_equal, "parameter_matrix": parameter_matrix, "history_bundle": history_bundle, "prior_cluster_counts": prior_cluster_counts, "track_spacings": track_spacings, "sample_median": sample_median,
    "episode_magnitudes": episode_magnitudes, "slot_events": slot_events,
}
SQL = {
    "kv_lenient": KV, "file_episodes": FILE_EPISODES, "manifest_diff": DIFF, "verify_files": VERIFY, "activation_acquired": ACQUIRED, "acquisition_completeness": COMPLETENESS,
    "activation_position": POSITION, "history_knn": KNN, "history_scope": SCOPE, "cluster_transitions": TRANSITIONS, "block_summary": BLOCKS, "common_clusters": COMMON,
    "session_number": NUMBER, "score_sessions": SCORE, "ari": ARI, "assoc_edges": f"WITH {COMP}, {EDGE} SELECT * FROM ed", "track_groups": GROUPS, "peak_pairwise": PAIRS,
    "family_recurrence": f"{RECUR} SELECT sensor, capture, centre, hits, {show('fraction')} AS fraction FROM fr WHERE hits > 0", "family_class": FAMILY, "dice_concordance": DICE, "capture_delta": DELTA, "contrast_runs": RUNS, "envelope_events": EVENTS,
    "multiset_equal": BAGS, "parameter_matrix": MATRIX, "history_bundle": BUNDLE, "prior_cluster_counts": PRIOR, "track_spacings": SPACINGS, "sample_median": MEDIAN,
    "episode_magnitudes": MAGNITUDES, "slot_events": SLOTS,
}
