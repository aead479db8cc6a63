"""Queries of bursts, sessions and reports over the test tables, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyvane.functions import classify as k
from skyvane.functions.circular import angular_distance
from skyvane.functions.stats import robust_summary, shown
from skyvane.operators import report as r
from skyvane.operators import sessions as s
from skyvane.operators.bursts import aggregate_bursts
from skyvane.plans import sqltext as q
from skyvane.sources.observations import bursts, episode_events, track_events

B, T, E, show = q.B, q.T, q.E, q.shown
HOUR = 3600.0


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[shown(c).alias(c) if c in names else F.col(c) for c in df.columns])


def angles(spark: SparkSession, sf: str) -> DataFrame:
    """Distance of each bearing to its session's first two frequencies' centre, all by session."""
    b = bursts(spark, sf)
    return b.groupBy("session_id").agg(*[F.sum(angular_distance("bearing", F.lit(float(x)))).alias(f"to_{x}") for x in (0, 90, 271)])


def frames(spark: SparkSession, sf: str) -> DataFrame:
    return bursts(spark, sf).select("session_id", "time", "event_id", "bearing", (F.col("peak_power") + 4).alias("power"), F.col("max_confidence").alias("confidence"), "frequency_mhz", F.col("doa_width").alias("width"), F.col("median_doa_peaks").alias("peaks"))


def burst_agg(spark: SparkSession, sf: str) -> DataFrame:
    out = aggregate_bursts(frames(spark, sf), ["session_id"], 6 * HOUR).drop("start_time", "end_time")
    return rounded(out, "bearing_spread", "peak_power", "max_confidence", "median_confidence", "frequency_mhz", "single_peak_ratio", "bearing").withColumn("bearing", F.col("bearing") % 360)


BURST_AGG = f"""
WITH {B}, g AS (SELECT *, CASE WHEN {q.us('time')} - lag({q.us('time')}) OVER w >= 21600000000 OR lag(time) OVER w IS NULL THEN 1 ELSE 0 END AS n
  FROM bursts WHERE peak_power + 4 > -45 WINDOW w AS (PARTITION BY session_id ORDER BY time, event_id)),
i AS (SELECT *, sum(n) OVER (PARTITION BY session_id ORDER BY time, event_id) AS burst FROM g),
a AS (SELECT session_id, burst::BIGINT AS burst, count(*)::BIGINT AS samples, {q.cmean()} AS bearing, degrees(sqrt(-2 * ln(least(1, greatest({q.res()}, 1e-12))))) AS bearing_spread,
  max(peak_power + 4) AS peak_power, max(max_confidence) AS max_confidence, median(max_confidence) AS median_confidence, avg(frequency_mhz) AS frequency_mhz, median(doa_width) AS doa_width,
  median(median_doa_peaks) AS median_doa_peaks, avg((median_doa_peaks = 1)::INT) AS single_peak_ratio FROM i GROUP BY ALL)
SELECT session_id, burst, samples, {show('bearing')} % 360 AS bearing, {show('bearing_spread')} AS bearing_spread, {show('peak_power')} AS peak_power, {show('max_confidence')} AS max_confidence,
  {show('median_confidence')} AS median_confidence, {show('frequency_mhz')} AS frequency_mhz, doa_width, median_doa_peaks, {show('single_peak_ratio')} AS single_peak_ratio,
  CASE WHEN bearing_spread >= 12 OR coalesce(doa_width >= 80, false) OR single_peak_ratio < 0.75 THEN 'MULTIPATH'
    WHEN samples >= 3 AND bearing_spread <= 7 AND median_confidence >= 3.5 AND doa_width <= 70 AND single_peak_ratio >= 0.75 THEN 'STABLE' ELSE 'LOW_QUALITY' END AS quality FROM a"""


def burst_quality(spark: SparkSession, sf: str) -> DataFrame:
    b = bursts(spark, sf)
    return b.select("event_id", k.burst_quality("samples", "bearing_spread", "median_confidence", "doa_width", "single_peak_ratio").alias("quality"))


BURST_QUALITY = f"""
WITH {B} SELECT event_id, CASE WHEN bearing_spread >= 12 OR doa_width >= 80 OR single_peak_ratio < 0.75 THEN 'MULTIPATH'
  WHEN samples >= 3 AND bearing_spread <= 7 AND median_confidence >= 3.5 AND doa_width <= 70 AND single_peak_ratio >= 0.75 THEN 'STABLE' ELSE 'LOW_QUALITY' END AS quality FROM bursts"""

FEATURES = ["duration_s", "stable_ratio", "multipath_ratio", "low_quality_ratio", "bearing_circular_mean_deg", "bearing_circular_std_deg", "peak_power_mean_db", "peak_power_std_db", "max_confidence_mean", "median_confidence_mean", "doa_width_mean_deg", "doa_width_std_deg", "median_doa_peaks_mean", "bearing_spread_mean_deg", "single_peak_ratio_mean", "samples_mean"]


def session_features(spark: SparkSession, sf: str) -> DataFrame:
    out = s.session_features(bursts(spark, sf), track_events(spark, sf), episode_events(spark, sf), 2)
    return rounded(out, *FEATURES).withColumn("bearing_circular_mean_deg", F.col("bearing_circular_mean_deg") % 360).withColumn("start_time", F.unix_micros("start_time")).withColumn("end_time", F.unix_micros("end_time"))


def _std(c: str) -> str:
    return f"CASE WHEN count({c}) = 1 THEN 0 ELSE stddev_samp({c}) END"


TRACK_COUNTS = ", ".join(f"count(*) FILTER (event = '{n}') AS {n.lower()}" for n in s.TRACK_EVENTS)
SESSION_FEATURES = f"""
WITH {B}, {T}, {E},
p AS (SELECT session_id, {q.us('min(time)')} AS start_time, {q.us('max(time)')} AS end_time, {show('(epoch_us(max(time)) - epoch_us(min(time))) / 1e6')} AS duration_s, count(*)::BIGINT AS burst_count,
  {', '.join(f"(count(*) FILTER (quality = '{x}'))::BIGINT AS {x.lower()}_count, " + show(f"(count(*) FILTER (quality = '{x}'))::DOUBLE / count(*)") + f" AS {x.lower()}_ratio" for x in s.QUALITIES)},
  {show(q.cmean())} % 360 AS bearing_circular_mean_deg, {show(f'CASE WHEN {q.res()} <= 1e-12 THEN 180 ELSE degrees(sqrt(greatest(0, -2 * ln(least(1, greatest({q.res()}, 1e-12)))))) END')} AS bearing_circular_std_deg,
  {', '.join(show(f'avg({c})') + f' AS {n}' for c, n in (('peak_power', 'peak_power_mean_db'), ('max_confidence', 'max_confidence_mean'), ('median_confidence', 'median_confidence_mean'), ('doa_width', 'doa_width_mean_deg'), ('median_doa_peaks', 'median_doa_peaks_mean'), ('bearing_spread', 'bearing_spread_mean_deg'), ('single_peak_ratio', 'single_peak_ratio_mean'), ('samples', 'samples_mean')))},
  {show(_std('peak_power'))} AS peak_power_std_db, {show(_std('doa_width'))} AS doa_width_std_deg FROM bursts GROUP BY session_id HAVING count(*) >= 2),
t AS (SELECT session_id, count(*) AS all_n, {TRACK_COUNTS} FROM track WHERE event NOT IN ('TRACK_SHIFT_DETECTED', 'TRACK_VARIABLE') GROUP BY session_id),
e AS (SELECT session_id, count(*) AS all_n, count(*) FILTER (event = 'EPISODE_STARTED') AS st, count(*) FILTER (event = 'EPISODE_CLOSED') AS cl FROM episodes GROUP BY session_id)
SELECT p.*, coalesce(t.all_n, 0)::BIGINT AS track_event_count, {', '.join(f'coalesce(t.{n.lower()}, 0)::BIGINT AS {n.lower()}_count' for n in s.TRACK_EVENTS)},
  coalesce(e.all_n, 0)::BIGINT AS episode_event_count, coalesce(e.st, 0)::BIGINT AS episode_started_count, coalesce(e.cl, 0)::BIGINT AS episode_closed_count
FROM p LEFT JOIN t USING (session_id) LEFT JOIN e USING (session_id)"""


def listed(df: DataFrame, c: str) -> DataFrame:
    return df.withColumn(c, F.array_join(F.col(c).cast("array<string>"), ","))


def episode_report(spark: SparkSession, sf: str) -> DataFrame:
    return listed(s.episode_report(episode_events(spark, sf)), "active_episode_ids")


EPISODE_REPORT = f"""
WITH {E}, a AS (SELECT session_id, string_agg(episode_id::VARCHAR, ',' ORDER BY episode_id) AS ids FROM
  (SELECT DISTINCT session_id, episode_id FROM episodes WHERE event = 'EPISODE_STARTED' EXCEPT SELECT session_id, episode_id FROM episodes WHERE event = 'EPISODE_CLOSED') GROUP BY 1)
SELECT session_id, count(*)::BIGINT AS event_count, count(*) FILTER (event = 'EPISODE_STARTED') AS episodes_started, count(*) FILTER (event = 'EPISODE_CLOSED') AS episodes_closed, coalesce(any_value(ids), '') AS active_episode_ids,
  count(*) FILTER (reason = 'SHIFT_CONFIRMED') AS shift_boundaries, count(*) FILTER (reason = 'TRACK_LOST') AS track_losses, count(*) FILTER (degraded) AS degraded_closed_episodes
FROM episodes LEFT JOIN a USING (session_id) GROUP BY session_id"""


def session_summary(spark: SparkSession, sf: str) -> DataFrame:
    return listed(s.session_summary(bursts(spark, sf), track_events(spark, sf), episode_events(spark, sf)), "active_episode_ids")


SESSION_SUMMARY = f"""
WITH {B}, {T}, r AS ({EPISODE_REPORT}),
b AS (SELECT session_id, count(*) AS bursts, {', '.join(f"count(*) FILTER (quality = '{x}') AS {x.lower()}" for x in s.QUALITIES)} FROM bursts GROUP BY 1),
t AS (SELECT session_id, {TRACK_COUNTS} FROM track GROUP BY 1)
SELECT session_id, {', '.join(f'coalesce({c}, 0)::BIGINT AS {c}' for c in ['bursts', *[x.lower() for x in s.QUALITIES], *[n.lower() for n in s.TRACK_EVENTS], 'event_count', 'episodes_started', 'episodes_closed', 'shift_boundaries', 'track_losses', 'degraded_closed_episodes'])}, coalesce(active_episode_ids, '') AS active_episode_ids
FROM b FULL JOIN t USING (session_id) FULL JOIN r USING (session_id)"""


def unmatched_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return s.unmatched_sessions(episode_events(spark, sf), track_events(spark, sf).where("event = 'TRACK_ACQUIRED'"))


UNMATCHED = f"WITH {E}, {T} SELECT session_id, count(*)::BIGINT AS records FROM episodes WHERE session_id NOT IN (SELECT session_id FROM track WHERE event = 'TRACK_ACQUIRED') GROUP BY 1"


def persistence_class(spark: SparkSession, sf: str) -> DataFrame:
    b = bursts(spark, sf).where(k.qualified())
    return b.groupBy("session_id", r.hertz().alias("frequency_hz")).agg(F.count("*").alias("n")).withColumn("persistence", k.persistence("n"))


HZ = "round(frequency_mhz * 1e6)::BIGINT"
PERSIST = "CASE WHEN {0} = 1 THEN 'ISOLATED' WHEN {0} <= 4 THEN 'SPARSE' WHEN {0} <= 19 THEN 'REPEATED' ELSE 'PERSISTENT' END"
PERSISTENCE = f"WITH {B}, c AS (SELECT session_id, {HZ} AS frequency_hz, count(*)::BIGINT AS n FROM bursts WHERE max_confidence >= 3 AND samples >= 3 GROUP BY ALL) SELECT *, {PERSIST.format('n')} AS persistence FROM c"

OVER = ["mean_bearing", "concentration", "median_power", "median_confidence", "span_s", "doa_shift_deg", "median_gap_s", "max_gap_s"]


def historical_overview(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(r.frequency_overview(bursts(spark, sf)), *OVER)


DIRECTION = "CASE WHEN {0} < 5 THEN 'INSUFFICIENT DATA' WHEN {1} < 0.25 THEN 'DIFFUSE' WHEN {1} < 0.5 THEN 'WEAKLY CLUSTERED' WHEN {1} < 0.75 THEN 'CLUSTERED' ELSE 'TIGHTLY CLUSTERED' END"
TIGHT = "directional_class IN ('CLUSTERED', 'TIGHTLY CLUSTERED')"
CANDIDATE = f"""CASE WHEN persistence = 'PERSISTENT' AND {TIGHT} AND shift >= 30 THEN 'STRONG TEMPORAL CANDIDATE — EVOLVING DoA' WHEN persistence = 'PERSISTENT' AND {TIGHT} THEN 'STRONG CANDIDATE'
  WHEN persistence = 'PERSISTENT' AND directional_class IN ('DIFFUSE', 'WEAKLY CLUSTERED') THEN 'RECURRING / UNSTABLE DoA' WHEN persistence = 'REPEATED' AND {TIGHT} THEN 'DEVELOPING CANDIDATE' ELSE 'INSUFFICIENT EVIDENCE' END"""
BUCKET = f"({q.us('time')} // 600000000) * 600"


def overview_sql(keys: str, source: str) -> str:
    """Overview by key columns of a relation that has the burst columns and those keys."""
    return f"""
o AS (SELECT {keys}, count(*)::BIGINT AS observations, count(DISTINCT session_id)::BIGINT AS tagged_sessions, {q.cmean()} AS mean_bearing, {q.res()} AS concentration, median(peak_power) AS median_power,
  median(max_confidence) AS median_confidence, median(doa_width) AS median_width, ({q.us('max(time)')} - {q.us('min(time)')}) / 1e6 AS span_s FROM {source} GROUP BY ALL),
w AS (SELECT {keys}, {BUCKET} AS bucket, {q.cmean()} AS m FROM {source} GROUP BY ALL HAVING count(*) >= 5),
d AS (SELECT {keys}, CASE WHEN count(*) >= 2 THEN {q.dist('arg_max(m, bucket)', 'arg_min(m, bucket)')} ELSE 0 END AS shift FROM w GROUP BY ALL),
g AS (SELECT {keys}, ({q.us('time')} - lag({q.us('time')}) OVER (PARTITION BY {keys} ORDER BY time, event_id)) / 1e6 AS gap FROM {source}),
h AS (SELECT {keys}, median(gap) AS median_gap_s, max(gap) AS max_gap_s FROM g GROUP BY ALL),
c AS (SELECT *, {PERSIST.format('observations')} AS persistence, {DIRECTION.format('observations', 'concentration')} AS directional_class FROM o JOIN h USING ({keys}) LEFT JOIN d USING ({keys}))"""


OVER_OUT = f"""observations, tagged_sessions, {show('mean_bearing')} AS mean_bearing, {show('concentration')} AS concentration, {show('median_power')} AS median_power, {show('median_confidence')} AS median_confidence, median_width,
  {show('span_s')} AS span_s, persistence, directional_class, {show('coalesce(shift, 0)')} AS doa_shift_deg, {show('median_gap_s')} AS median_gap_s, {show('max_gap_s')} AS max_gap_s, {CANDIDATE.replace('shift >=', 'coalesce(shift, 0) >=')} AS candidate_quality"""
OVERVIEW = f"WITH {B}, f AS (SELECT *, {HZ} AS frequency_hz FROM bursts), {overview_sql('frequency_hz', 'f')} SELECT frequency_hz, {OVER_OUT} FROM c"


def candidate_quality(spark: SparkSession, sf: str) -> DataFrame:
    b = bursts(spark, sf).withColumn("day", F.floor(F.unix_micros("time") / 86_400_000_000))
    per = b.groupBy("session_id", "day").agg(F.count("*").alias("n"), r.resultant("bearing").alias("c"))
    per = per.join(r.doa_shift(b, ["session_id"]), "session_id")
    per = per.withColumn("p", k.persistence(F.col("n") * 7)).withColumn("d", k.directional_class(F.col("n") * 2, "c"))
    return per.select("session_id", "day", "p", "d", k.candidate_quality("p", "d", F.col("n") * 9.0).alias("candidate_quality"))


CANDIDATES = f"""
WITH {B}, per AS (SELECT session_id, epoch_us(time) // 86400000000 AS day, count(*) AS n, {q.res()} AS r FROM bursts GROUP BY ALL),
c AS (SELECT session_id, day, n * 9.0 AS shift, {PERSIST.format('n * 7')} AS persistence, {DIRECTION.format('n * 2', 'r')} AS directional_class FROM per)
SELECT session_id, day, persistence AS p, directional_class AS d, {CANDIDATE} AS candidate_quality FROM c"""


def frequency_groups(spark: SparkSession, sf: str) -> DataFrame:
    b = bursts(spark, sf)
    out = r.frequency_groups(b.where("session_id = 'S3'"), b)
    return rounded(out, *OVER)


GROUPS = f"""
WITH {B}, f AS (SELECT *, {HZ} AS frequency_hz FROM bursts), {overview_sql('frequency_hz', 'f')},
n AS (SELECT frequency_hz, count(*)::BIGINT AS current, count(doa_width)::BIGINT AS width_measured, median(doa_width) AS current_width, median(median_doa_peaks) AS current_peaks FROM f WHERE session_id = 'S3' GROUP BY 1)
SELECT frequency_hz, current, width_measured, current_width, current_peaks, {PERSIST.format('current')} AS current_persistence, {OVER_OUT} FROM n JOIN c USING (frequency_hz)"""


def gap_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(r.gap_stats(bursts(spark, sf), ["session_id"]), "median_gap_s", "max_gap_s")


GAPS = f"""WITH {B}, g AS (SELECT session_id, ({q.us('time')} - lag({q.us('time')}) OVER (PARTITION BY session_id ORDER BY time, event_id)) / 1e6 AS gap FROM bursts)
SELECT session_id, {show('median(gap)')} AS median_gap_s, {show('max(gap)')} AS max_gap_s FROM g GROUP BY 1"""


def doa_shift(spark: SparkSession, sf: str) -> DataFrame:
    b = bursts(spark, sf).withColumn("time", F.timestamp_micros(F.floor(F.unix_micros("time") / 500)))  # two thousand times denser
    return rounded(r.doa_shift(b.withColumn("block", F.col("event_id") % 4), ["block"]), "doa_shift_deg")


SHIFT = f"""
WITH {B}, f AS (SELECT event_id % 4 AS block, bearing, ({q.us('time')} // 500) // 600000000 AS bucket FROM bursts),
w AS (SELECT block, bucket, {q.cmean()} AS m FROM f GROUP BY ALL HAVING count(*) >= 5)
SELECT block, {show(f"CASE WHEN count(w.bucket) >= 2 THEN {q.dist('arg_max(m, w.bucket)', 'arg_min(m, w.bucket)')} ELSE 0 END")} AS doa_shift_deg FROM (SELECT DISTINCT block FROM f) x LEFT JOIN w USING (block) GROUP BY 1"""


def bearing_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return r.bearing_histogram(bursts(spark, sf), ["session_id"])


HIST = """h AS (SELECT s.session_id, b.bin::INT AS bin, count(x.bearing)::BIGINT AS n FROM (SELECT DISTINCT session_id FROM bursts) s CROSS JOIN range(36) b(bin)
  LEFT JOIN bursts x ON x.session_id = s.session_id AND floor(x.bearing / 10) = b.bin GROUP BY ALL)"""
HISTOGRAM = f"WITH {B}, {HIST} SELECT * FROM h"
PEAKS = """pk AS (SELECT c.session_id, c.bin * 10 AS centre, c.n AS peak_count, (row_number() OVER (PARTITION BY c.session_id ORDER BY c.n DESC, c.bin DESC))::INT AS peak_rank FROM h c
  JOIN h l ON l.session_id = c.session_id AND l.bin = (c.bin + 35) % 36 JOIN h r ON r.session_id = c.session_id AND r.bin = (c.bin + 1) % 36 WHERE c.n >= 3 AND c.n > l.n AND c.n >= r.n)"""


def histogram_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return r.histogram_peaks(bursts(spark, sf), ["session_id"])


STATES = f"""st AS (SELECT session_id, centre, peak_count, peak_rank, count(*)::BIGINT AS hits, {q.smean()} AS bearing, avg(max_confidence) AS mean_confidence, max(peak_power) AS strongest, median(doa_width) AS width,
  median(median_doa_peaks) AS peaks, count(DISTINCT {BUCKET})::BIGINT AS windows, ({q.us('max(time)')} - {q.us('min(time)')}) / 1e6 AS span_s
  FROM pk JOIN bursts USING (session_id) WHERE {q.dist('bearing', 'centre')} <= 10 GROUP BY ALL)"""


def directional_states(spark: SparkSession, sf: str) -> DataFrame:
    out = rounded(r.directional_states(bursts(spark, sf), ["session_id"]), "bearing", "mean_confidence", "strongest", "span_s")
    return out.withColumn("bearing", F.col("bearing") % 360)


DIRECTIONAL = f"""
WITH {B}, {HIST}, {PEAKS}, {STATES} SELECT session_id, centre, peak_count, peak_rank, hits, {show('bearing')} % 360 AS bearing, {show('mean_confidence')} AS mean_confidence, {show('strongest')} AS strongest, width, peaks, windows,
  {show('span_s')} AS span_s, CASE WHEN windows >= 4 THEN 'PERSISTENT' WHEN windows >= 2 THEN 'REPEATED' ELSE 'TRANSIENT' END AS status, CASE WHEN peaks <= 1 THEN 'COHERENT' ELSE 'AMBIGUOUS' END AS coherence FROM st"""


def ambiguity_windows(spark: SparkSession, sf: str) -> DataFrame:
    out = r.ambiguity_windows(bursts(spark, sf), ["session_id"], 12 * HOUR)
    return rounded(out, "min_confidence").select("session_id", "window", *[F.unix_micros(c).alias(c) for c in ("start", "end", "next_start")], "rows", "max_peaks", "max_width", "min_confidence")


AMB = f"""am AS (SELECT session_id, win, min(time) AS s, max(time) AS e, count(*)::BIGINT AS n, max(median_doa_peaks) AS max_peaks, max(doa_width) AS max_width, min(max_confidence) AS min_confidence FROM (
  SELECT *, sum(nw) OVER (PARTITION BY session_id ORDER BY time, event_id) AS win FROM (SELECT *, CASE WHEN {q.us('time')} - lag({q.us('time')}) OVER w <= 43200000000 THEN 0 ELSE 1 END AS nw FROM bursts WHERE median_doa_peaks > 1 WINDOW w AS (PARTITION BY session_id ORDER BY time, event_id))) GROUP BY ALL),
aw AS (SELECT *, lead(s) OVER (PARTITION BY session_id ORDER BY win) AS nx FROM am)"""
AMBIGUITY = f"WITH {B}, {AMB} SELECT session_id, win::BIGINT AS window, {q.us('s')} AS start, {q.us('e')} AS \"end\", {q.us('nx')} AS next_start, n AS rows, max_peaks, max_width, {show('min_confidence')} AS min_confidence FROM aw"


def ambiguity_recovery(spark: SparkSession, sf: str) -> DataFrame:
    out = r.ambiguity_recovery(bursts(spark, sf), ["session_id"], 12 * HOUR)
    return rounded(out, "delay_s", "transition_s", "recovery_bearing").select("session_id", "window", "recovery_rows", "delay_s", "transition_s", (F.col("recovery_bearing") % 360).alias("recovery_bearing"))


REC = f"""rc AS (SELECT a.session_id, a.win, count(b.time)::BIGINT AS recovery_rows, min(b.time) AS first, any_value(a.s) AS s, any_value(a.e) AS e, CASE WHEN count(b.time) > 0 THEN {q.smean('b.bearing')} END AS recovery_bearing FROM aw a
  LEFT JOIN bursts b ON b.session_id = a.session_id AND b.time > a.e AND (a.nx IS NULL OR b.time < a.nx) AND b.max_confidence >= 3 AND b.samples >= 3 AND b.median_doa_peaks <= 1 GROUP BY ALL)"""
RECOVERY = f"WITH {B}, {AMB}, {REC} SELECT session_id, win::BIGINT AS window, recovery_rows, {show('(epoch_us(first) - epoch_us(e)) / 1e6')} AS delay_s, {show('(epoch_us(first) - epoch_us(s)) / 1e6')} AS transition_s, {show('recovery_bearing')} % 360 AS recovery_bearing FROM rc"


def stability(spark: SparkSession, sf: str) -> DataFrame:
    return r.stability(bursts(spark, sf), ["session_id"], 12 * HOUR).select("session_id", "windows", "recoveries", "hits", "stability_class")


STABILITY = f"""
WITH {B}, {HIST}, {PEAKS}, {STATES}, {AMB}, {REC}, dm AS (SELECT session_id, arg_min(bearing, (-hits, peak_rank)) AS db, max(hits) AS hits FROM st GROUP BY 1),
la AS (SELECT session_id, count(*)::BIGINT AS windows, count(first)::BIGINT AS recoveries, arg_max(recovery_bearing, win) FILTER (first IS NOT NULL) AS lb FROM rc GROUP BY 1)
SELECT session_id, coalesce(windows, 0) AS windows, coalesce(recoveries, 0) AS recoveries, hits, CASE WHEN recoveries > 0 AND db IS NOT NULL AND {q.dist('lb', 'db')} <= 10 THEN 'MIXED / RECOVERING' WHEN recoveries > 0 AND db IS NOT NULL THEN 'MIXED / SHIFTED'
  WHEN windows > 0 THEN 'MIXED / UNRESOLVED' WHEN db IS NOT NULL THEN 'STABLE / NO AMBIGUITY' ELSE 'INSUFFICIENT DATA' END AS stability_class FROM (SELECT DISTINCT session_id FROM bursts) LEFT JOIN la USING (session_id) LEFT JOIN dm USING (session_id)"""


def max_centroid_shift(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(r.recurrence(bursts(spark, sf)), "max_centroid_shift")


CENTROIDS = f"""
WITH {B}, p AS (SELECT {HZ} AS frequency_hz, session_id, count(*) AS n, {q.cmean()} AS c FROM bursts GROUP BY ALL),
x AS (SELECT a.frequency_hz, max({q.dist('a.c', 'b.c')}) AS m FROM p a JOIN p b ON a.frequency_hz = b.frequency_hz AND a.session_id < b.session_id AND a.n >= 5 AND b.n >= 5 GROUP BY 1),
t AS (SELECT frequency_hz, count(*)::BIGINT AS tagged_sessions, count(*) FILTER (n >= 5) AS qualifying_sessions FROM p GROUP BY 1)
SELECT frequency_hz, tagged_sessions, qualifying_sessions, CASE WHEN tagged_sessions >= 2 THEN 'YES' ELSE 'NOT YET' END AS rf_recurrence,
  CASE WHEN qualifying_sessions >= 2 THEN 'READY FOR VALIDATION' WHEN tagged_sessions >= 2 THEN 'PRELIMINARY' ELSE 'INSUFFICIENT DATA' END AS doa_recurrence, {show('m')} AS max_centroid_shift FROM t LEFT JOIN x USING (frequency_hz)"""


def session_shift(spark: SparkSession, sf: str) -> DataFrame:
    out = rounded(r.session_shifts(bursts(spark, sf)), "bearing", "shift_deg")
    return out.withColumn("bearing", F.col("bearing") % 360)


SESSION_SHIFT = f"""
WITH {B}, bf AS (SELECT * REPLACE ({HZ} || '/' || session_id AS session_id) FROM bursts), {HIST.replace('bursts', 'bf')}, {PEAKS}, {STATES.replace('JOIN bursts', 'JOIN bf')},
dm AS (SELECT split_part(session_id, '/', 1)::BIGINT AS frequency_hz, split_part(session_id, '/', 2) AS session_id, arg_min(bearing, (-hits, peak_rank)) AS bearing, max(hits) AS hits FROM st GROUP BY ALL),
l AS (SELECT *, lag(session_id) OVER w AS previous_session, lag(bearing) OVER w AS pb, first(bearing) OVER w AS fb, row_number() OVER w AS rn, count(*) OVER (PARTITION BY frequency_hz) AS sessions FROM dm WINDOW w AS (PARTITION BY frequency_hz ORDER BY session_id))
SELECT frequency_hz, session_id, {show('bearing')} % 360 AS bearing, hits, previous_session, {show(q.dist('bearing', 'pb'))} AS shift_deg, sessions, CASE WHEN rn = sessions AND sessions >= 3 THEN CASE WHEN {q.dist('bearing', 'fb')} <= 10 THEN 'YES' ELSE 'NO' END END AS return_match FROM l WHERE sessions >= 2"""


ANGLES = f"WITH {B} SELECT session_id, {', '.join('sum(' + q.dist('bearing', str(x)) + f') AS to_{x}' for x in (0, 90, 271))} FROM bursts GROUP BY 1"


def summary_query(spark: SparkSession, sf: str) -> DataFrame:
    out = robust_summary(bursts(spark, sf), ["session_id"], "peak_power")
    return rounded(out, *[c for c in out.columns if c not in ("session_id", "count")])


ROBUST = f"""WITH {B} SELECT session_id, count(*)::BIGINT AS count, {', '.join(show(x) + f' AS {n}' for n, x in (('median', 'median(peak_power)'), ('min', 'min(peak_power)'), ('max', 'max(peak_power)'), ('range', 'max(peak_power) - min(peak_power)'), ('mad', 'mad(peak_power)'), ('q25', 'quantile_cont(peak_power, 0.25)'), ('q75', 'quantile_cont(peak_power, 0.75)'), ('iqr', 'quantile_cont(peak_power, 0.75) - quantile_cont(peak_power, 0.25)'), ('mean', 'avg(peak_power)'), ('std', 'stddev_pop(peak_power)')))} FROM bursts GROUP BY 1"""


def doa_arrays(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: F.abs(F.floor(x.cast("double") * 1000)).cast("double")).alias("doa"))


def doa_width(spark: SparkSession, sf: str) -> DataFrame:
    return doa_arrays(spark, sf).select("vec_id", k.beam_width("doa").alias("width"))


def doa_peaks(spark: SparkSession, sf: str) -> DataFrame:
    return doa_arrays(spark, sf).select("vec_id", k.beam_peaks("doa").alias("peaks"))


DOA = "d AS (SELECT vec_id, [abs(floor(x::DOUBLE * 1000)) FOR x IN embedding] AS doa FROM embeddings)"
WIDTH = f"WITH {DOA} SELECT vec_id, len([x FOR x IN doa IF x >= list_max(doa) * 0.5])::INT AS width FROM d"
DPEAKS = f"WITH {DOA} SELECT vec_id, len([i FOR i IN range(0, len(doa)) IF doa[i + 1] >= list_max(doa) * 0.5 AND doa[i + 1] > doa[(i + len(doa) - 1) % len(doa) + 1] AND doa[i + 1] >= doa[(i + 1) % len(doa) + 1]])::INT AS peaks FROM d"

QUERIES = {
    "session_features": session_features, "burst_agg": burst_agg, "burst_quality": burst_quality, "angular_distance": angles, "episode_report": episode_report,
    "session_summary": session_summary, "unmatched_sessions": unmatched_sessions, "persistence_class": persistence_class, "candidate_quality": candidate_quality,
    "historical_overview": historical_overview, "frequency_groups": frequency_groups, "gap_stats": gap_stats, "doa_shift": doa_shift, "bearing_histogram": bearing_histogram,
    "histogram_peaks": histogram_peaks, "directional_states": directional_states, "ambiguity_windows": ambiguity_windows, "ambiguity_recovery": ambiguity_recovery, "stability_class": stability,
    "max_centroid_shift": max_centroid_shift, "session_shift": session_shift, "robust_summary": summary_query, "doa_width": doa_width, "doa_peaks": doa_peaks,
}
SQL = {
    "session_features": SESSION_FEATURES, "burst_agg": BURST_AGG, "burst_quality": BURST_QUALITY, "angular_distance": ANGLES, "episode_report": EPISODE_REPORT,
    "session_summary": SESSION_SUMMARY, "unmatched_sessions": UNMATCHED, "persistence_class": PERSISTENCE, "candidate_quality": CANDIDATES,
    "historical_overview": OVERVIEW, "frequency_groups": GROUPS, "gap_stats": GAPS, "doa_shift": SHIFT, "bearing_histogram": HISTOGRAM,
    "histogram_peaks": f"WITH {B}, {HIST}, {PEAKS} SELECT * FROM pk", "directional_states": DIRECTIONAL, "ambiguity_windows": AMBIGUITY, "ambiguity_recovery": RECOVERY, "stability_class": STABILITY,
    "max_centroid_shift": CENTROIDS, "session_shift": SESSION_SHIFT, "robust_summary": ROBUST, "doa_width": WIDTH, "doa_peaks": DPEAKS,
}
