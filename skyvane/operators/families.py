"""Spectral families over events and captures, and interval helpers on ordered samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyvane.functions.stats import exact_median


def peak_pairs(peaks: DataFrame, keys: list[str]) -> DataFrame:
    """All pairs of an event's ranked peaks (eight at most) with signed and absolute differences, made inside the event's row."""
    p = peaks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "frequency_hz"))).alias("p"))
    pairs = F.flatten(F.transform("p", lambda a: F.transform(F.filter("p", lambda b: b["rank"] > a["rank"]), lambda b: F.struct(a["rank"].alias("rank_a"), b["rank"].alias("rank_b"), (b["frequency_hz"] - a["frequency_hz"]).alias("difference_hz")))))
    return p.select(*keys, F.explode(pairs).alias("d")).select(*keys, "d.*", F.abs("d.difference_hz").alias("spacing_hz"))


def recurrence(spacings: DataFrame, tolerance: float = 50.0) -> DataFrame:
    """Fraction of each capture's events with a spacing within the tolerance of each centre, and the captures of its sensor.

    Centres are all observed spacings; a capture without such an event has no row for a centre, which stands for 0.
    An event with several spacings near a centre counts once: its spacings in order, each is counted for the centres that
    the one before does not reach. So spacings of one distance to the one before are counted first, and only these counts
    meet centres, by an equality join on blocks of the tolerance's width (own and neighbouring).
    """
    block = lambda c: F.floor(F.col(c) / tolerance)
    centres = spacings.select(F.col("spacing_hz").alias("centre")).distinct()
    near = centres.withColumn("b", F.explode(F.array(*[block("centre") + i for i in (-1, 0, 1)])))
    before = F.lag("spacing_hz").over(Window.partitionBy("sensor", "capture", "event").orderBy("spacing_hz"))
    known = spacings.where("event is not null").select("sensor", "capture", "event", "spacing_hz").distinct().withColumn("before", before)
    # One that lies too far below to reach any centre of this one is as good as none.
    far = F.col("spacing_hz") - F.col("before") > 3 * tolerance
    per = known.withColumn("before", F.when(~far, F.col("before"))).groupBy("sensor", "capture", "spacing_hz", "before").agg(F.count("*").alias("n")).withColumn("b", block("spacing_hz"))
    new = F.col("before").isNull() | (F.abs(F.col("before") - F.col("centre")) > tolerance)
    hits = per.join(near, "b").where((F.abs(F.col("spacing_hz") - F.col("centre")) <= tolerance) & new).groupBy("sensor", "capture", "centre").agg(F.sum("n").alias("hits"))
    events = spacings.groupBy("sensor", "capture").agg(F.count_distinct("event").alias("n"))
    events = events.join(events.groupBy("sensor").agg(F.count("*").alias("captures")), "sensor")
    return hits.join(events, ["sensor", "capture"]).select("sensor", "capture", "centre", "hits", (F.col("hits") / F.col("n")).alias("fraction"), "captures")


def classify(rec: DataFrame, high: float = 0.6, low: float = 0.4) -> DataFrame:
    """Families by sensor: SHARED if all captures of both reach ``high``, one sensor's if all of the other stay under ``low``,
    else UNSTABLE. A capture without a row for a centre has the fraction 0 there."""
    side = lambda s, c="fraction": F.when(F.col("sensor") == s, F.col(c))
    least = lambda s: F.when(F.count(side(s)) == F.max(side(s, "captures")), F.min(side(s))).otherwise(0.0)
    top = lambda s: F.coalesce(F.max(side(s)), F.lit(0.0))
    x = rec.groupBy("centre").agg(least("S1").alias("low1"), top("S1").alias("top1"), least("S2").alias("low2"), top("S2").alias("top2"))
    one, two = F.col("low1") >= high, F.col("low2") >= high
    return x.select("centre", F.when(one & two, "SHARED").when(one & (F.col("top2") < low), "S1_ONLY").when(two & (F.col("top1") < low), "S2_ONLY").otherwise("UNSTABLE").alias("family"))


def dice(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float = 25.0) -> DataFrame:
    """Concordance of two member sets with one member per ordinal: twice the matched over all."""
    l, r = left.select(*keys, "ordinal", F.col("frequency_hz").alias("f")), right.select(*keys, "ordinal", F.col("frequency_hz").alias("g"))
    m = l.join(r, [*keys, "ordinal"], "full")
    out = m.groupBy(*keys).agg(F.count("f").alias("left_members"), F.count("g").alias("right_members"), F.count_if(F.abs(F.col("f") - F.col("g")) <= tolerance).alias("matched"))
    return out.withColumn("dice", 2.0 * F.col("matched") / (F.col("left_members") + F.col("right_members")))


def capture_delta(values: DataFrame) -> DataFrame:
    """Median and range of each capture's episode medians, and the difference to the nearest earlier capture (number).

    The captures before a number are one block per set bit of it. In each block, ordered by median, the neighbours
    below and above are looked up, so a capture meets a few rows per bit and never all earlier ones. Of equal
    distances the smaller number counts.
    """
    c = values.groupBy("capture", "episode").agg(exact_median("value").alias("m")).groupBy("capture").agg(exact_median("m").alias("median"), (F.max("m") - F.min("m")).alias("range"))
    bits = int(c.agg(F.max("capture")).first()[0] or 0).bit_length()
    level = F.explode(F.sequence(F.lit(0), F.lit(max(0, bits - 1)))).alias("level")
    block = F.expr("shiftright(capture, level)")
    points = c.select("capture", "median", level).select("level", block.alias("block"), "median", "capture", F.lit(0).alias("asks"))
    asks = c.select("capture", "median", level).where(block % 2 == 1).select("level", (block - 1).alias("block"), "median", "capture", F.lit(1).alias("asks"))
    # Points of one median count as the one with the smallest number: it comes last below and first above.
    w = Window.partitionBy("level", "block")
    up, down = w.orderBy("median", "asks", F.col("capture").desc()), w.orderBy(F.col("median").desc(), "asks", F.col("capture").desc())
    point = F.when(F.col("asks") == 0, F.struct("median", "capture"))
    line = points.unionAll(asks).withColumn("below", F.last(point, True).over(up.rowsBetween(Window.unboundedPreceding, 0))).withColumn("above", F.last(point, True).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    near = line.where("asks = 1").select("capture", F.explode(F.array("below", "above")).alias("p"), "median").where("p is not null")
    best = near.groupBy("capture").agg(F.min(F.struct(F.abs(F.col("median") - F.col("p.median")).alias("d"), F.col("p.capture").alias("earlier"), F.col("p.median").alias("em"))).alias("n"))
    return c.join(best, "capture", "left").select("capture", "median", "range", F.col("n.earlier").alias("nearest_capture"), (F.col("median") - F.col("n.em")).alias("signed"), F.col("n.d").alias("absolute"))


def runs_above(df: DataFrame, keys: list[str], position: str, value: str, floor: float) -> DataFrame:
    """Runs of consecutive positions at or above a floor."""
    w = Window.partitionBy(*keys).orderBy(position)
    g = df.where(F.col(value) >= floor).withColumn("__k", F.col(position) - F.row_number().over(w))
    return g.groupBy(*keys, "__k").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("length"), F.max(value).alias("top")).drop("__k")


def join_active(df: DataFrame, keys: list[str], position: str, reach: int, least: int) -> DataFrame:
    """Active positions joined over distances up to ``reach`` into events of at least ``least`` positions from first to last."""
    w = Window.partitionBy(*keys).orderBy(position)
    new = F.when(F.col(position) - F.lag(position).over(w) <= reach, 0).otherwise(1)
    g = df.withColumn("__n", new).withColumn("__k", F.sum("__n").over(w))
    out = g.groupBy(*keys, "__k").agg(F.min(position).alias("start"), F.max(position).alias("end"), F.count("*").alias("active"))
    return out.where(F.col("end") - F.col("start") + 1 >= least).drop("__k")


def contiguous_edge(df: DataFrame, keys: list[str], step: Column | str, passes: Column | str) -> DataFrame:
    """The largest step from the centre on, such that it and all smaller ones pass; null if the first fails."""
    s, p = (F.col(x) if isinstance(x, str) else x for x in (step, passes))
    fail = df.groupBy(*keys).agg(F.min(F.when(~p, s)).alias("__f"))
    return df.join(fail, keys).groupBy(*keys).agg(F.max(F.when(F.col("__f").isNull() | (s < F.col("__f")), s)).alias("edge"))


def distinct_centres(centres: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Of each key's centres those that stand for their surroundings: keys, place (from 1, ascending), centre, support.

    centres: keys, centre, support. From the lowest centre on, the best supported one within the tolerance above it is
    taken (of equal ones the lower), and all within the tolerance of that one go; then on from the lowest left. No choice
    reaches over a gap wider than the tolerance, so a key is cut at its gaps first, and only the stretch between two gaps
    is folded, inside one row. Null centres go, null supports count as 0, of equal centres the best supported one counts.
    """
    c = centres.where(F.col("centre").isNotNull()).select(*keys, F.col("centre").cast("double").alias("centre"), F.coalesce(F.col("support").cast("double"), F.lit(0.0)).alias("support"))
    c = c.groupBy(*keys, "centre").agg(F.max("support").alias("support"))
    w = Window.partitionBy(*keys).orderBy("centre")
    c = c.withColumn("__far", F.when(F.col("centre") - F.lag("centre").over(w) > tolerance, 1).otherwise(0)).withColumn("__stretch", F.sum("__far").over(w))
    kind = "struct<seed:double,centre:double,support:double,free:double,kept:array<struct<centre:double,support:double>>>"
    none, far = F.lit(None).cast("double"), F.lit(float("-inf"))
    state = lambda *x: F.struct(*[v.alias(n) for v, n in zip(x, ("seed", "centre", "support", "free", "kept"), strict=True)]).cast(kind)
    taken = lambda a: F.concat(a["kept"], F.array(F.struct(a["centre"].alias("centre"), a["support"].alias("support"))))

    def place(a: Column, x: Column) -> Column:
        begun = lambda free, kept: F.when(x["centre"] > free, state(x["centre"], x["centre"], x["support"], free, kept)).otherwise(state(none, none, none, free, kept))
        better = F.when(x["support"] > a["support"], state(a["seed"], x["centre"], x["support"], a["free"], a["kept"])).otherwise(a)
        return F.when(a["seed"].isNull(), begun(a["free"], a["kept"])).when(x["centre"] <= a["seed"] + tolerance, better).otherwise(begun(a["centre"] + tolerance, taken(a)))

    start = state(none, none, none, far, F.array())
    fold = F.aggregate(F.array_sort(F.collect_list(F.struct("centre", "support"))), start, place, lambda a: F.when(a["seed"].isNull(), a["kept"]).otherwise(taken(a)))
    kept = c.groupBy(*keys, "__stretch").agg(fold.alias("__kept")).select(*keys, F.inline("__kept"))
    return kept.select(*keys, F.row_number().over(w).alias("place"), "centre", "support")
