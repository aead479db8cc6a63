"""Text guards, topic by topic, by form of denial and by kind of text."""

import duckdb
import pytest
from pyspark.sql import functions as F

from skyvane.operators import guards as g
from skyvane.plans.stateful_queries import GUARD_CASES

IDENTITY, CAUSE, DIRECTION, CLASSES, STEADY, CLUSTER = dict.fromkeys(t.name for t in g.CLAIMS)


def found(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t"))).collect()]


MORE = [
    ("Nobody could mistake it: one and the same emitter again.", [IDENTITY]), ("It's the same device.", [IDENTITY]), ("The sources were classified yesterday.", [CLASSES]), ("We didn't recognise a transmitter.", []),
    ("Not only is the emitter stable, it has a fingerprint that is unique.", [IDENTITY, STEADY]), ("The power fell, but rain caused it.", [CAUSE]), ("The azimuth isn’t exact.", []), ("C12 is a car", [CLUSTER]), ("class, separable", []),
    ("Nothing identifies devices here: nor are classes separable.", [IDENTITY]), ("DEVICE\nIDENTITY", []), ("the 3.5 dB source is steady", [STEADY]), ("identity", []), ("", []), (None, []), ("... ,,; but", []), ("x" * 100_000 + " device " + "y" * 100_000 + " same", [IDENTITY]),
]


def test_claims_and_denials_in_both_languages(spark):
    cases = [*GUARD_CASES, *MORE]
    assert found(spark, [t for t, _ in cases], g.topics) == [c for _, c in cases]
    c = duckdb.connect()
    for t, names in cases:
        assert c.execute(f"SELECT {g.topics_sql('t')} FROM (SELECT ?::VARCHAR AS t)", [t]).fetchone()[0] == "; ".join(names), t


@pytest.mark.parametrize("known, lacks", [("session", ["historical comparison unavailable"]), ("no same cluster", []), ("history", [])])
def test_suggestions(spark, known, lacks):
    cases = [
        ("Count bursts for an hour.", []), ("Wait.", ["no measurable action"]), (" ", ["empty"]), (None, ["empty"]), ("record " + "z" * 1493, []), ("record " + "z" * 1494, ["too long"]),
        ("Measure how reflective the wall is and its reflectivity.", ["invented reflectivity variable"]), ("Observe propagation for a day.", ["invented propagation cause"]), ("Repeat it until the emitter is steady.", [STEADY]),
        ("Compare with the archived captures.", lacks), ("Record without a previous session.", []),
    ]
    assert found(spark, [t for t, _ in cases], lambda t: g.suggestion_problems(t, known)) == [p for _, p in cases]


def test_same_cluster(spark):
    text = ["Compare it to the earlier mean of cluster C1."]
    assert found(spark, text, lambda t: g.suggestion_problems(t, "no same cluster")) == [["no prior same-cluster mean available"]]
    assert found(spark, text, g.suggestion_problems) == [[]]


def report(uncertain, then="Count bursts again next week."):
    parts = dict(zip(g.HEADINGS, ("Twelve bursts were met.", "Ten of twelve had one peak.", "Their width is typical.", uncertain, then, "Nothing is said of emitters."), strict=True))
    return "\n".join(f"**{h}**\n{t}\n" for h, t in parts.items())


def test_reports(spark):
    cases = [
        (report("The width varies."), []), (report("One source is reliable."), [STEADY]), (report("It may be an environmental matter."), ["unsupported environmental explanation"]), (report("Perhaps it was a transient."), ["unsupported transient explanation"]),
        (report("There could be unknown bursts."), ["unsupported unobserved hypothesis"]), (report("No transmitter was recognised."), []), (report("None.", "An unknown source might be stable."), []),
        (report("None.").replace("**", "").upper(), []), (report("None.").replace("**Evidence**", "Evidence so far"), ["missing heading: Evidence"]), ("", ["empty"]), (None, ["empty"]), ("Summary", [f"missing heading: {h}" for h in g.HEADINGS[1:]]),
    ]
    assert found(spark, [t for t, _ in cases], g.report_problems) == [p for _, p in cases]


def test_clauses_and_lower_case_are_made_once_a_text(spark):
    plan = spark.range(1).selectExpr("cast(id as string) as text").select(g.topics("text").alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("lower(") == 1


def test_earlier_sentences_and_claims_in_so_many_words(spark):
    from skyvane.plans.stateful_queries import ALL_CASES, EARLIER_CASES

    assert len(EARLIER_CASES) == 30 and ("It does not explain this but it is the device.", [IDENTITY]) in EARLIER_CASES
    cases = [*ALL_CASES, ("It is an emitter.", [IDENTITY]), ("This is not the device.", []), ("The signal matches device 7, and the source is steady.", [IDENTITY, STEADY]), ("Discriminative widths were kept.", [CLASSES]), ("The runs confirm their separation.", [CLASSES]),
             ("One CANNOT rule out device identity.", [IDENTITY]), ("Rain doesn’t rule out multipath as its cause.", [CAUSE]), ("We rule out device identity, not power.", [IDENTITY]), ("It is not the device", []), ("", []), (None, [])]
    assert found(spark, [t for t, _ in cases], lambda t: g.topics(g.left_open(t), g.ALL_CLAIMS)) == [c for _, c in cases]
    c = duckdb.connect()
    for t, names in cases:
        assert c.execute(f"SELECT {g.topics_sql(g.left_open_sql('t'), g.ALL_CLAIMS)} FROM (SELECT ?::VARCHAR AS t)", [t]).fetchone()[0] == "; ".join(names), t
