"""Text guards: which statements of a report or a suggested experiment the data cannot support.

A topic is a pair of word classes: what a clause speaks of, and what it says of that. A clause is on a topic if it has a
word of both, in any order, and is no denial. Word classes are stems, so tense and number follow from them. Everything
is a Column: texts are lowered, cut into clauses and matched inside the JVM, and ``topics_sql`` gives the same rules to
DuckDB.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import and_, or_
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Topic(NamedTuple):
    name: str
    of: str
    says: str


class Words(str):
    """A pattern for a whole word of one of the stems, and the letters that each begins with."""

    starts: tuple[str, ...]


def words(*stems: str) -> Words:
    """Stems may have several words; ``*`` stands for any ending."""
    out = Words("(?:^|[^a-z0-9])(?:" + "|".join(s.replace("*", "[a-z]*").replace(" ", "[^a-z0-9]+") for s in stems) + ")(?:[^a-z0-9]|$)")
    out.starts = tuple(sorted({re.match("[a-z]+", s)[0] for s in stems}))
    return out


EMITTERS = ("transmitter*", "emitter*", "device*", "source", "sources")
UNSEEN = ("multipath", "interferen*", "reflection*", "scatter*", "propagation", "environmental", "weather")
ANYTHING = ""

#: What a text may not state. The names.
CLAIMS = (
    Topic("device or fingerprint identity", words(*EMITTERS, "fingerprint*"), words("identi*", "same", "unique*", "fingerprint*", "recogni*")),
    Topic("unsupported causal explanation", ANYTHING, words("caus*", "because of", "due to", "owing to", "explain*", "attribut*", "stem* from", "result* from", "brought about")),
    Topic("unsupported causal explanation", words(*UNSEEN), words("indicat*", "suggest*", "impl*", "reflect", "reflects", "show", "shows", "point* to", "reveal*")),
    Topic("directional accuracy", words("bearing*", "direction*", "azimuth*", "doa"), words("accura*", "calibrated", "calibration", "true", "absolute", "ground truth", "exact*")),
    Topic("classification or separation capability", words(*EMITTERS, "class", "classes", "types"), words("separa*", "distinguish*", "discriminat*", "classif*", "told apart", "tell* apart")),
    Topic("physical source reliability or stability", words(*EMITTERS), words("stab*", "reliab*", "consisten*", "steady", "well behaved", "trustworth*")),
    Topic("physical conclusion from a cluster", words("cluster", "clusters", "c[0-9]+"), words("vehicle*", "sensor*", "environment*", "interferen*", "transmitter*", "emitter*", "device*", "car", "cars")),
)
#: Claims in so many words, which the classes above miss: that something is the device, that kinds were shown to be apart.
PLAIN = (
    Topic("device or fingerprint identity", words("device", "transmitter", "emitter"), words(*(f"{x} (?:is|matches|identifies) (?:(?:a|an|the|any) )?(?:device|transmitter|emitter)" for x in ("it", "this", "signal", "source", "c[0-9]+")))),
    Topic("classification or separation capability", ANYTHING, words("discriminati*")),
    Topic("classification or separation capability", words("prov*", "demonstrat*", "establish*", "confirm*"), words("classification*", "separation*")),
)
ALL_CLAIMS = tuple(t for name in dict.fromkeys(t.name for t in CLAIMS) for t in (*CLAIMS, *PLAIN) if t.name == name)
#: What a report may not leave open as if it were found.
HYPOTHESES = (
    Topic("unsupported environmental explanation", words("may", "might", "could", "possibl*", "perhaps"), words("environment*", "weather")),
    Topic("unsupported transient explanation", words("may", "might", "could", "possibl*", "perhaps"), words("transient*", "moment*")),
    Topic("unsupported unobserved hypothesis", words("may", "might", "could", "possibl*", "perhaps"), words("unobserved", "unknown", "unmeasured", "hidden")),
)
#: What cannot be said where only one session is known, and where there is no earlier one of its cluster.
EARLIER = words("prior", "previous*", "earlier", "preceding", "past", "archived", "histor*")
NO_HISTORY = (Topic("historical comparison unavailable", EARLIER, words("session*", "capture*", "run", "runs", "record*", "mean*", "average*", "baseline*", "value*", "compar*")),)
NO_SAME_CLUSTER = (Topic("no prior same-cluster mean available", EARLIER, words("cluster", "c[0-9]+")),)
INVENTED = (Topic("invented reflectivity variable", ANYTHING, words("reflectiv*")), Topic("invented propagation cause", ANYTHING, words("propagation", "scatter*")))

DENIAL = words("no", "not", "never", "cannot", "neither", "nor", "none", "without", "unsupported", "unavailable", "unproven")
ACTION = words("measur*", "record*", "collect*", "compare*", "observe*", "capture*", "count*", "repeat*", "evaluat*", "assess*")
BREAKS = "[.!?](?:[ \t\r\n]|$)|[,;:\n]|[^a-z0-9](?:but|however|although|whereas|while|yet)[^a-z0-9]"
#: The longest suggestion; the headings of a report, of which the first four state findings.
LONGEST = 1500
HEADINGS = ("Summary", "Evidence", "Interpretation", "Uncertainty", "Next controlled experiment", "Scientific boundary")
FINDINGS = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Not to rule something out denies nothing.
LEFT_OPEN = r"(?:[nN][oO]|[nN]['’])[tT][ \t]+[rR][uU][lL][eE][ \t]+[oO][uU][tT]"


def left_open(text: Column | str) -> Column:
    """The text with what it does not rule out as what it leaves open."""
    return F.regexp_replace(text, F.lit(LEFT_OPEN), F.lit(" leaves open"))


def left_open_sql(text: str) -> str:
    own = LEFT_OPEN.replace("'", "''")
    return f"regexp_replace({text}, '{own}', ' leaves open', 'g')"


def clauses(text: Column | str) -> Column:
    """The clauses of a text in lower case, with contracted denials spelled out; ``not only`` denies nothing."""
    t = F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), UPPER + "’", LOWER + "'")
    for old, new in (("can't", "cannot"), ("n't", " not"), ("not only", "also")):
        t = F.replace(t, F.lit(old), F.lit(new))
    return F.split(t, BREAKS)


def on(topic: Topic) -> Callable[[Column], Column]:
    """Whether a clause is on the topic."""

    def test(clause: Column) -> Column:
        hit = clause.rlike(topic.says) & ~clause.rlike(DENIAL)
        return clause.rlike(topic.of) & hit if topic.of else hit

    return test


def may_be(topic: Topic, low: Column) -> Column:
    """False only for lowered texts without the first letters of any word of the topic, found by plain search: most texts end here."""
    has = [reduce(or_, [F.contains(low, F.lit(s)) for s in w.starts]) for w in (topic.says, topic.of) if w]
    return F.coalesce(reduce(and_, has), F.lit(False))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value made once a row however often it is used: inside lambdas and branches Spark makes it each time."""
    return F.element_at(F.transform(F.array(value), use), 1)


def topics(text: Column | str, of: tuple[Topic, ...] = CLAIMS) -> Column:
    """The names of the topics that some clause is on, each once, in the order of the rules. A null text has no clause."""
    own = F.col(text) if isinstance(text, str) else text
    none = F.array().cast("array<string>")

    def named(may: Column) -> Column:
        at = lambda c: F.array_distinct(F.array_compact(F.array(*[F.when(may[i], F.when(F.exists(c, on(t)), F.lit(t.name))) for i, t in enumerate(of)])))
        return F.when(F.array_contains(may, True), once(clauses(own), at)).otherwise(none)

    return once(once(F.lower(own), lambda low: F.array(*[may_be(t, low) for t in of])), named)


def flags(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(when, F.lit(name)) for when, name in pairs]))


def suggestion_problems(text: Column | str, known: str = "history") -> Column:
    """Why a suggested experiment may not be published, as an array. known: what it may refer to; ``session`` if only the
    selected session is known, ``no same cluster`` if no earlier session of its cluster is."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    lacking = {"session": NO_HISTORY, "no same cluster": NO_SAME_CLUSTER, "history": ()}[known]
    own = F.trim(t)
    acts = F.exists(clauses(t), lambda c: c.rlike(ACTION))
    return F.concat(flags((own == "", "empty"), (F.length(own) > LONGEST, "too long"), ((own != "") & ~acts, "no measurable action")), topics(t, CLAIMS + INVENTED + lacking))


def report_problems(text: Column | str) -> Column:
    """Why a report may not be published: headings that are missing, each a line of its own with or without ``**``, or
    topics of the part that states findings."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    line = lambda h: rf"(?i)(?:^|\n)[ \t]*(?:\*\*)?{h}(?:\*\*)?[ \t]*(?:\r?\n|$)"
    missing = flags(*[(~t.rlike(line(h)), f"missing heading: {h}") for h in HEADINGS])
    findings = F.split(t, line(HEADINGS[FINDINGS]), 2)[0]
    return F.when(F.trim(t) == "", F.array(F.lit("empty"))).when(F.size(missing) > 0, missing).otherwise(topics(findings, CLAIMS + HYPOTHESES))


def topics_sql(text: str, of: tuple[Topic, ...] = CLAIMS) -> str:
    """``topics`` joined by ``; `` as a DuckDB expression."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    t = f"replace(replace(replace(translate(coalesce({text}, ''), '{UPPER}’', '{LOWER}'''), 'can''t', 'cannot'), 'n''t', ' not'), 'not only', 'also')"
    names = list(dict.fromkeys(x.name for x in of))
    on_ = lambda x: f"regexp_matches(c, {q(x.says)}) AND NOT regexp_matches(c, {q(DENIAL)})" + (f" AND regexp_matches(c, {q(x.of)})" if x.of else "")
    case = ", ".join(f"CASE WHEN len([c FOR c IN cl IF {' OR '.join(f'({on_(x)})' for x in of if x.name == n)}]) > 0 THEN {q(n)} END" for n in names)
    return f"(SELECT array_to_string([x FOR x IN [{case}] IF x IS NOT NULL], '; ') FROM (SELECT string_split_regex({t}, {q(BREAKS)}) AS cl))"
