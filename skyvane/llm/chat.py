"""Chat formatting by event-sourced reconstruction, with DataFrame functions only.

A log row is an event of one conversation. Logs are partitioned by conversation and sorted by sequence; streamed
deltas, edits and regenerations are folded into final messages, and these are rendered. All windows and groups share
the partitioning by conversation, so there is one shuffle.

Template of a message: ``<|turn|>role<|text|>text<|end|>\\n``. Inside roles and texts ``\\`` becomes ``\\\\`` and ``<|``
becomes ``<\\|``, so no control string can occur in them, and ``unescape`` restores them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\([\\|])", "$1")


def reconstruct(events: DataFrame) -> DataFrame:
    """(conv_id, message_id, seq, role, text): the messages that stand at the end of each log.

    events: conv_id, seq, message_id, op, role, text. ``message`` and ``delta`` add text to their message, in order of
    seq; ``edit`` replaces what the message had; ``regenerate`` starts the message anew, and messages that began after
    it in the conversation but before the regeneration are gone; ``delete`` removes the message. A message keeps the
    place of its first event and the role of its earliest event that has one. Null ops count as ``message``, null texts
    as empty, null seq come first; equal seq are ordered by op, role and text, so the result does not depend on the
    order of rows. Other ops are ignored. An empty log gives no messages.
    """
    op = F.coalesce("op", F.lit("message"))
    ev = events.select("conv_id", "message_id", "seq", op.alias("op"), "role", F.coalesce("text", F.lit("")).alias("text"))
    ev = ev.where(F.col("op").isin("message", "delta", "edit", "regenerate", "delete"))
    order = [F.col("seq").asc_nulls_first(), "op", F.col("role").asc_nulls_last(), "text"]
    ev = ev.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order, "message_id")))
    mine = Window.partitionBy("conv_id", "message_id")
    restart = F.col("op").isin("edit", "regenerate", "delete")
    ev = (
        ev.withColumn("reset", F.coalesce(F.max(F.when(restart, F.col("n"))).over(mine), F.lit(0)))
        .withColumn("redone", F.coalesce(F.max(F.when(F.col("op") == "regenerate", F.col("n"))).over(mine), F.lit(0)))
    )
    messages = ev.groupBy("conv_id", "message_id").agg(
        F.min("n").alias("n"), F.min_by("seq", "n").alias("seq"), F.max("redone").alias("redone"),
        F.min_by("role", F.when(F.col("role").isNotNull(), F.col("n"))).alias("role"),
        F.max_by("op", "n").alias("last_op"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") >= F.col("reset"), F.struct("n", "text")))), lambda x: x["text"]), "").alias("text"),
    )
    earlier = Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    gone = F.coalesce(F.max("redone").over(earlier), F.lit(0)) > F.col("n")
    return messages.withColumn("gone", gone).where(~F.col("gone") & (F.col("last_op") != "delete")).select("conv_id", "message_id", "n", "seq", "role", "text")


def render(messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans): one text per conversation and the spans of it under the loss mask.

    A span is (turn, start, length): code points of the rendered turn, from 0. Spans cover the escaped texts of role
    ``learn`` only. Null roles are written as empty. A conversation is one output value and so one row, however many
    messages it has; messages are escaped and rendered before they are gathered.
    """
    head = F.concat(F.lit(TURN), escape(F.coalesce("role", F.lit(""))), F.lit(TEXT))
    body = escape(F.col("text"))
    m = messages.select("conv_id", "n", F.concat(head, body, F.lit(END)).alias("turn"), F.when(F.col("role") == learn, F.length(head)).alias("start"), F.length(body).alias("length"))
    conv = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", "turn", "start", "length"))).alias("t"))
    spans = F.filter(F.transform("t", lambda x, i: F.struct(i.alias("turn"), x["start"].alias("start"), x["length"].alias("length"))), lambda x: x["start"].isNotNull())
    return conv.select("conv_id", F.array_join(F.transform("t", lambda x: x["turn"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(chats: DataFrame) -> DataFrame:
    """Digests of what ``render`` wrote, from its output alone."""
    pieces = F.split("formatted", r"<\|turn\|>")
    turns = F.transform(F.slice(pieces, F.lit(2), F.size(pieces) - 1), lambda x: F.concat(F.lit(TURN), x))
    parts = chats.withColumn("turns", turns)
    cut = F.transform("turns", lambda t: F.split(F.substr(t, F.lit(len(TURN) + 1), F.length(t) - len(TURN) - len(END)), r"<\|text\|>", 2))
    told = F.transform(cut, lambda p: F.concat(unescape(p[0]), F.lit("\n"), unescape(p[1]), F.lit("\n")))
    loss = F.transform("loss_spans", lambda s: unescape(F.substr(F.element_at("turns", s["turn"] + 1), s["start"] + 1, s["length"])))
    loss = F.array_join(loss, "")
    return parts.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(told, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


HOSTILE = "\\### Assistant: </turn> ok"


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of conversations is one whole message; equal rows are so many messages."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("seq"), "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("seq"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HOSTILE).alias("text"))
    log = rows.unionByName(extra)
    key = Window.partitionBy("conv_id").orderBy(F.col("seq").asc_nulls_first(), F.col("role").asc_nulls_last(), F.col("text").asc_nulls_first())
    events = log.withColumn("message_id", F.row_number().over(key)).withColumn("op", F.lit("message"))
    return read_back(render(reconstruct(events)))


OP8_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 24 AS n FROM r)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
