"""Chat formatting with prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all preceding turns are
context and only that reply is trainable. Turns after the last reply (or a
conversation without one) make one more example in which nothing is.

A turn is ``<|role|>``, a line feed, the text, ``<[end]>`` and a line feed.
Inside roles and texts ``\\``, ``<`` and ``[`` are written ``\\e``, ``\\l`` and
``\\b`` (and ``|`` in roles ``\\p``), so neither this template's marks nor those of others (``</s>``,
``[INST]``) can stand there; they are undone in reverse order.

Defined results: a null text or role is empty; turns are ordered by turn, role
and text, nulls first; a null conv_id is one conversation; an empty table
gives no examples; repeated rows are turns each. An example is as long as its
context, so a conversation's output grows with the square of its turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm.common import table

ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"))
ROLE_ESCAPES = (*ESCAPES, ("|", "\\p"))
OPEN, CLOSE, END = "<|", "|>\n", "<[end]>\n"
REPLY = "assistant"


def escape(text: Column, escapes: tuple = ESCAPES) -> Column:
    for plain, escaped in escapes:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def unescape(text: Column, escapes: tuple = ESCAPES) -> Column:
    for plain, escaped in reversed(escapes):
        text = F.replace(text, F.lit(escaped), F.lit(plain))
    return text


def examples(conversations: DataFrame) -> DataFrame:
    """``(conv_id, example, text, loss_start, loss_end)``; the loss mask in code points, null if nothing is trainable."""
    clean = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    head = lambda t: F.concat(F.lit(OPEN), escape(t["role"], ROLE_ESCAPES), F.lit(CLOSE))
    parts = (
        clean.groupBy("conv_id").agg(turns.alias("turns"))
        .select("conv_id", F.transform("turns", lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"), (t["role"] == REPLY).alias("reply"))).alias("turns"))
    )
    n = F.size("turns")
    at = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("turns", i)["reply"] | (i == n))
    rows = parts.select("conv_id", "turns", F.posexplode(at).alias("example", "at"))
    written = F.array_join(F.transform(F.slice("turns", 1, F.col("at") - 1), lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    target = F.element_at("turns", F.col("at"))
    rows = rows.select("conv_id", "example", F.concat(written, target["head"]).alias("context"), target["body"].alias("body"), target["reply"].alias("reply"))
    start = F.when(F.col("reply"), F.length("context"))
    return rows.select("conv_id", "example", F.concat("context", "body", F.lit(END)).alias("text"), start.alias("loss_start"), (start + F.length("body")).alias("loss_end"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and trainable text of each conversation, parsed from its examples."""
    loss = F.when(F.col("loss_start").isNotNull(), F.expr("substring(text, loss_start + 1, loss_end - loss_start)"))
    whole = formatted.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("last"),
        F.sort_array(F.collect_list(F.struct("example", loss.alias("loss")))).alias("losses"),
        F.sum(F.length("text")).cast("long").alias("formatted_chars"),
    )
    marked = F.filter(F.split("last", r"<\[end\]>\n"), lambda x: x != "")
    pieces = whole.select("conv_id", marked.alias("marked"), F.array_join(F.transform(F.filter("losses", lambda x: x["loss"].isNotNull()), lambda x: unescape(x["loss"])), "").alias("trained"), "formatted_chars")
    parsed = F.transform("marked", lambda x: F.struct(F.substring_index(x, CLOSE, 1).alias("head"), x.alias("raw")))
    turn = F.transform(parsed, lambda p: F.struct(unescape(F.substr(p["head"], F.lit(len(OPEN) + 1)), ROLE_ESCAPES).alias("role"), unescape(F.substr(p["raw"], F.length(p["head"]) + F.lit(len(CLOSE) + 1))).alias("text")))
    return pieces.select("conv_id", turn.alias("turns"), "trained", "formatted_chars")


def digests(turns: DataFrame) -> DataFrame:
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"), F.sha2("trained", 256).alias("loss_sha256"), "formatted_chars",
    )


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    hostile = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return digests(read_back(examples(given.unionByName(hostile))))


ORACLE = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(length(role) + length(text) + 13 + length(regexp_replace(role || text, '[^\\<\[]', '', 'g')) + length(role) - length(replace(role, '|', ''))) OVER (w ROWS UNBOUNDED PRECEDING) AS upto
  FROM given WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (WHERE role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
