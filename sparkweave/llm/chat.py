"""Conversations rendered for chat training, once from the side of each participant. Spark SQL only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turn numbers that a rendered row covers; a longer conversation gives several rows, to be read in order of chunk.
CHUNK_TURNS = 64
#: Roles that set the scene and speak for no one.
CONTEXT_ROLES = ("system",)
END = "<|end|>\n"


def _head(role: Column, perspective: Column, context: tuple[str, ...]) -> Column:
    name = F.replace(F.replace(F.coalesce(role, F.lit("unknown")), F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))
    user = F.concat(F.lit("<|user name="), name, F.lit("|>\n"))
    out = F.when(role == perspective, F.lit("<|assistant|>\n"))
    if context:
        out = out.when(role.isin(*context), F.concat(F.lit("<|"), role, F.lit("|>\n")))
    return out.otherwise(user)


def rotate(conversations: DataFrame, chunk_turns: int = CHUNK_TURNS, context: tuple[str, ...] = CONTEXT_ROLES) -> DataFrame:
    """Every conversation from the side of each of its participants.

    A participant is a role that is neither null nor a context role. From its side, its own turns are the assistant's,
    every other participant's are those of a user by that name, and context roles keep theirs. Returns per conversation,
    perspective and chunk: conv_id, perspective, chunk, n_turns, text, and spans, the places [start, end) in characters
    of text that count for the loss: what the assistant says and its end mark, not its header.

    Turns stand by (turn, role, text), nulls first. A row covers chunk_turns turn numbers, so that what is gathered for
    one is bounded by those and not by the conversation; chunk is turn div chunk_turns, and -1 for null turns. Rows that
    are repeated are rendered as often as they occur. A null text is empty; a null role is a user named unknown; rows with a null conv_id make up one
    conversation. "<|" in a text or name is written "< |", and "|>" in a name "| >", so
    none can forge a header or end one early; a role called unknown looks as a null one does. Conversations without a
    participant, and empty tables, give no rows. Other columns are ignored.
    """
    turns = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    turns = turns.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / F.lit(chunk_turns)), F.lit(-1)).cast("long"))
    speaks = F.col("role").isNotNull() & ~F.col("role").isin(*context) if context else F.col("role").isNotNull()
    people = turns.where(speaks).groupBy(F.col("conv_id").alias("of")).agg(F.array_sort(F.collect_set("role")).alias("people"))
    chunks = turns.join(people, F.col("conv_id").eqNullSafe(F.col("of"))).groupBy("conv_id", "chunk").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"), F.any_value("people").alias("people")
    )
    sides = chunks.select("conv_id", "chunk", "turns", F.explode("people").alias("perspective"))

    def part(t: Column) -> Column:
        head = _head(t["role"], F.col("perspective"), context)
        body = F.concat(F.replace(F.coalesce(t["text"], F.lit("")), F.lit("<|"), F.lit("< |")), F.lit(END))
        return F.struct(head.alias("head"), body.alias("body"), F.coalesce(t["role"] == F.col("perspective"), F.lit(False)).alias("own"))

    parts = sides.withColumn("parts", F.transform("turns", part))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def follow(a: Column, p: Column) -> Column:
        start = a["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        span = F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"))
        return F.struct(end.cast("long").alias("at"), F.when(p["own"], F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))

    return parts.select(
        "conv_id",
        "perspective",
        "chunk",
        F.size("turns").cast("long").alias("n_turns"),
        F.concat_ws("", F.transform("parts", lambda p: F.concat(p["head"], p["body"]))).alias("text"),
        F.aggregate("parts", begin, follow)["spans"].alias("spans"),
    )


def query(conversations: DataFrame) -> DataFrame:
    """rotate, with the spans written as text: start-end, parted by commas."""
    spans = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))))
    return rotate(conversations).withColumn("spans", spans)


SQL = """
WITH t AS (
  SELECT conv_id, turn, role, text, coalesce(floor(turn / 64.0)::BIGINT, -1) AS chunk FROM conversations
), people AS (
  SELECT DISTINCT conv_id, role AS perspective FROM conversations WHERE role IS NOT NULL AND role <> 'system'
), parts AS (
  SELECT t.*, perspective, coalesce(role = perspective, false) AS own,
    CASE WHEN role = perspective THEN '<|assistant|>' || chr(10) WHEN role = 'system' THEN '<|system|>' || chr(10)
      ELSE '<|user name=' || replace(replace(coalesce(role, 'unknown'), '<|', '< |'), '|>', '| >') || '|>' || chr(10) END AS head,
    replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10) AS body
  FROM t JOIN people ON t.conv_id IS NOT DISTINCT FROM people.conv_id
), placed AS (
  SELECT *, row_number() OVER w AS k, sum(length(head) + length(body)) OVER w AS until
  FROM parts WINDOW w AS (PARTITION BY conv_id, perspective, chunk ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
SELECT conv_id, perspective, chunk, count(*) AS n_turns, string_agg(head || body, '' ORDER BY k) AS text,
  coalesce(string_agg((until - length(body))::BIGINT::VARCHAR || '-' || until::BIGINT::VARCHAR, ',' ORDER BY k) FILTER (WHERE own), '') AS spans
FROM placed GROUP BY conv_id, perspective, chunk
"""
