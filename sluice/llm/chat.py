"""Chat formatting by multi-party perspective rotation (operator 8).

For every participant of a conversation the whole dialogue is rendered once more with that
speaker as the assistant. All other speakers become named users, system turns stay system
turns, and the loss mask covers what the assistant of that rendering says.

A rendering is built turn by turn: each turn is a segment ``<|role|>name\\ncontent<|end|>\\n``
whose place in the text follows from a running sum. Long dialogues come in parts, so a row
never holds an unbounded conversation. A ``<|`` within a text or a name is written ``<\\|``, so that no content
can forge a turn; ``original`` gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm.common import table

#: Characters of a rendered part; the turn that crosses the limit still belongs to it.
PART_CHARS = 1_000_000


def escaped(text: Column) -> Column:
    """The text without anything that looks like a mark; backslashes before a bar are doubled, so it can be undone."""
    return F.replace(F.replace(text, F.lit("\\|"), F.lit("\\\\|")), F.lit("<|"), F.lit("<\\|"))


def original(text: Column) -> Column:
    """What ``escaped`` was given."""
    return F.regexp_replace(text, r"\\(\\?)\|", "$1|")


def on_one_line(name: Column) -> Column:
    """A name with its line breaks written as escapes, since a line break ends the head of a turn."""
    return F.replace(F.replace(name, F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))


def rotate(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", system: str = "system") -> DataFrame:
    """(conv, speaker, turn, role, name, segment, start, length, mask_start, mask_length), one row per perspective and turn.

    Participants are the distinct speakers but ``system``; a null speaker is the speaker
    ``unknown``. Turns go by number, null first, ties by speaker and text; repeated rows are
    repeated turns. A null text is an empty turn, a null conversation is one conversation.
    ``start`` counts code points in the whole rendering; ``mask_start`` is null (and
    ``mask_length`` 0) but for the assistant's turns, where the mask covers content and end mark.
    Only the four named columns are read.
    """
    turns = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(speaker_col).cast("string"), F.lit("unknown")).alias("by"), F.coalesce(F.col(text_col), F.lit("")).alias("content"))
    cast = turns.where(F.col("by") != system).groupBy("conv", "by").agg(F.count("*").alias("_")).select(F.col("conv").alias("p_conv"), F.col("by").alias("speaker"))
    rows = turns.join(cast, F.col("conv").eqNullSafe(F.col("p_conv"))).drop("p_conv")
    own = F.col("by") == F.col("speaker")
    role = F.when(own, "assistant").when(F.col("by") == system, "system").otherwise("user")
    rows = rows.withColumns({"role": role, "name": F.when(role == "user", F.col("by"))})
    head = F.concat(F.lit("<|"), F.col("role"), F.lit("|>"), F.coalesce(on_one_line(escaped(F.col("name"))), F.lit("")), F.lit("\n"))
    rows = rows.withColumn("head", head).withColumn("segment", F.concat("head", escaped(F.col("content")), F.lit("<|end|>\n")))
    order = Window.partitionBy("conv", "speaker").orderBy("turn", "by", "content")
    length = F.length("segment").cast("long")
    start = F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, 0)) - length
    rows = rows.withColumns({"position": F.row_number().over(order).cast("long"), "start": start, "length": length})
    own = F.col("role") == "assistant"
    return rows.select(
        F.col("conv").alias(conv_col), "speaker", "position", F.col("turn").alias(turn_col), "role", "name", "segment", "start", "length",
        F.when(own, F.col("start") + F.length("head")).alias("mask_start"),
        F.when(own, F.col("length") - F.length("head")).otherwise(F.lit(0)).cast("long").alias("mask_length"),
    )


def render(rotated: DataFrame, conv_col: str = "conv_id", part_chars: int = PART_CHARS) -> DataFrame:
    """(conv, speaker, part, text, masks array<struct<start,length>>, n_turns, mask_chars).

    ``masks`` counts code points from the start of the part; parts concatenate to the dialogue.
    """
    rows = rotated.withColumn("part", F.floor(F.col("start") / part_chars))
    turn = F.struct("position", "segment", "start", "mask_start", "mask_length")
    parts = rows.groupBy(F.col(conv_col).alias("conv"), "speaker", "part").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    first = F.col("turns")[0]["start"]
    own = F.filter("turns", lambda t: t["mask_start"].isNotNull())
    return parts.select(
        F.col("conv").alias(conv_col), "speaker", "part",
        F.array_join(F.transform("turns", lambda t: t["segment"]), "").alias("text"),
        F.transform(own, lambda t: F.struct((t["mask_start"] - first).alias("start"), t["mask_length"].alias("length"))).alias("masks"),
        F.size("turns").cast("long").alias("n_turns"),
        F.aggregate(own, F.lit(0).cast("long"), lambda s, t: s + t["mask_length"]).alias("mask_chars"),
    )


def op8_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rendering of every conversation, with the masked text spelled out for checking."""
    out = render(rotate(table(spark, sf_dir, "conversations")))
    said = F.array_join(F.transform("masks", lambda m: F.substring(F.col("text"), (m["start"] + 1).cast("int"), m["length"].cast("int"))), "")
    return out.select("conv_id", "speaker", "part", "text", "n_turns", "mask_chars", F.sha2(said, 256).alias("masked_sha256"), F.array_join(F.transform("masks", lambda m: F.concat_ws("+", m["start"].cast("string"), m["length"].cast("string"))), ",").alias("mask_spans"))


OP8_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS who, coalesce(text, '') AS content FROM conversations
), p AS (
  SELECT DISTINCT conv_id, who AS speaker FROM t WHERE who <> 'system'
), r AS (
  SELECT t.conv_id, p.speaker, t.turn, t.who, t.content, t.who = p.speaker AS own,
         '<|' || CASE WHEN t.who = p.speaker THEN 'assistant' WHEN t.who = 'system' THEN 'system' ELSE 'user' END || '|>' ||
         CASE WHEN t.who = p.speaker OR t.who = 'system' THEN '' ELSE replace(replace(replace(replace(t.who, '\|', '\\|'), '<|', '<\|'), chr(13), '\r'), chr(10), '\n') END || chr(10) AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), s AS (
  SELECT *, head || replace(replace(content, '\|', '\\|'), '<|', '<\|') || '<|end|>' || chr(10) AS segment,
         row_number() OVER (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, who, content) AS position
  FROM r
), u AS (
  SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, speaker ORDER BY position) - length(segment) AS BIGINT) AS start FROM s
)
SELECT conv_id, speaker, CAST(start // 1000000 AS BIGINT) AS part,
       string_agg(segment, '' ORDER BY position) AS text, count(*) AS n_turns,
       CAST(coalesce(sum(length(segment) - length(head)) FILTER (WHERE own), 0) AS BIGINT) AS mask_chars,
       sha256(coalesce(string_agg(substr(segment, length(head) + 1), '' ORDER BY position) FILTER (WHERE own), '')) AS masked_sha256,
       coalesce(string_agg((start - first + length(head)) || '+' || (length(segment) - length(head)), ',' ORDER BY position) FILTER (WHERE own), '') AS mask_spans
FROM (SELECT *, min(start) OVER (PARTITION BY conv_id, speaker, start // 1000000) AS first FROM u) GROUP BY conv_id, speaker, start // 1000000
"""
