"""Chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered with that speaker
as assistant and the others as named users; a mask marks what the model learns to
say. A rendering is a table of parts in turn order, so a conversation of any length
never has to fit into one task: parts are made where their turns lie, and the join
with the participants is on the conversation, whose partition can be split.

Cases: a null or empty role speaks as ``unknown``; a null text is empty; system
turns take no perspective of their own and are never learnt; repeated rows give
repeated parts; turns of equal number stand in order of speaker and text, a null turn
first; a null conv_id is a conversation of its own; marks of the format inside texts are
split by a space, line ends in a role are spaces; texts of any length are kept whole; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Marks of the rendered format.
START, END = "<|im_start|>", "<|im_end|>\n"


def _plain(text: Column) -> Column:
    """A mark of the format inside a text or name loses its meaning by a space."""
    return F.replace(text, F.lit("<|im_"), F.lit("<| im_"))


def _turns(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        "conv_id",
        "turn",
        F.when(F.trim(F.coalesce("role", F.lit(""))) == "", F.lit("unknown")).otherwise(F.translate(_plain(F.trim("role")), "\n", " ")).alias("speaker"),
        _plain(F.coalesce("text", F.lit(""))).alias("text"),
    )


def _head(as_role: Column, speaker: Column) -> Column:
    return F.concat(F.lit(START), as_role, F.when(as_role == "user", F.concat(F.lit(" name="), speaker)).otherwise(F.lit("")), F.lit("\n"))


def rotate(conversations: DataFrame) -> DataFrame:
    """(conv_id, perspective, turn, speaker, as_role, part, learn_start, learn_end): one row per turn and perspective.

    ``part`` is the rendered turn; characters learn_start to learn_end (exclusive) of
    it are learnt, none if both are 0. The parts of a perspective by turn, of one turn by
    speaker and then part, are its rendering (``render``).
    """
    turns = _turns(conversations)
    people = turns.filter("speaker != 'system'").select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    rows = turns.join(people, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    as_role = F.when(F.col("speaker") == "system", "system").when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    rows = rows.withColumn("as_role", as_role).withColumn("head", _head(F.col("as_role"), F.col("speaker")))
    learnt = F.col("as_role") == "assistant"
    return rows.select(
        "conv_id",
        "perspective",
        "turn",
        "speaker",
        "as_role",
        F.concat("head", "text", F.lit(END)).alias("part"),
        F.when(learnt, F.length("head")).otherwise(0).alias("learn_start"),
        F.when(learnt, F.length("head") + F.length("text") + F.lit(len(END))).otherwise(0).alias("learn_end"),
    )


def render(conversations: DataFrame) -> DataFrame:
    """(conv_id, perspective, text, learnt array<struct<start, end>>): whole renderings, each in one cell.

    For conversations that fit into a cell; ``rotate`` gives the parts of any other.
    """
    parts = rotate(conversations)
    listed = parts.groupBy("conv_id", "perspective").agg(F.sort_array(F.collect_list(F.struct("turn", "speaker", "part", "learn_start", "learn_end"))).alias("p"))
    at = lambda p, i: F.aggregate(F.slice("p", 1, i), F.lit(0), lambda n, q: n + F.length(q["part"]))
    spans = F.filter(F.transform("p", lambda p, i: F.struct((at(p, i) + p["learn_start"]).alias("start"), (at(p, i) + p["learn_end"]).alias("end"))), lambda s: s["end"] > s["start"])
    return listed.select("conv_id", "perspective", F.array_join(F.transform("p", lambda p: p["part"]), "").alias("text"), spans.alias("learnt"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = rotate(table(spark, sf_dir, "conversations"))
    return parts.select(
        "conv_id",
        "perspective",
        "turn",
        "speaker",
        "as_role",
        F.length("part").cast("long").alias("part_chars"),
        F.sha2("part", 256).alias("part_sha256"),
        F.col("learn_start").cast("long").alias("learn_start"),
        F.col("learn_end").cast("long").alias("learn_end"),
    )


OP7_SQL = """
WITH turns AS (
  SELECT conv_id, turn, CASE WHEN trim(coalesce(role, '')) = '' THEN 'unknown' ELSE replace(replace(trim(role), '<|im_', '<| im_'), chr(10), ' ') END AS speaker, replace(coalesce(text, ''), '<|im_', '<| im_') AS text
  FROM conversations
), people AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM turns WHERE speaker <> 'system'
), rows_ AS (
  SELECT t.conv_id, p.perspective, t.turn, t.speaker, t.text,
    CASE WHEN t.speaker = 'system' THEN 'system' WHEN t.speaker = p.perspective THEN 'assistant' ELSE 'user' END AS as_role
  FROM turns t JOIN people p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), heads AS (
  SELECT *, '<|im_start|>' || as_role || CASE WHEN as_role = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) AS head FROM rows_
)
SELECT conv_id, perspective, turn, speaker, as_role,
  CAST(length(head) + length(text) + 11 AS BIGINT) AS part_chars,
  sha256(head || text || '<|im_end|>' || chr(10)) AS part_sha256,
  CAST(CASE WHEN as_role = 'assistant' THEN length(head) ELSE 0 END AS BIGINT) AS learn_start,
  CAST(CASE WHEN as_role = 'assistant' THEN length(head) + length(text) + 11 ELSE 0 END AS BIGINT) AS learn_end
FROM heads
"""
