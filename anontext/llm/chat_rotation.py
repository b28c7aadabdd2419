"""Dialogues rendered once from every participant's side.

For each participant of a conversation, that speaker becomes the assistant, everybody else a user with a
name, and system turns stay system turns. A dialogue is returned as its segments in order, each with its
place in the rendered dialogue, so that a conversation of any length is rendered without being gathered.
Only what the assistant says, with its end mark, is to be learned: ``learn_from`` to ``learn_to``.

Turns are ordered by turn (nulls first), role, text. Null and blank roles are the participant ``unknown``;
a null text is empty; a null conv_id is a conversation of its own. Repeated rows are rendered each. Marks
that occur in a text or a name are broken up by a space, and control characters in a name, line breaks among
them, become one, so that neither can forge a turn. A conversation with system turns alone has no participant and
gives no rows. Other columns are dropped. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anontext.llm.common import stored

START, END, SYSTEM, UNKNOWN = "<|im_start|>", "<|im_end|>", "system", "unknown"


def rotate(turns: DataFrame) -> DataFrame:
    """conv_id, perspective, position, turn, speaker, role, segment, start, learn_from, learn_to.

    Turns are range-sorted once; positions and places are prefix sums within a sorted part plus the sums of
    the parts before it, so one long conversation is spread over parts.
    """
    speaker = F.coalesce(F.nullif(F.trim("role"), F.lit("")), F.lit(UNKNOWN))
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("<|im_"), F.lit("<| im_"))
    rows = turns.select("conv_id", "turn", speaker.alias("speaker"), text.alias("_text"))
    order = [F.col("turn").asc_nulls_first(), F.col("speaker"), F.col("_text")]
    sorted_ = rows.repartitionByRange(F.col("conv_id").asc_nulls_first(), *order, F.monotonically_increasing_id())
    sorted_ = stored(sorted_.withColumn("_part", F.spark_partition_id()), "chat-turns")

    sides = sorted_.where(F.col("speaker") != SYSTEM).groupBy(F.col("conv_id").alias("_conv")).agg(
        F.collect_set("speaker").alias("_sides"))
    wide = sorted_.join(sides, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    wide = wide.withColumn("perspective", F.explode("_sides")).drop("_sides")
    role = F.when(F.col("speaker") == SYSTEM, F.lit(SYSTEM)).when(
        F.col("speaker") == F.col("perspective"), F.lit("assistant")).otherwise(F.lit("user"))
    wide = wide.withColumn("role", role)
    name = F.replace(F.regexp_replace("speaker", r"[\x00-\x1F\x7F]+", " "), F.lit("<|im_"), F.lit("<| im_"))
    head = F.when(F.col("role") == "user", F.concat(F.lit(f"{START}user name="), name, F.lit("\n"))).otherwise(
        F.concat(F.lit(START), "role", F.lit("\n")))
    wide = wide.withColumn("_head", F.length(head)).withColumn("segment", F.concat(head, "_text", F.lit(f"{END}\n")))
    wide = wide.withColumn("_size", F.length("segment").cast("long"))

    parts = wide.groupBy("conv_id", "perspective", "_part").agg(F.count("*").alias("_n"), F.sum("_size").alias("_s"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("conv_id").alias("_c"), F.col("perspective").alias("_p"), F.col("_part").alias("_q"),
                         F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
                         F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"))
    here = Window.partitionBy("conv_id", "perspective", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = wide.withColumn("_n1", F.count(F.lit(1)).over(here)).withColumn(
        "_s1", F.coalesce(F.sum("_size").over(here), F.lit(0)))
    placed = placed.join(parts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("perspective") == F.col("_p"))
                         & (F.col("_part") == F.col("_q")))
    start = F.col("_s0") + F.col("_s1")
    learned = F.col("role") == "assistant"
    return placed.select(
        "conv_id", "perspective", (F.col("_n0") + F.col("_n1")).alias("position"), "turn", "speaker", "role", "segment",
        start.alias("start"), F.when(learned, start + F.col("_head")).alias("learn_from"),
        F.when(learned, start + F.col("_size") - 1).alias("learn_to"))


SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(nullif(trim(role), ''), '{UNKNOWN}') AS speaker,
                  replace(coalesce(text, ''), '<|im_', '<| im_') AS body FROM conversations),
sides AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> '{SYSTEM}'),
w AS (SELECT t.*, perspective, CASE WHEN speaker = '{SYSTEM}' THEN '{SYSTEM}' WHEN speaker = perspective
             THEN 'assistant' ELSE 'user' END AS role
      FROM t JOIN sides ON t.conv_id IS NOT DISTINCT FROM sides.conv_id),
h AS (SELECT *, '{START}' || role || CASE WHEN role = 'user' THEN ' name=' || array_to_string(string_split(
             regexp_replace(speaker, '[\\x00-\\x1F\\x7F]+', ' ', 'g'), '<|im_'), '<| im_') ELSE '' END || chr(10) AS head FROM w),
s AS (SELECT *, head || body || '{END}' || chr(10) AS segment FROM h),
p AS (SELECT *, row_number() OVER o - 1 AS position,
             coalesce(sum(length(segment)) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM s WINDOW o AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, body))
SELECT conv_id, perspective, position, turn, speaker, role, segment, start,
       CASE WHEN role = 'assistant' THEN start + length(head) END AS learn_from,
       CASE WHEN role = 'assistant' THEN start + length(segment) - 1 END AS learn_to
FROM p
"""
