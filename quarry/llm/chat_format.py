"""Multi-party chat formatting by perspective rotation, in DataFrame functions only.

For every participant of a conversation (each distinct speaker but ``system``) the whole dialogue is
rendered once with that speaker as the assistant: their turns carry the assistant tag and are trained on,
system turns keep the system tag, everyone else is a user whose name leads the text. The result is a row
per perspective and message with its place in the rendered dialogue: joining ``rendered`` of one
(conversation, perspective) by ``seq`` gives the dialogue, ``[start, end)`` is the message's span in it in
code points, and ``[mask_start, mask_end)`` the span that is trained on (text and closing tag of the
assistant's messages; null for others). Dialogues are never gathered into one row.

Places come from running sums in two steps, so a conversation of any length is spread: messages are
range-partitioned in dialogue order and written with their partition's number, summed within (dialogue,
partition), and the partitions' totals - one row each - are summed per dialogue.

Defined results: order within a conversation is turn (nulls first), speaker, text; repeated rows are
separate messages; null text is empty; a null speaker is the participant ``unknown``; rows with a null
conversation id form one conversation; a conversation with system turns only has no perspective and gives
no rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import written

OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"
SYSTEM, UNKNOWN = "system", "unknown"


def rotate(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """``(conv_id, perspective, seq, turn, speaker, tag, rendered, start, end, mask_start, mask_end)``."""
    rows = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                           F.coalesce(F.col(speaker_col), F.lit(UNKNOWN)).alias("speaker"),
                           F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    people = (rows.where(F.col("speaker") != SYSTEM)
              .groupBy(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).agg(F.count("*").alias("_n")))
    rows = rows.join(people, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv", "_n")
    own = F.col("speaker") == F.col("perspective")
    tag = F.when(own, "assistant").when(F.col("speaker") == SYSTEM, SYSTEM).otherwise("user")
    head = F.concat(F.lit(OPEN.split("{}")[0]), tag, F.lit(OPEN.split("{}")[1]),
                    F.when(tag == "user", F.concat("speaker", F.lit(": "))).otherwise(""))
    rows = rows.select("conv_id", "perspective", "turn", "speaker", "text", tag.alias("tag"), head.alias("_head"))
    rows = rows.withColumn("rendered", F.concat("_head", "text", F.lit(CLOSE)))
    rows = rows.withColumn("_len", F.length("rendered").cast("long"))
    order = ["conv_id", "perspective", "turn", "speaker", "text"]
    dealt = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    dealt = written(dealt, "chat")
    dialogue = ["conv_id", "perspective"]
    local = Window.partitionBy(*dialogue, "_part").orderBy("turn", "speaker", "text").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("_seq", F.count("*").over(local)).withColumn("_end", F.sum("_len").over(local))
    before = Window.partitionBy(*dialogue).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*dialogue, "_part").agg(F.sum("_len").alias("_sum"), F.count("*").alias("_cnt"))
    offsets = totals.select(F.col("conv_id").alias("_c"), F.col("perspective").alias("_p"), F.col("_part").alias("_q"),
                            F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_at"),
                            F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_from"))
    placed = placed.join(offsets, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("perspective") == F.col("_p"))
                         & (F.col("_part") == F.col("_q")))
    end = F.col("_at") + F.col("_end")
    start = end - F.col("_len")
    own = F.col("tag") == "assistant"
    return placed.select("conv_id", "perspective", (F.col("_from") + F.col("_seq") - 1).alias("seq"), "turn", "speaker", "tag",
                         "rendered", start.alias("start"), end.alias("end"),
                         F.when(own, start + F.length("_head")).alias("mask_start"), F.when(own, end).alias("mask_end"))


def oracle_sql() -> str:
    """DuckDB SQL of :func:`rotate` over ``conversations``."""
    return f"""
WITH m AS (SELECT conv_id, turn, coalesce(role, '{UNKNOWN}') AS speaker, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM m WHERE speaker <> '{SYSTEM}'),
r AS (SELECT m.*, perspective, CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = '{SYSTEM}' THEN '{SYSTEM}' ELSE 'user' END AS tag
  FROM m JOIN p ON m.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (SELECT *, '<|' || tag || '|>' || chr(10) || CASE WHEN tag = 'user' THEN speaker || ': ' ELSE '' END AS head FROM r),
f AS (SELECT *, head || text || '<|end|>' || chr(10) AS rendered FROM h),
s AS (SELECT *, row_number() OVER w - 1 AS seq, CAST(sum(length(rendered)) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "end" FROM f
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text))
SELECT conv_id, perspective, seq, turn, speaker, tag, rendered, "end" - length(rendered) AS "start", "end",
  CASE WHEN tag = 'assistant' THEN "end" - length(rendered) + length(head) END AS mask_start,
  CASE WHEN tag = 'assistant' THEN "end" END AS mask_end FROM s"""
