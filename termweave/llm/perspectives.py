"""Chat formatting by perspective rotation, in DataFrame functions only.

Each participant of a conversation gets the whole dialogue once, with its own turns as the assistant's and all
others' as turns of named users. The spans to learn from are those of the assistant's turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of the rendered form (fixed values); the same characters in a message are broken by a blank.
ASSISTANT, SYSTEM, USER, END = "<|assistant|>\n", "<|system|>\n", "<|user:", "<|end|>\n"


def _safe(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", context: tuple[str, ...] = ("system",), part_turns: int = 64) -> DataFrame:
    """One row for each conversation, perspective and part: conv_id, perspective, part, n_turns, text, target_spans.

    Messages stand in order of turn (null first), speaker and text; repeated rows stay. A part holds the messages
    of ``part_turns`` consecutive turn numbers, so that a conversation of any length is rendered in bounded rows;
    the parts' texts one after the other are the dialogue. ``target_spans`` lists start:end (characters of this
    part's text, comma between) of what the perspective's speaker says with its end mark, or is empty.
    A null role speaks as ``unknown``, a null text says nothing, rows without conversation id form one
    conversation. Roles in ``context`` are shown to everyone and are nobody's perspective, so a conversation of
    such turns alone gives no row. Extra columns are ignored.
    """
    speaker = F.coalesce(F.col(role_col).cast("string"), F.lit("unknown"))
    data = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        speaker.alias("speaker"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"),
    ).withColumn("part", F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-1)))
    participants = data.where(~F.col("speaker").isin(*context)).select(F.col("conv_id").alias("conv"), F.col("speaker").alias("perspective")).distinct()
    parts = data.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "speaker", "body"))).alias("messages"))
    views = parts.join(participants, F.col("conv_id").eqNullSafe(F.col("conv"))).drop("conv")

    def segment(m: Column) -> Column:
        mine = m["speaker"] == F.col("perspective")
        head = F.when(mine, F.lit(ASSISTANT)).when(m["speaker"].isin(*context), F.lit(SYSTEM)).otherwise(F.concat(F.lit(USER), _safe(m["speaker"]), F.lit("|>\n")))
        return F.struct(head.alias("head"), F.concat(_safe(m["body"]), F.lit(END)).alias("said"), mine.alias("mine"))

    size = lambda s: F.length(s["head"]) + F.length(s["said"])
    placed = views.withColumn("segments", F.transform("messages", segment)).withColumn("at", F.expr("aggregate(segments, array(0), (a, s) -> array_append(a, element_at(a, -1) + length(s.head) + length(s.said)))"))
    spans = F.transform(
        F.filter(F.zip_with("segments", F.slice("at", 1, F.size("segments")), lambda s, a: F.struct(s["mine"].alias("mine"), (a + F.length(s["head"])).alias("start"), (a + size(s)).alias("end"))), lambda x: x["mine"]),
        lambda x: F.concat(x["start"].cast("string"), F.lit(":"), x["end"].cast("string")),
    )
    return placed.select(
        "conv_id",
        "perspective",
        "part",
        F.size("messages").cast("long").alias("n_turns"),
        F.array_join(F.transform("segments", lambda s: F.concat(s["head"], s["said"])), "").alias("text"),
        F.array_join(spans, ",").alias("target_spans"),
    )


SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10) AS said,
         coalesce(text, '') AS body, coalesce(CAST(floor(turn / 64) AS BIGINT), -1) AS part
  FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
s AS (
  SELECT t.conv_id, perspective, part, said, speaker = perspective AS mine,
         CASE WHEN speaker = perspective THEN '<|assistant|>' WHEN speaker = 'system' THEN '<|system|>'
              ELSE '<|user:' || replace(speaker, '<|', '< |') || '|>' END || chr(10) AS head,
         row_number() OVER (PARTITION BY t.conv_id, perspective, part ORDER BY turn NULLS FIRST, speaker, body) AS k
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
m AS (
  SELECT *, coalesce(sum(length(head) + length(said)) OVER (PARTITION BY conv_id, perspective, part ORDER BY k
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM s)
SELECT conv_id, perspective, part, CAST(count(*) AS BIGINT) AS n_turns, string_agg(head || said, '' ORDER BY k) AS text,
       coalesce(string_agg(CAST(pos + length(head) AS VARCHAR) || ':' || CAST(pos + length(head) + length(said) AS VARCHAR), ',' ORDER BY k)
                FILTER (WHERE mine), '') AS target_spans
FROM m GROUP BY conv_id, perspective, part
"""
