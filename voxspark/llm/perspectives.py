"""Multi-party perspective rotation of dialogues, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

PART = 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _parts(messages: DataFrame, part: int) -> DataFrame:
    """conv_id, part, msgs: the dialogue in order, cut into parts of at most `part` messages."""
    rows = messages.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.floor(F.col("turn") / F.lit(part)).alias("_block"),
    )
    sizes = rows.groupBy("conv_id", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("conv_id").orderBy(F.col("_block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("conv_id").alias("_c"), F.col("_block").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inner = Window.partitionBy("conv_id", "_block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    numbered = rows.withColumn("_i", F.row_number().over(inner) - 1)
    placed = numbered.join(starts, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("_block").eqNullSafe(F.col("_b")))
    placed = placed.withColumn("_pos", F.col("_start") + F.col("_i"))
    return placed.groupBy("conv_id", F.floor(F.col("_pos") / F.lit(part)).cast("long").alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("_pos", "role", "text"))).alias("msgs")
    )


def rotate_perspectives(messages: DataFrame, part: int = PART) -> DataFrame:
    """One row per conversation, participant and part of at most `part` messages.

    The participant's messages are rendered as the assistant's, all others as users under
    their own name. `mask` lists [start, end) in code points of `text`: the participant's
    words and closing mark, which bear the loss. Parts, each a bounded group, bound what one task
    holds; they are in order, and joining a participant's parts gives the whole dialogue.

    Messages are ordered by turn (null first), then role and text; equal rows all stay.
    A null role is the participant `unknown`; a null text is an empty message; rows of null
    conv_id form one conversation. An empty table gives no rows; other columns are left out.
    """
    parts = _parts(messages, part)
    people = messages.select(F.col("conv_id").alias("_c"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("participant")).distinct()
    each = parts.join(people, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    head = f"if(m.role = participant, '{OPEN}assistant\\n', concat('{OPEN}user name=', m.role, '\\n'))"
    pieces = each.withColumn("_p", F.expr(f"transform(msgs, m -> named_struct('own', m.role = participant, 'head', {head}, 'body', concat(m.text, '{CLOSE.replace(chr(10), chr(92) + 'n')}')))"))
    spans = """aggregate(_p, named_struct('at', 0L, 'spans', cast(array() as array<struct<start:bigint,end:bigint>>)),
        (a, p) -> named_struct('at', a.at + length(p.head) + length(p.body), 'spans',
            if(p.own, array_append(a.spans, named_struct('start', a.at + length(p.head), 'end', a.at + length(p.head) + length(p.body))), a.spans)), a -> a.spans)"""
    return pieces.select(
        "conv_id",
        "participant",
        "part",
        F.size("msgs").cast("long").alias("n_messages"),
        F.expr("array_join(transform(_p, p -> concat(p.head, p.body)), '')").alias("text"),
        F.expr(spans).alias("mask"),
    )


def op1_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rotate_perspectives(table(spark, sf_dir, "conversations"))
    return rows.withColumn("mask", F.expr("array_join(transform(mask, s -> concat(s.start, ':', s.end)), ',')"))


ORACLE = f"""
WITH m AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
i AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos FROM m),
p AS (SELECT DISTINCT conv_id, role AS participant FROM m),
r AS (SELECT i.conv_id, p.participant, pos // {PART} AS part, pos, i.role = p.participant AS own,
        CASE WHEN i.role = p.participant THEN '{OPEN}assistant' || chr(10) ELSE '{OPEN}user name=' || i.role || chr(10) END AS head,
        i.text || '{CLOSE.strip()}' || chr(10) AS body
      FROM i JOIN p ON i.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, participant, part ORDER BY pos) AS fin FROM r)
SELECT conv_id, participant, CAST(part AS BIGINT) AS part, count(*) AS n_messages,
  string_agg(head || body, '' ORDER BY pos) AS text,
  coalesce(string_agg(CASE WHEN own THEN CAST(fin - length(body) AS VARCHAR) || ':' || CAST(fin AS VARCHAR) END, ',' ORDER BY pos), '') AS mask
FROM o GROUP BY conv_id, participant, part
"""
