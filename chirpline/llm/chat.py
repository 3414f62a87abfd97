"""Operator 10: multi-party chat formatting by perspective rotation, in DataFrame functions only.

For every participant of a conversation (every speaker but ``system``) the dialogue is rendered
with that speaker as the assistant and the others as named users. The mask lists the character
ranges to train on: the assistant's texts with their end marks.

A rendering is a sequence of pieces of at most ``PIECE_TURNS`` turns, each with its start in the
whole rendering, so a conversation of any length is never gathered in one row; usual ones have one
piece. Turns are in order of (turn, speaker, text).

Nulls: a null role is the speaker ``unknown``, a null text is empty, a null turn comes first, and
turns with a null conv_id form one conversation with a null id. Repeated turns are all rendered.
A conversation of system turns alone has no participant and so no rendering; an empty table gives an
empty result. Names are quoted, so that no two speakers share one. Other columns of ``turns`` are not
read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table

PIECE_TURNS = 128
START, END = "<|im_start|>", "<|im_end|>\n"


def rotate_perspectives(turns: DataFrame, piece_turns: int = PIECE_TURNS) -> DataFrame:
    """conv_id, perspective, piece, n_turns, start, text, mask (array of start, stop).

    The turns are shuffled once by conversation and block of turns. Only sizes meet the participants
    and are summed along a conversation; texts meet the starts by piece, so that a conversation that
    holds a third of all turns is dealt over its pieces.
    """
    t = turns.select(
        "conv_id",
        F.coalesce(F.floor(F.col("turn") / piece_turns), F.lit(-1)).alias("block"),
        F.struct(F.col("turn"), F.coalesce("role", F.lit("unknown")).alias("speaker"), F.coalesce("text", F.lit("")).alias("text")).alias("said"),
    )
    # turns that share a number are split further, so that a piece is bounded whatever the numbers
    place = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy("said.turn", "said.speaker", "said.text"))
    pieces = (
        t.withColumn("part", F.floor((place - 1) / piece_turns))
        .groupBy("conv_id", "block", "part")
        .agg(F.array_sort(F.collect_list("said")).alias("said"))
    )
    people = turns.select(F.col("conv_id").alias("p_conv"), F.coalesce("role", F.lit("unknown")).alias("perspective")).where("perspective <> 'system'").distinct()

    def named(speaker):
        """The speaker in quotes, with backslash, quote and line break escaped."""
        for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
            speaker = F.replace(speaker, F.lit(raw), F.lit(escaped))
        return F.concat(F.lit('"'), speaker, F.lit('"'))

    def head(speaker, me):
        who = F.when(speaker == me, "assistant").when(speaker == "system", "system").otherwise(F.concat(F.lit("user name="), named(speaker)))
        return F.concat(F.lit(START), who, F.lit("\n"))

    # starts come from rows of sizes alone: texts are in no window over a whole conversation
    sizes = pieces.select("conv_id", "block", "part", F.transform("said", lambda s: F.struct(s["speaker"].alias("speaker"), (F.length(s["text"]) + len(END)).alias("n"))).alias("lines"))
    sizes = sizes.join(people, sizes.conv_id.eqNullSafe(people.p_conv)).drop("p_conv")
    sizes = sizes.select("conv_id", "perspective", "block", "part", F.aggregate("lines", F.lit(0).cast("long"), lambda n, x: n + F.length(head(x["speaker"], F.col("perspective"))) + x["n"]).alias("size"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("block", "part")
    starts = sizes.select(F.col("conv_id").alias("s_conv"), "perspective", F.col("block").alias("s_block"), F.col("part").alias("s_part"), (F.row_number().over(before) - 1).alias("piece"), (F.sum("size").over(before) - F.col("size")).alias("start"))

    same = pieces.conv_id.eqNullSafe(starts.s_conv) & (pieces.block == starts.s_block) & (pieces.part == starts.s_part)
    both = pieces.join(starts, same).withColumn("lines", F.transform("said", lambda s: F.struct(head(s["speaker"], F.col("perspective")).alias("head"), F.concat(s["text"], F.lit(END)).alias("body"), (s["speaker"] == F.col("perspective")).alias("own"))))
    empty = F.array().cast("array<struct<start:bigint,stop:bigint>>")

    def step(acc, x):
        at = acc["at"] + F.length(x["head"])
        to = at + F.length(x["body"])
        span = F.struct(at.cast("long").alias("start"), (to - 1).cast("long").alias("stop"))  # the line break isn't trained on
        return F.struct(to.cast("long").alias("at"), F.when(x["own"], F.concat(acc["mask"], F.array(span))).otherwise(acc["mask"]).alias("mask"))

    mask = F.aggregate("lines", F.struct(F.col("start").alias("at"), empty.alias("mask")), step, lambda acc: acc["mask"])
    return both.select("conv_id", "perspective", "piece", F.size("lines").alias("n_turns"), "start", F.array_join(F.transform("lines", lambda x: F.concat(x["head"], x["body"])), "").alias("text"), mask.alias("mask"))


def op10_perspective_rotation(spark, sf_dir: str) -> DataFrame:
    """Every rendering of every conversation of ``conversations``; masks as start:stop."""
    got = rotate_perspectives(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["start"].cast("string"), m["stop"].cast("string"))), ",")
    return got.withColumn("mask", spans)


OP10_SQL = """
with t as (
  select conv_id, turn, coalesce(role, 'unknown') as speaker, coalesce(text, '') as text,
         coalesce(cast(floor(turn / 128.0) as bigint), -1) as block
  from conversations),
placed as (
  select *, (row_number() over (partition by conv_id, block order by turn nulls first, speaker, text) - 1) // 128 as part from t),
people as (select distinct conv_id as p_conv, speaker as perspective from t where speaker <> 'system'),
lines as (
  select conv_id, perspective, block, part, turn, speaker, text, speaker = perspective as own,
         '<|im_start|>' || case when speaker = perspective then 'assistant' when speaker = 'system' then 'system'
           else 'user name="' || replace(replace(replace(speaker, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n') || '"' end || chr(10) as head,
         text || '<|im_end|>' || chr(10) as body
  from placed join people on conv_id is not distinct from p_conv),
places as (
  select *, sum(length(head) + length(body)) over (partition by conv_id, perspective order by block, part, turn nulls first, speaker, text rows unbounded preceding) as upto
  from lines),
pieces as (
  select conv_id, perspective, block, part, cast(count(*) as integer) as n_turns,
         cast(min(upto - length(head) - length(body)) as bigint) as start,
         string_agg(head || body, '' order by turn nulls first, speaker, text) as text,
         coalesce(string_agg(cast(upto - length(body) as bigint) || ':' || cast(upto - 1 as bigint), ',' order by upto) filter (own), '') as mask
  from places group by conv_id, perspective, block, part)
select conv_id, perspective, cast(row_number() over (partition by conv_id, perspective order by block, part) - 1 as integer) as piece,
       n_turns, start, text, mask
from pieces
"""
