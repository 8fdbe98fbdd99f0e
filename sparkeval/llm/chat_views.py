"""A dialogue seen by each of its participants.

For every participant the whole dialogue is rendered with that speaker as the assistant and all others as
named users; the mask marks what the speaker says. Directions (the system role) are kept as such and are
nobody's view.

A dialogue of any length comes in parts of ``PART_TURNS`` turn numbers, each of a bounded size; the parts
joined in order are the whole. A part that repeated turn numbers have made too large is cut further, by
turn number and by hash. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkeval.plans.skew import same_group

PART_TURNS = 64
PART_ROWS = 1024
DIRECTIONS = ("system",)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def rendered(turn: Column, speaker: Column) -> Column:
    """One turn as a struct: the text before what is said, and what is said with its end mark."""
    role = turn["role"]
    name = F.coalesce(role, F.lit("unknown"))
    head = (
        F.when(role.isin(*DIRECTIONS), F.concat(F.lit(OPEN), role, F.lit("\n")))
        .when(role == speaker, F.lit(f"{OPEN}assistant\n"))
        .otherwise(F.concat(F.lit(f"{OPEN}user name="), name, F.lit("\n")))
    )
    return F.struct(
        head.alias("head"),
        F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(CLOSE)).alias("said"),
        F.coalesce(role == speaker, F.lit(False)).alias("own"),
    )


def parts(turns: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(conv_id, part, first_turn, piece, turns): the turns of each part in order. A part of more than
    ``part_rows`` rows has a row for each turn number and piece of the hashes; else its piece is 0."""
    own = turns.select("conv_id", "turn", "role", "text").distinct()
    said = F.concat_ws("\x1f", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    placed = own.withColumn("part", F.floor(F.col("turn") / PART_TURNS).cast("bigint")).withColumn(
        "hash", F.conv(F.substring(F.md5(said), 1, 15), 16, 10).cast("bigint")
    )
    sizes = placed.groupBy("conv_id", "part").agg(F.count("*").alias("rows")).filter(F.col("rows") > part_rows)
    none = F.lit(None).cast("bigint")
    if sizes.isEmpty():
        keyed = placed.withColumns({"in_turn": none, "piece": F.lit(0).cast("bigint")})
    else:
        sized = same_group(placed, sizes, ["conv_id", "part"], "left")
        shares = F.ceil(F.col("rows") / part_rows)
        # Hashes in order fall into pieces in order, so pieces keep the order of the turns.
        piece = F.least(shares - 1, F.floor(F.col("hash") / F.lit(2.0**60) * shares))
        keyed = sized.withColumns(
            {
                "in_turn": F.when(F.col("rows").isNotNull(), F.col("turn").cast("bigint")),
                "piece": F.when(F.col("rows").isNotNull(), piece).otherwise(0).cast("bigint"),
            }
        )
    return keyed.groupBy("conv_id", "part", "in_turn", "piece").agg(
        F.sort_array(F.collect_list(F.struct("turn", "hash", "role", "text"))).alias("turns"),
        F.min("turn").cast("bigint").alias("first_turn"),
    ).drop("in_turn")


def views(turns: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(conv_id, speaker, part, first_turn, piece, n_turns, text, mask) for ``turns`` (conv_id, turn, role, text).

    ``mask`` has the start and end, in code points of ``text``, of what the speaker says, end mark
    included. Turns are in the order of their numbers, those with one number by a hash of role and text;
    turns without a number come first, in a part that is null. A row stored twice is one turn. A null text
    is empty; a null role is an unknown user without a view; a null conversation is one like any other.
    A dialogue of directions alone has no view. An empty table gives an empty one; other columns are not
    read.
    """
    named = turns.filter(F.col("role").isNotNull() & ~F.col("role").isin(*DIRECTIONS))
    speakers = named.select("conv_id", F.col("role").alias("speaker")).distinct()
    each = same_group(parts(turns, part_rows), speakers, ["conv_id"], "inner")
    shown = each.withColumn("shown", F.transform("turns", lambda t: rendered(t, F.col("speaker"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask"))

    def step(done: Column, turn: Column) -> Column:
        said = done["at"] + F.char_length(turn["head"])
        end = said + F.char_length(turn["said"])
        span = F.array(F.struct(said.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(turn["own"], F.concat(done["mask"], span)).otherwise(done["mask"]).alias("mask"))

    return shown.select(
        "conv_id",
        "speaker",
        "part",
        "first_turn",
        "piece",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("shown", lambda t: F.concat(t["head"], t["said"])), "").alias("text"),
        F.aggregate("shown", start, step)["mask"].alias("mask"),
    )
