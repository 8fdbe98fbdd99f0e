"""Chat rendering and prompt-completion pairs from a table of turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkeval.functions.prompts import opening, render_turn

def render_chat(
    df: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    prefix: str = "<|im_start|>{role}\n",
    suffix: str = "<|im_end|>\n",
    generation_prompt: str = "<|im_start|>assistant\n",
    enable_thinking: bool = True,
    part_size: int = 256,
) -> DataFrame:
    """(conv, part, rendered): each conversation's turns in order, then the generation prompt.

    The marks belong to a model's template and are parameters. A conversation of up to ``part_size``
    turns is one row; a longer one continues in the next part, so that no row grows without bound.
    Only the last part carries the generation prompt. The parts in order, joined, are the whole text.
    """
    reply = opening(generation_prompt, enable_thinking)
    part = F.floor(F.col(turn) / part_size).cast("int").alias("part")
    lines = df.select(conv, part, turn, render_turn(role, text, prefix, suffix).alias("_line"))
    # The generation prompt joins as one more line behind the last turn: no join with the texts.
    last = df.groupBy(conv).agg(F.max(turn).alias(turn))
    ends = last.select(conv, part, (F.col(turn) + 1).alias(turn), F.lit(reply).alias("_line"))
    return (
        lines.unionByName(ends)
        .groupBy(conv, "part")
        .agg(F.array_sort(F.collect_list(F.struct(turn, "_line"))).alias("_lines"))
        .select(
            conv,
            "part",
            F.array_join(F.transform("_lines", lambda t: t["_line"]), "").alias("rendered"),
        )
    )


def exchanges(
    df: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """(conv, turn, prompt, completion): each user turn with the assistant turn that follows it."""
    asked = df.filter(F.col(role) == "user").select(conv, turn, F.col(text).alias("prompt"))
    answered = df.filter(F.col(role) == "assistant").select(
        conv, (F.col(turn) - 1).alias(turn), F.col(text).alias("completion")
    )
    return asked.join(answered, [conv, turn])
