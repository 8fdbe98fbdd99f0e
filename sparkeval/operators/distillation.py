"""The batch of a distillation step: student and teacher prompts, then both with the completion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkeval.functions.prompts import (
    reasoning_prompt,
    render_messages,
    student_prompt,
    teacher_prompt,
    user_message,
)
from sparkeval.functions.sequences import (
    attention_mask,
    concat_ids,
    fix_length,
    labels,
    pad_to,
    truncate,
)

SIDES = ("student", "teacher")


def prompt_pairs(
    corpus: DataFrame, key: str, reason_first: bool = False, keep: list[str] | None = None
) -> DataFrame:
    """(key, student, teacher) and the columns ``keep``: rendered prompts. A teacher that reasons first gets the prompt for its
    reasoning; what follows is ``teacher_context``."""
    teacher = reasoning_prompt if reason_first else teacher_prompt
    return corpus.select(
        key,
        render_messages(user_message(student_prompt("problem"))).alias("student"),
        render_messages(user_message(teacher("problem", "solution"))).alias("teacher"),
        *(keep or []),
    )


def collate_prompts(
    encoded: DataFrame, max_length: int = 2048, pad: int = 0
) -> DataFrame:
    """Truncate and pad both prompts to the longest of their batch (``encoded``: batch_id, and ids per
    side). Lengths of both sides are measured in one aggregation per batch.

    Per side: ``<side>_prompts``, ``_prompt_attention_mask``, ``_prompt_length`` (of the batch) and
    ``_prompt_lengths_per_example``; other columns stay.
    """
    cut = encoded.withColumns({s: truncate(s, max_length) for s in SIDES})
    longest = cut.groupBy("batch_id").agg(
        *[F.max(F.size(s)).alias(f"{s}_prompt_length") for s in SIDES]
    )
    made = cut.join(longest, "batch_id")
    for side in SIDES:
        size = f"{side}_prompt_length"
        real = F.size(side)
        made = made.withColumns(
            {
                f"{side}_prompts": pad_to(side, size, pad),
                f"{side}_prompt_attention_mask": F.concat(
                    F.array_repeat(F.lit(1), real), F.array_repeat(F.lit(0), F.col(size) - real)
                ),
                f"{side}_prompt_lengths_per_example": real,
            }
        )
    return made.drop(*SIDES)


def with_reasoning(
    prompts: DataFrame,
    reasoning: str = "reasoning",
    transition: str = "transition",
    max_reasoning: int | None = None,
    pad: int = 0,
) -> DataFrame:
    """The teacher's prompt followed by its reasoning and the transition that asks it to teach; the mask
    leaves out every pad id. ``reasoning`` and ``transition`` are columns of ids.

    The reasoning is kept whole and padded to the longest of its ``batch_id``; with ``max_reasoning`` it
    is cut and padded to that length.
    """
    if max_reasoning is None:
        size = F.max(F.size(reasoning)).alias("_longest_reasoning")
        prompts = prompts.join(prompts.groupBy("batch_id").agg(size), "batch_id")
        reasoned = pad_to(reasoning, "_longest_reasoning", pad)
    else:
        reasoned = fix_length(reasoning, max_reasoning, pad)
    whole = concat_ids("teacher_prompts", reasoned, transition)
    longer = prompts.withColumn("teacher_prompts", whole).drop("_longest_reasoning")
    return longer.withColumns(
        {
            "teacher_prompt_attention_mask": attention_mask("teacher_prompts", pad),
            "teacher_prompt_length": F.size("teacher_prompts"),
        }
    )


def assemble(
    prompts: DataFrame, completion: str, max_completion: int, keep: list[str], pad: int = 0
) -> DataFrame:
    """Both models' full sequences over the same completion (a column of ids), with masks, and labels
    that ignore the prompt and every pad id."""
    built = prompts.withColumn("_completion", fix_length(completion, max_completion, pad))
    whole = {f"{s}_input_ids": concat_ids(f"{s}_prompts", "_completion") for s in SIDES}
    built = built.withColumns(whole)
    masks = {f"{s}_attention_mask": attention_mask(f"{s}_input_ids", pad) for s in SIDES}
    made = labels("student_input_ids", "student_prompt_lengths_per_example", pad)
    return built.withColumns({**masks, "labels": made}).select(*keep, *whole, *masks, "labels")
