"""Prompt texts. Each function builds one string column from the columns of a corpus."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkeval.functions.common import ColumnOrName, as_column

# The wording of the prompts.
INSTRUCTION = "Please reason step by step, and put your final answer within \\boxed{}."
TRANSITION = (
    "\n\nAfter understanding the reference solution and the rationale behind each step, now articulate"
    " your own step-by-step reasoning that derives the same final answer to the problem below:\n"
)
ANALYSE = (
    "\n\nThe reference reasoning above arrives at the correct answer. Please analyze this solution and"
    " explain the key reasoning steps and problem-solving strategies employed. Do NOT use <think> tags."
    " Do NOT derive your own solution. Simply analyze and explain the reference solution provided"
    " above.\n"
)
REASONING_START = "Here is a correct reasoning to this problem:=== Reference Reasoning Start ===\n"
REASONING_END = "\n=== Reference Reasoning End ===\n\n"
SOLUTION_START = "\n\nHere is a reference solution to this problem:\n"
THINKING_OFF = "<think>\n\n</think>\n\n"
TRANSITION_SUFFIX = "\n" + TRANSITION + "\n" + INSTRUCTION


def _text(*parts: ColumnOrName | tuple[str]) -> Column:
    """Concatenate columns; a 1-tuple is literal text."""
    return F.concat(*[F.lit(p[0]) if isinstance(p, tuple) else as_column(p) for p in parts])


def sft_text(question: ColumnOrName, solution: ColumnOrName) -> Column:
    return _text(("Problem: ",), question, ("\nSolution: ",), solution)


def grpo_prompt(question: ColumnOrName) -> Column:
    return _text(("Problem: ",), question, ("\n " + INSTRUCTION,))


def student_prompt(problem: ColumnOrName) -> Column:
    return _text(("Problem: ",), problem, ("\n\n" + INSTRUCTION,))


def teacher_prompt(problem: ColumnOrName, solution: ColumnOrName) -> Column:
    return _text(problem, (SOLUTION_START,), solution, (TRANSITION_SUFFIX,))


def reasoning_prompt(problem: ColumnOrName, solution: ColumnOrName) -> Column:
    return _text(
        ("Problem: ",),
        problem,
        ("\n\n" + REASONING_START,),
        solution,
        (REASONING_END + ANALYSE,),
    )


def teacher_context(prompt: ColumnOrName, reasoning: ColumnOrName) -> Column:
    """What the teacher reads once its own reasoning is known."""
    return _text(prompt, reasoning, (TRANSITION_SUFFIX,))


def eval_prompt(problem: ColumnOrName) -> Column:
    return _text(problem, ("\n\n" + INSTRUCTION,))


def teacher_prompt_by_mode(
    problem: ColumnOrName, solution: ColumnOrName, reason_first: ColumnOrName
) -> Column:
    """Empty placeholder where the teacher reasons first, else the teacher prompt."""
    return F.when(as_column(reason_first), F.lit("")).otherwise(teacher_prompt(problem, solution))


def preview(text: ColumnOrName, size: int = 100) -> Column:
    return F.substring(as_column(text), 1, size)


def strip_special(text: ColumnOrName, tokens: list[str]) -> Column:
    """Remove special-token texts, longest first so that no token is cut by a shorter one."""
    quoted = ["\\Q" + t + "\\E" for t in sorted(tokens, key=len, reverse=True)]
    return F.regexp_replace(as_column(text), "|".join(quoted), "") if quoted else as_column(text)


def render_turn(role: ColumnOrName, text: ColumnOrName, prefix: str, suffix: str) -> Column:
    """One turn; ``{role}`` in ``prefix`` stands for the role."""
    before, found, after = prefix.partition("{role}")
    start = F.concat(F.lit(before), as_column(role), F.lit(after)) if found else F.lit(before)
    return F.concat(start, as_column(text), F.lit(suffix))


def opening(generation_prompt: str, enable_thinking: bool = True) -> str:
    """Start of the reply that the model is asked for."""
    return generation_prompt + ("" if enable_thinking else THINKING_OFF)


def user_message(text: ColumnOrName) -> Column:
    """A list of one message."""
    return F.array(F.struct(F.lit("user").alias("role"), as_column(text).alias("content")))


def render_messages(
    messages: ColumnOrName,
    prefix: str = "<|im_start|>{role}\n",
    suffix: str = "<|im_end|>\n",
    generation_prompt: str = "<|im_start|>assistant\n",
    enable_thinking: bool = True,
) -> Column:
    """Chat text of a list of ``struct<role, content>``; the marks belong to a model's template."""
    turns = F.transform(
        as_column(messages), lambda m: render_turn(m["role"], m["content"], prefix, suffix)
    )
    return F.concat(F.array_join(turns, ""), F.lit(opening(generation_prompt, enable_thinking)))
