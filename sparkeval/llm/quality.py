"""Quality rules as a ledger of bits.

Every rule is evaluated once per document. Its failure is one bit of ``failures``, and what it measured
stays beside it, so a policy (a set of rules with a version number) is one bitwise test and can be
changed without reading a text again. What each rule contributes to a policy is found by counting
documents per bit pattern: at most 2^rules groups, summed before the shuffle.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkeval.llm.common import append, fresh, struct

SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"
MEASURES = struct(
    n_words="bigint",
    word_chars="bigint",
    n_symbols="bigint",
    n_dup_lines="bigint",
    n_repeat_words="bigint",
    n_lines="bigint",
    n_upper="bigint",
    n_letters="bigint",
)


def _rules(m: Column) -> dict[str, Column]:
    """Each rule's failure, by name, in the order of its bit. New rules are added at the end."""
    return {
        "few_words": m["n_words"] < 50,
        "repeated_words": 100 * m["n_repeat_words"] > 50 * m["n_words"],
        "symbols": 2 * m["n_symbols"] > m["n_words"],
        "repeated_lines": 2 * m["n_dup_lines"] > m["n_lines"],
        "long_words": m["word_chars"] > 40 * m["n_words"],
        "shouting": (m["n_letters"] >= 50) & (10 * m["n_upper"] > 7 * m["n_letters"]),
    }


RULES = ("few_words", "repeated_words", "symbols", "repeated_lines", "long_words", "shouting")
# A policy, by version: the rules that a document must pass.
POLICIES = {1: RULES[:2], 2: RULES}


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << RULES.index(r) for r in rules)


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a three-word window which occurs twice or more."""
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    pairs = ids[:-1] * len(numbers) + ids[1:]
    if len(numbers) > 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(numbers) + ids[2:]
    order = np.sort(windows)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    again = np.isin(windows, twice)
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + len(again)] |= again
    return int(covered.sum())


def measure_text(text: str | None) -> tuple:
    text = text or ""
    raw = text.encode()
    words = raw.split()  # bytes are split at \\x20 and \\x09-\\x0D alone
    lines = Counter(raw.split(b"\n"))
    worded = {line: n for line, n in lines.items() if line.strip(WHITE)}
    letters = [c for c in text if c.isalpha()] if not raw.isascii() else None
    if letters is None:
        upper = len(raw) - len(raw.translate(None, bytes(range(65, 91))))
        n_letters = upper + len(raw) - len(raw.translate(None, bytes(range(97, 123))))
    else:
        upper, n_letters = sum(map(str.isupper, letters)), len(letters)
    return (
        len(words),
        len(text) - (len(raw) - len(raw.translate(None, WHITE))),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        sum(n - 1 for n in worded.values()),
        repeated_words(words),
        sum(worded.values()),
        upper,
        n_letters,
    )


def ledger(df: DataFrame, text: str = "text", into: str = "quality") -> DataFrame:
    """Add ``into``: a struct of the measurements and ``failures``, the bits of the failed rules.

    A null text has no words, like an empty one. Each row is measured on its own: repeated rows get
    equal values, an empty table gives an empty table, other columns stay (one named ``into`` is
    replaced). Words are separated by \\x20 and \\x09-\\x0D.
    """
    held = fresh(df, "_measures")
    measured = append(df, held, MEASURES, lambda c: [measure_text(t) for t in c[text]], [text])
    bits = [
        F.when(failed, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint")
        for i, failed in enumerate(_rules(F.col(held)).values())
    ]
    failures = sum(bits[1:], bits[0])
    fields = [F.col(f"{held}.{f.name}") for f in MEASURES]
    return measured.withColumn(into, F.struct(*fields, failures.alias("failures"))).drop(held)


def passes(failures: Column, version: int) -> Column:
    """Whether the bits leave a document in under the policy of that version."""
    return failures.bitwiseAND(F.lit(mask(POLICIES[version]))) == 0


def ablations(ledgers: DataFrame, version: int, column: str = "quality") -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail it alone, and kept without the rule.

    One aggregation over bit patterns. An empty table gives zeros.
    """
    rules = POLICIES[version]
    patterns = ledgers.groupBy(
        F.col(column)["failures"].bitwiseAND(F.lit(mask(rules))).alias("bits")
    ).agg(F.count("*").alias("n"))

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    per_rule = [
        F.struct(
            F.lit(r).alias("rule"),
            total(F.col("bits").bitwiseAND(F.lit(mask((r,)))) != 0).alias("failed"),
            total(F.col("bits") == mask((r,))).alias("failed_alone"),
            total(F.col("bits").bitwiseAND(F.lit(~mask((r,)))) == 0).alias("kept_without"),
        )
        for r in rules
    ]
    return patterns.agg(F.array(*per_rule).alias("r")).select(F.inline("r"))
