"""Answer extraction and comparison, against the edge rows and against a plain statement of the rules."""

from __future__ import annotations

import random

import pytest

from pyspark.sql import functions as F

from sparkeval.functions.answers import (
    NO_ANSWER,
    boxed_first,
    boxed_last,
    equivalent,
    exact_reward,
    fallback_equal,
    normalize_answer,
    stored_prediction,
    strip_ws,
)

# text, first box, last box
BOXES = [
    ("no box", None, None),
    (r"\boxed{ 7 }", "7", "7"),
    (r"\boxed{\frac{1}{2}}", r"\frac{1}{2}", r"\frac{1}{2}"),
    (r"\boxed{X} … \boxed{Y}", "X", "Y"),
    (r"\boxed{a \boxed{b}}", r"a \boxed{b}", "b"),
    (r"\boxed{A} then \boxed{", "A", None),
    (r"\boxed{A} then \boxed 5", "A", None),
    (r"\boxed{unclosed {x}", None, None),
    (r"\boxed{unclosed then \boxed{B}", None, "B"),
    (r"\boxed{}", "", ""),
    (r"\boxed 5 {x}", None, None),
    (r"\boxed{a}}", "a", "a"),
    (r"\boxed{{a}{b{c}}}d}", "{a}{b{c}}", "{a}{b{c}}"),
    ("", None, None),
    (None, None, None),
]


def body(text: str, start: int) -> str | None:
    """Characters from ``start`` up to the brace that closes the group around them."""
    open_groups = 1
    for end, char in enumerate(text[start:], start):
        open_groups += {"{": 1, "}": -1}.get(char, 0)
        if open_groups == 0:
            return text[start:end].strip()
    return None


def first(text: str) -> str | None:
    at = text.find(r"\boxed{")
    return None if at < 0 else body(text, at + 7)


def last(text: str) -> str | None:
    at = text.rfind(r"\boxed")
    return body(text, at + 7) if at >= 0 and text[at + 6 : at + 7] == "{" else None


def test_edge_boxes(spark):
    df = spark.createDataFrame([(t,) for t, _, _ in BOXES], "t string")
    rows = df.select(boxed_first("t").alias("f"), boxed_last("t").alias("l")).collect()
    assert [(r.f, r.l) for r in rows] == [(f, l) for _, f, l in BOXES]


def test_random_boxes(spark):
    rng = random.Random(5)
    pieces = ["{", "}", r"\boxed{", r"\boxed", "a", " ", "\t", "é", "😀", "\n", "\u3000", "}{"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(14))) for _ in range(4000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", boxed_first("t").alias("f"), boxed_last("t").alias("l")).collect()
    assert [(r.t, r.f, r.l) for r in rows] == [(t, first(t), last(t)) for t in texts]


def test_long_unclosed_text(spark):
    text = r"\boxed{" + "{}" * 20_000 + "x" * 100_000
    df = spark.createDataFrame([(text,), (text + "}",)], "t string")
    rows = [r.f for r in df.select(F.length(boxed_first("t")).alias("f")).collect()]
    assert rows == [None, 140_000]


def test_strip_is_unicode(spark):
    text = "\u00a0\t\n\u3000\x1f x y \x1c\u2003\x85"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(strip_ws("t"), normalize_answer(F.lit("  Ab\u00a0"))).first()[:] == ("x y", "ab")


@pytest.mark.parametrize(
    "predicted, gold, reward",
    [(" A ", "a", 1.0), (None, "a", 0.0), ("a", None, 0.0), (None, None, 0.0), ("1/2", "0.5", 0.0)],
)
def test_exact_reward(spark, predicted, gold, reward):
    df = spark.createDataFrame([(predicted, gold)], "p string, g string")
    assert df.select(exact_reward("p", "g")).first()[0] == reward


EQUIVALENT = [
    ("1/2", "0.5", True),
    (r"\frac{1}{2}", "0.50", True),
    (r"50\%", "1/2", True),
    ("50%", ".5", True),
    ("1,234", "1234", True),
    ("1,23", "123", False),
    (r"\dfrac{-3}{4}", "-0.75", True),
    (r"-\frac{3}{4}", "-.75", True),
    ("+7", "7.", True),
    ("2/4", "1/2", True),
    ("-0", "0", True),
    ("x+1", "x + 1", True),
    (r"\text{A}", "A", True),
    ("A", "a", False),
    ("$ 3 $", "3", True),
    (r"\left(1,2\right)", "(1,2)", True),
    ("1/0", "2/0", False),
    ("1/3", "0.333333", False),
    ("12345678901234567890", "12345678901234567890", True),
    ("12345678901234567890", "12345678901234567891", False),
    ("1e3", "1000", False),
    (".", "0", False),
    ("1234567890123456", "1234567890123456.0", True),
    ("0.50000000000000000", "1/2", True),
    ("1234567890123456789012345678901234567890", "1234567890123456789012345678901234567890.00", True),
    ("1234567890123456789012345678901234567890", "1234567890123456789012345678901234567891", False),
    ("2469135780246913578024691357802469135780/2", "1234567890123456789012345678901234567890", True),
    ("1/3", "333333333333333333333333333333/1000000000000000000000000000000", False),
    ("111111111111111111111/333333333333333333333", "1/3", True),
    ("-111111111111111111111/333333333333333333333", "1/3", False),
    (r"\frac12", "0.5", True),
    (r"\frac1{2}", "1/2", True),
    (r"\frac{1}2", "1/2", True),
    (r"\frac{3}{12}", "1/4", True),
    ("1{,}234", "1234", True),
    (r"90^\circ", "90", True),
    (r"90^{\circ}", "90.0", True),
    (r"5\text{ cm}", "5", True),
    (r"\frac{1}{2}\text{ m}", "0.5", True),
    ("x=5", "5", True),
    ("x=y", "y", True),
    ("x=5", "6", False),
    (r"\$5", "5", True),
    ("{5}", "5", True),
    (r"1.2\times10^3", "1200", True),
    (r"1.2 \cdot 10^{-3}", "0.0012", True),
    (r"1.2\times 10^{3}", "1201", False),
    (r"\frac{1}{-2}", "-0.5", True),
    (r"-\frac{-1}{2}", "0.5", True),
    (r"\frac{1.5}{3}", "1/2", True),
    ("(0.5,2)", "(1/2,2)", True),
    (r"\left(\frac12, 2\right)", "(0.5,2.0)", True),
    ("(0.5,2]", "(1/2,2)", False),
    ("(0.5,2)", "(2,1/2)", False),
    ("(1,2,3)", "(1,2)", False),
    ("(a,1)", "(a,1.0)", True),
    ("00.50", ".5", True),
    ("-0.0", "0", True),
    ("5%", "0.05", True),
    ("1/2%", "0.005", False),
    ("1/0", "0", False),
    ("", "0", False),
    ("", "", True),
    (None, "a", False),
    ("a", None, False),
]


def test_equivalent(spark):
    df = spark.createDataFrame(EQUIVALENT, "p string, g string, e boolean")
    wrong = df.filter(~equivalent("p", "g").eqNullSafe(F.col("e"))).collect()
    assert wrong == []


def test_fallback(spark):
    rows = [("$ A b $", "ab", True), ("1/2", "0.5", False), (None, "a", False), ("a", None, False)]
    df = spark.createDataFrame(rows, "p string, g string, e boolean")
    assert df.filter(fallback_equal("p", "g") != F.col("e")).count() == 0


def test_stored_prediction(spark):
    df = spark.createDataFrame([(None,), ("",), ("A",)], "p string")
    assert [r[0] for r in df.select(stored_prediction("p")).collect()] == [NO_ANSWER, NO_ANSWER, "A"]
