"""Algebraic equality of answers, as Columns: both sides are evaluated at random points modulo primes.

An answer is cut into tokens, and one fold over them reads and evaluates it at once: for each open bracket
there is a frame with the sum so far, the product so far and the last factor, all as numerator and
denominator modulo a prime. Letters and named symbols have random values. Two rational expressions of
degree n that differ agree at a point with a chance of about n / 2^31, so one that agrees at two points is
taken for equal (identity testing). Roots are powers modulo primes in which the primes up to 37 are squares, so
that they multiply as roots do and come out of squares; where a value has no root the point says nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkeval.functions.answers import canonical_answer, equivalent
from sparkeval.functions.common import ColumnOrName, as_column, let

# The greatest primes below 2^31 that are 7 modulo 8 and have all primes up to 37 as squares; roots are then
# powers to (p + 1) / 4, and products of two remainders are 64-bit numbers.
PRIMES = (2147481311, 2147366399, 2147260631, 2147161799, 2147072639, 2146780919)
AGREEING = 2  # points that have to agree, fewer only if the others say nothing
_EXPONENT_DIGITS = 4
_TOKENS = (
    r"\\[a-zA-Z]+"  # a command
    r"|\d+(?:\.\d+)?|\.\d+"
    rf"|\^(?:[+-]?\d{{1,{_EXPONENT_DIGITS}}}(?!\d)|\{{[+-]?\d{{1,{_EXPONENT_DIGITS}}}\}}|\([+-]?\d{{1,{_EXPONENT_DIGITS}}}\))"
    r"|(?s:.)"
)
# Commands that are names of numbers or of variables; any other command is not read.
_NAMES = (
    r"\\(?:alpha|beta|gamma|delta|epsilon|varepsilon|zeta|eta|theta|iota|kappa|lambda|mu|nu|xi|pi|rho|sigma|tau|phi"
    r"|varphi|chi|psi|omega)"
)
_SYMBOLS = rf"^(?:[a-zA-Zα-ω]|{_NAMES})$"
_WORD = r"(?<!\\)(?<![a-zA-Z\\])[a-zA-Z]{4,}"  # a word is no product of its letters
_FIELDS = ("kind", "sum_n", "sum_d", "minus", "term_n", "term_d", "by", "has", "last_n", "last_d", "top_n", "top_d")


def tokens(answer: ColumnOrName) -> Column:
    """The tokens of an answer; null for answers with a word in them, and for null."""
    text = as_column(answer).cast("string")
    apart = F.regexp_replace(text, rf"({_NAMES})\s+(?=[a-zA-Z])", "$1*")  # spaces go, but part a name from a letter
    apart = F.regexp_replace(apart, r"\\(?:cdot|times)\s+(?=[a-zA-Z])", "*")
    text = canonical_answer(F.when(F.contains(text, F.lit("\\")), apart).otherwise(text))

    def cut(t: Column) -> Column:
        plain = F.regexp_replace(t, r"\\(?:cdot|times)(?![a-zA-Z])|[×·]", "*")
        plain = F.regexp_replace(plain, r"\\div(?![a-zA-Z])|÷", "/")
        plain = F.regexp_replace(plain, r"\\sqrt(\w)", r"\\sqrt{$1}")
        return F.when(~F.rlike(t, F.lit(_WORD)), F.regexp_extract_all(F.translate(plain, "−", "-"), F.lit(_TOKENS), F.lit(0)))

    return let(text, cut)


def _number(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _power(base: Column, exponent: Column, prime: Column, bits: int) -> Column:
    start = F.struct(_number(1).alias("done"), base.alias("square"), exponent.cast("bigint").alias("left"))

    def step(s: Column, _: Column) -> Column:
        done = F.when(s["left"] % 2 == 1, s["done"] * s["square"] % prime).otherwise(s["done"])
        return F.struct(
            done.alias("done"),
            (s["square"] * s["square"] % prime).alias("square"),
            F.floor(s["left"] / 2).cast("bigint").alias("left"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(bits)), start, step, lambda s: s["done"])


def _frame(kind: Column, top_n: Column, top_d: Column) -> Column:
    """A bracket that has just been opened. ``top`` is the numerator of the fraction that it completes."""
    values = dict(
        kind=kind, sum_n=_number(0), sum_d=_number(1), minus=F.lit(False), term_n=_number(1), term_d=_number(1),
        by=F.lit(False), has=F.lit(False), last_n=_number(1), last_d=_number(1), top_n=top_n, top_d=top_d,
    )
    return F.struct(*[values[f].alias(f) for f in _FIELDS])


def _changed(frame: Column, **changes: Column) -> Column:
    return F.struct(*[changes.get(f, frame[f]).alias(f) for f in _FIELDS])


def _product(f: Column, prime: Column) -> tuple[Column, Column]:
    """The product so far with the last factor, which ``by`` says to divide by."""
    above = F.when(f["by"], f["last_d"]).otherwise(f["last_n"])
    below = F.when(f["by"], f["last_n"]).otherwise(f["last_d"])
    return f["term_n"] * above % prime, f["term_d"] * below % prime


def _total(f: Column, prime: Column) -> Column:
    """struct<n, d>: the sum so far with the product so far."""
    above, below = _product(f, prime)
    term = F.struct(F.when(f["minus"], (prime - above) % prime).otherwise(above).alias("n"), below.alias("d"))
    return let(
        term,
        lambda t: F.struct(
            ((f["sum_n"] * t["d"] % prime + t["n"] * f["sum_d"] % prime) % prime).alias("n"),
            (f["sum_d"] * t["d"] % prime).alias("d"),
        ),
    )


def _operand(f: Column, value: Column, prime: Column) -> Column:
    """A number, a symbol or a closed bracket as the last factor; one behind another multiplies."""
    above, below = _product(f, prime)
    return _changed(
        f,
        term_n=F.when(f["has"], above).otherwise(f["term_n"]),
        term_d=F.when(f["has"], below).otherwise(f["term_d"]),
        by=f["by"] & ~f["has"],
        has=F.lit(True),
        last_n=value["n"],
        last_d=value["d"],
    )


def _decimal(token: Column, prime: Column) -> Column:
    digits = F.replace(token, F.lit("."), F.lit(""))
    places = F.when(F.contains(token, F.lit(".")), F.length(F.substring_index(token, ".", -1))).otherwise(0)
    parts = F.transform(
        F.regexp_extract_all(F.lpad(digits, F.ceil(F.length(digits) / 9).cast("int") * 9, "0"), F.lit(r"\d{9}"), F.lit(0)),
        lambda x: x.cast("bigint"),
    )
    n = F.aggregate(parts, _number(0), lambda r, x: (r * 1_000_000_000 + x) % prime)
    return F.struct(n.alias("n"), _power(_number(10), places, prime, 14).alias("d"))


def value(of: Column, prime: Column, seed: Column) -> Column:
    """``struct<n, d>``, the value of a list of tokens at the point ``seed`` modulo ``prime``; null where the
    tokens are no expression, a divisor is 0 or a value has no root."""
    none = F.struct(_number(1).alias("n"), _number(1).alias("d"))
    first = _frame(F.lit("all"), _number(1), _number(1))
    start = F.struct(
        F.lit(False).alias("bad"),
        F.lit("group").alias("next"),  # what the next bracket is
        none.alias("over"),  # the numerator of a fraction whose denominator comes next
        F.slice(F.array(first), 1, 0).alias("outer"),
        first.alias("frame"),
    )

    def state(s: Column, **changes: Column) -> Column:
        names = ("bad", "next", "over", "outer", "frame")
        return F.struct(*[changes.get(n, s[n]).alias(n) for n in names])

    def failed(s: Column) -> Column:
        return state(s, bad=F.lit(True))

    def root(x: Column) -> Column:
        return _power(x, F.floor((prime + 1) / 4).cast("bigint"), prime, 31)

    def closed(s: Column, t: Column) -> Column:
        f, outer = s["frame"], F.element_at(s["outer"], -1)
        opening = F.when(t == "}", F.lit("{")).when(t == ")", F.lit("(")).otherwise(F.lit("["))
        rest = F.slice(s["outer"], F.lit(1), F.size(s["outer"]) - 1)

        def done(v: Column) -> Column:
            rooted = F.struct(root(v["n"]).alias("n"), root(v["d"]).alias("d"))
            return (
                F.when(
                    F.endswith(f["kind"], F.lit("sqrt")),
                    let(
                        rooted,
                        lambda r: state(
                            s,
                            bad=(r["n"] * r["n"] % prime != v["n"]) | (r["d"] * r["d"] % prime != v["d"]),
                            next=F.lit("group"), outer=rest, frame=_operand(outer, r, prime),
                        ),
                    ),
                )
                .when(F.endswith(f["kind"], F.lit("above")), state(s, next=F.lit("below"), over=v, outer=rest, frame=outer))
                .otherwise(
                    let(
                        F.struct((f["top_n"] * F.when(F.endswith(f["kind"], F.lit("below")), v["d"]).otherwise(v["n"]) % prime).alias("n"),
                                 (f["top_d"] * F.when(F.endswith(f["kind"], F.lit("below")), v["n"]).otherwise(v["d"]) % prime).alias("d")),
                        lambda q: state(s, next=F.lit("group"), outer=rest, frame=_operand(outer, q, prime)),
                    )
                )
            )

        fits = (F.size(s["outer"]) > 0) & f["has"] & (F.left(f["kind"], F.lit(1)) == opening) & (s["next"] == "group")
        return F.when(fits, let(_total(f, prime), done)).otherwise(failed(s))

    def powered(s: Column, t: Column) -> Column:
        f = s["frame"]
        exponent = F.translate(t, "^{}()+", "").cast("bigint")
        size = F.abs(exponent)
        raised = F.struct(_power(f["last_n"], size, prime, 14).alias("n"), _power(f["last_d"], size, prime, 14).alias("d"))
        put = let(
            raised,
            lambda r: state(
                s,
                frame=_changed(
                    f,
                    last_n=F.when(exponent < 0, r["d"]).otherwise(r["n"]),
                    last_d=F.when(exponent < 0, r["n"]).otherwise(r["d"]),
                ),
            ),
        )
        return F.when(f["has"], put).otherwise(failed(s))

    def signed(s: Column, t: Column) -> Column:
        f, minus = s["frame"], t == "-"
        summed = let(
            _total(f, prime),
            lambda v: state(
                s,
                frame=_changed(
                    f, sum_n=v["n"], sum_d=v["d"], minus=minus, term_n=_number(1), term_d=_number(1), by=F.lit(False),
                    has=F.lit(False),
                ),
            ),
        )
        return F.when(f["has"], summed).otherwise(state(s, frame=_changed(f, minus=f["minus"] != minus)))

    def timed(s: Column, t: Column) -> Column:
        f = s["frame"]
        above, below = _product(f, prime)
        put = state(s, frame=_changed(f, term_n=above, term_d=below, by=t == "/", has=F.lit(False)))
        return F.when(f["has"], put).otherwise(failed(s))

    def step(s: Column, t: Column) -> Column:
        f = s["frame"]
        symbol = F.struct(F.pmod(F.xxhash64(t, seed), prime).alias("n"), _number(1).alias("d"))
        opened = state(
            s,
            next=F.lit("group"),
            outer=F.concat(s["outer"], F.array(f)),
            frame=_frame(
                F.concat(t, s["next"]),
                F.when(s["next"] == "below", s["over"]["n"]).otherwise(1),
                F.when(s["next"] == "below", s["over"]["d"]).otherwise(1),
            ),
        )
        return (
            F.when(s["bad"], s)
            .when(t.isin("{", "(", "["), F.when((s["next"] == "group") | (t == "{"), opened).otherwise(failed(s)))
            .when(t.isin("}", ")", "]"), closed(s, t))
            .when(s["next"] != "group", failed(s))  # a fraction or a root without its bracket
            .when(t == "\\frac", state(s, next=F.lit("above")))
            .when(t == "\\sqrt", state(s, next=F.lit("sqrt")))
            .when(F.startswith(t, F.lit("^")) & (F.length(t) > 1), powered(s, t))
            .when(t.isin("+", "-"), signed(s, t))
            .when(t.isin("*", "/"), timed(s, t))
            .when(F.rlike(t, F.lit(r"^\.?\d")), state(s, frame=_operand(f, _decimal(t, prime), prime)))
            .when(F.rlike(t, F.lit(_SYMBOLS)), state(s, frame=_operand(f, symbol, prime)))
            .otherwise(failed(s))
        )

    def end(s: Column) -> Column:
        whole = ~s["bad"] & (F.size(s["outer"]) == 0) & s["frame"]["has"] & (s["next"] == "group")
        return F.when(whole, let(_total(s["frame"], prime), lambda v: F.when(v["d"] != 0, v)))

    return F.aggregate(of, start, step, end)


def identical(predicted: Column, gold: Column) -> Column:
    """Whether two lists of tokens have the same value wherever they have one: they differ at no point and
    agree at least at one."""
    points = F.array(*[F.struct(_number(p).alias("prime"), F.lit(i).alias("seed")) for i, p in enumerate(PRIMES)])
    start = F.struct(F.lit(0).alias("agreed"), F.lit(False).alias("differ"))

    def step(s: Column, point: Column) -> Column:
        def met(v: Column) -> Column:
            cross = v[0]["n"] * v[1]["d"] % point["prime"] == v[1]["n"] * v[0]["d"] % point["prime"]
            told = v[0].isNotNull() & v[1].isNotNull()
            return F.struct(
                (s["agreed"] + F.when(told & cross, 1).otherwise(0)).alias("agreed"),
                (told & ~F.coalesce(cross, F.lit(False))).alias("differ"),
            )

        values = F.transform(F.array(predicted, gold), lambda t: value(t, point["prime"], point["seed"]))
        return F.when(s["differ"] | (s["agreed"] >= AGREEING), s).otherwise(let(values, met))

    return F.aggregate(points, start, step, lambda s: ~s["differ"] & (s["agreed"] > 0))


def equivalent_algebra(predicted: ColumnOrName, gold: ColumnOrName) -> Column:
    """``equivalent``, and besides answers that are one and the same expression: sums, products, quotients,
    integer powers and square roots of numbers, letters and Greek symbols, in plain text or LaTeX.

    Answers that cannot be read (words, other functions, relations, powers with a variable exponent or one of
    more than four digits) are compared by ``equivalent`` alone. Equal text is equal also where it has no
    value. Answers that are written differently and have no value at any of six points (a root of a letter
    has one at every second point) are not equal, nor are nested roots and their resolved forms, as a
    root's sign is not known there. False where a side is null.
    """
    predicted, gold = as_column(predicted).cast("string"), as_column(gold).cast("string")
    read = F.transform(F.array(predicted, gold), tokens)
    both = let(read, lambda t: F.when(t[0].isNotNull() & t[1].isNotNull(), identical(t[0], t[1])))
    operators = F.lit(r"[-+*/^(\\0-9]")
    worth = F.rlike(predicted, operators) & F.rlike(gold, operators)
    return F.when(equivalent(predicted, gold), True).when(worth, F.coalesce(both, F.lit(False))).otherwise(False)
