"""Reading, normalising and comparing boxed answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkeval.functions.common import ColumnOrName, as_column, let

# The box command, the text stored where no answer was found, and the characters that
# Python's str.strip() removes.
BOX = "\\boxed"
NO_ANSWER = "[No boxed answer found]"
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip_ws(text: ColumnOrName) -> Column:
    """Remove all Unicode whitespace at both ends (``trim`` alone removes only U+0020)."""
    return F.btrim(as_column(text), F.lit(WHITESPACE))


def _braced(rest: Column) -> Column:
    """Body of the balanced group that ``rest`` is already inside of; null if it never closes.

    The text is cut at its closing braces. The group ends at the first closing brace where as many
    groups were closed as opened, so the walk has one step per closing brace, not one per character.
    """
    opens = F.length(rest) - F.length(F.replace(rest, F.lit("{"), F.lit("")))
    head = F.substring_index(rest, "}", 1)

    def step(state: Column, piece: Column) -> Column:
        seen = state["opened"] + F.length(piece) - F.length(F.replace(piece, F.lit("{"), F.lit("")))
        here = state["pieces"] + 1
        done = F.when(state["close"] > 0, state["close"]).when(seen + 1 == here, here).otherwise(0)
        return F.struct(seen.alias("opened"), here.alias("pieces"), done.alias("close"))

    def nested(text: Column) -> Column:
        pieces = F.split(text, r"\}")
        closed = F.slice(pieces, 1, F.size(pieces) - 1)
        zero = F.struct(F.lit(0).alias("opened"), F.lit(0).alias("pieces"), F.lit(0).alias("close"))
        close = F.aggregate(closed, zero, step)["close"]
        return let(
            close,
            lambda k: F.when(k > 0, F.array_join(F.slice(closed, 1, k), "}")),
        )

    return (
        F.when(~F.contains(rest, F.lit("}")), F.lit(None).cast("string"))
        .when((opens == 0) | ~F.contains(head, F.lit("{")), head)
        .otherwise(nested(rest))
    )


def boxed_first(text: ColumnOrName) -> Column:
    """Content of the first ``\\boxed{...}``; null if there is none or it never closes."""
    text = as_column(text)
    start = F.instr(text, BOX + "{")
    rest = F.substring(text, start + len(BOX) + 1, F.length(text))
    return F.when(start > 0, strip_ws(_braced(rest)))


def boxed_last(text: ColumnOrName) -> Column:
    """Content of the last box; null if the last ``\\boxed`` opens no group or never closes it."""
    text = as_column(text)
    tail = F.substring_index(text, BOX, -1)
    rest = F.substring(tail, F.lit(2), F.length(tail))
    return F.when(
        F.contains(text, F.lit(BOX)) & F.startswith(tail, F.lit("{")), strip_ws(_braced(rest))
    )


def normalize_answer(answer: ColumnOrName) -> Column:
    return F.lower(strip_ws(answer))


def exact_reward(predicted: ColumnOrName, gold: ColumnOrName) -> Column:
    """1.0 where the normalised prediction equals the normalised gold answer, else 0.0."""
    same = normalize_answer(predicted) == normalize_answer(gold)
    return F.when(F.coalesce(same, F.lit(False)), F.lit(1.0)).otherwise(F.lit(0.0))


def fallback_equal(predicted: ColumnOrName, gold: ColumnOrName) -> Column:
    """String comparison without dollar signs, spaces and case; false where a side is null."""

    def plain(value: ColumnOrName) -> Column:
        return strip_ws(F.lower(F.translate(as_column(value), "$ ", "")))

    return F.coalesce(plain(predicted) == plain(gold), F.lit(False))


def _plain_latex(text: Column) -> Column:
    """Without sizing, spacing, units and text commands; fractions as a/b, powers of ten as ×10^k."""
    text = F.regexp_replace(text, r"\\(?:left|right)(?![a-zA-Z])|\\[,;:!]", "")
    text = F.regexp_replace(text, r"\\[dt]frac(?![a-zA-Z])", r"\\frac")
    text = F.regexp_replace(text, r"\\frac(\d)(?=[\d{])", r"\\frac{$1}")
    text = F.regexp_replace(text, r"(\\frac\{[^{}]*\})(\d)(?!\d)", "$1{$2}")
    text = F.regexp_replace(text, r"^\\(?:text|textbf|mathrm|mathbf)\{([^{}]*)\}$", "$1")
    text = F.regexp_replace(text, r"(?<=[\d}])\\(?:text|textbf|mathrm|mathbf)\{[^{}]*\}$", "")
    text = F.regexp_replace(text, r"(?<=\d)\^(?:\\circ|\{\\circ\})$", "")
    text = F.regexp_replace(text, r"(?<=[\d.])(?:\\times|\\cdot)10\^(?:\{([+-]?\d+)\}|(\d))(?!\d)", "×10^$1$2")
    number = r"[+-]?(?=\.?\d)\d*\.?\d*"
    return F.regexp_replace(text, rf"([+-]?)\\frac\{{({number})\}}\{{({number})\}}", "$1$2/$3")


def canonical_answer(answer: ColumnOrName) -> Column:
    """Drop what does not change the value: dollars, spaces, LaTeX spacing, sizing and text wrappers,
    units behind a number, outer braces, a name before an equals sign, thousands separators."""
    grouped = F.lit(r"^[+-]?\d{1,3}(?:,\d{3})+(?:\.\d+)?(?:\\?%)?$")

    def plain(text: Column) -> Column:
        latex = F.when(F.contains(text, F.lit("\\")), _plain_latex(text)).otherwise(text)
        shorn = F.regexp_replace(F.regexp_replace(latex, r"^[a-zA-Z]=(?=.)", ""), r"^\{([^{}]+)\}$", "$1")
        return F.when(F.rlike(text, F.lit(r"[\\={]")), shorn).otherwise(text)

    def ungrouped(text: Column) -> Column:
        has_groups = F.contains(text, F.lit(",")) & F.rlike(text, grouped)
        return F.when(has_groups, F.translate(text, ",", "")).otherwise(text)

    bare = as_column(answer)
    for written, meant in (("\\ ", ""), ("\\$", ""), ("{,}", ",")):
        bare = F.replace(bare, F.lit(written), F.lit(meant))
    return let(let(F.translate(bare, "$" + WHITESPACE, ""), plain), ungrouped)


# Fixed value: primes below 2^31. Two products with equal remainders by all of them are equal as far as
# they have 110 digits; longer ones differ with a chance below 1e-110 of being taken for equal.
PRIMES = (
    2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549,
    2147483543, 2147483497, 2147483489, 2147483477, 2147483423, 2147483399,
)
_NUMBER = r"[+-]{0,2}(?=\.?\d)\d*\.?\d*(?:×10\^[+-]?\d{1,4}(?!\d))?"
_VALUE = rf"^{_NUMBER}(?:\\?%|/[+-]?(?=[\d.]*[1-9])\d*\.?\d*)?$"
_SHORT = 16  # digits a side whose cross product stays within DECIMAL(38)


def rational(canonical: ColumnOrName) -> Column:
    """``struct<negative, n, d>``, the digits of a value n / d, for integers, decimals, percentages, a/b
    and powers of ten; else null."""
    text = as_column(canonical)

    def scaled(number: Column) -> Column:
        """Digits and the power of ten that they are to be multiplied with."""
        mantissa, power = F.substring_index(number, "×", 1), F.regexp_extract(number, r"\^([+-]?\d+)$", 1)
        plain = F.translate(mantissa, "+-", "")
        decimals = F.when(
            F.contains(plain, F.lit(".")), F.length(F.substring_index(plain, ".", -1))
        ).otherwise(0)
        shift = F.coalesce(power.try_cast("int"), F.lit(0)) - decimals
        return F.struct(F.translate(plain, ".", "").alias("digits"), shift.alias("shift"))

    def of(t: Column) -> Column:
        percent = F.endswith(t, F.lit("%"))
        whole = F.translate(t, "\\%", "")
        bases = F.replace(whole, F.lit("^-"), F.lit("^"))
        minus = F.length(bases) - F.length(F.replace(bases, F.lit("-"), F.lit("")))
        sides = F.struct(
            scaled(F.substring_index(whole, "/", 1)).alias("top"),
            F.when(F.contains(whole, F.lit("/")), scaled(F.substring_index(whole, "/", -1)))
            .otherwise(F.struct(F.lit("1").alias("digits"), F.lit(0).alias("shift")))
            .alias("bottom"),
        )

        def reduced(v: Column) -> Column:
            shift = v["top"]["shift"] - v["bottom"]["shift"] - F.when(percent, 2).otherwise(0)

            def side(digits: Column, zeros: Column) -> Column:
                written = F.concat(digits, F.repeat(F.lit("0"), F.greatest(zeros, F.lit(0))))
                return F.regexp_replace(written, "^0+", "")

            return F.struct(
                (minus % 2 == 1).alias("negative"),
                side(v["top"]["digits"], shift).alias("n"),
                side(v["bottom"]["digits"], -shift).alias("d"),
            )

        return let(sides, reduced)

    return let(text, lambda t: F.when(F.rlike(t, F.lit(_VALUE)), of(t)))


def _remainder(digits: Column, prime: Column) -> Column:
    length = F.length(digits)
    padded = F.lpad(digits, F.ceil(length / 9).cast("int") * 9, "0")
    parts = F.transform(
        F.regexp_extract_all(padded, F.lit(r"\d{9}"), F.lit(0)), lambda x: x.cast("bigint")
    )
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda r, x: (r * 1_000_000_000 + x) % prime)


def _same_value(a: Column, b: Column) -> Column:
    """Whether two rationals are equal: by decimals where they are short, else by remainders."""
    sides = (a["n"], a["d"], b["n"], b["d"])
    short = F.greatest(*[F.length(x) for x in sides]) <= _SHORT

    def small(digits: Column) -> Column:
        return F.concat(F.lit("0"), digits).try_cast("decimal(18,0)")

    quick = small(a["n"]) * small(b["d"]) == small(b["n"]) * small(a["d"])
    primes = F.array(*[F.lit(p).cast("bigint") for p in PRIMES])
    long = F.forall(
        primes,
        lambda p: (_remainder(a["n"], p) * _remainder(b["d"], p)) % p
        == (_remainder(b["n"], p) * _remainder(a["d"], p)) % p,
    )
    zero = (a["n"] == "") & (b["n"] == "")
    signed = (a["negative"] == b["negative"]) & (a["n"] != "") & (b["n"] != "")
    return F.coalesce(zero | (signed & F.when(short, quick).otherwise(long)), F.lit(False))


def equivalent(predicted: ColumnOrName, gold: ColumnOrName) -> Column:
    """True where both answers have the same canonical text or the same rational value.

    Covers integers, decimals, percentages, fractions and powers of ten of any length, and tuples of
    them in equal brackets; symbolic algebra is not attempted. False where a side is null.
    """
    predicted, gold = as_column(predicted).cast("string"), as_column(gold).cast("string")

    def same(x: Column, y: Column) -> Column:
        values = F.array(rational(x), rational(y))
        return let(values, lambda v: _same_value(v[0], v[1]))

    def same_tuple(t: Column) -> Column:
        inner = F.transform(t, lambda x: F.split(F.substring(x, F.lit(2), F.length(x) - 2), ","))
        pairs = F.arrays_zip(inner[0].alias("x"), inner[1].alias("y"))
        equal = F.forall(pairs, lambda p: F.coalesce((p["x"] == p["y"]) | same(p["x"], p["y"]), F.lit(False)))
        ends = (F.left(t[0], F.lit(1)) == F.left(t[1], F.lit(1))) & (F.right(t[0], F.lit(1)) == F.right(t[1], F.lit(1)))
        return ends & (F.size(inner[0]) == F.size(inner[1])) & equal

    def compare(t: Column) -> Column:
        numeric = F.forall(t, lambda x: F.rlike(x, F.lit("[0-9]")))
        tuples = F.forall(t, lambda x: F.rlike(x, F.lit(r"^[(\[][^()\[\]]*,[^()\[\]]*[)\]]$")))
        return (
            F.when(t[0] == t[1], True)
            .when(numeric & tuples, same_tuple(t))
            .when(numeric, same(t[0], t[1]))
            .otherwise(False)
        )

    letters = F.lit("^[A-Za-z]+$")  # letters alone are their own canonical form, and no number
    return (
        F.when(predicted.isNull() | gold.isNull(), False)
        .when(predicted == gold, True)
        .when(F.rlike(predicted, letters) & F.rlike(gold, letters), False)
        .otherwise(let(F.transform(F.array(predicted, gold), canonical_answer), compare))
    )


def stored_prediction(predicted: ColumnOrName) -> Column:
    """The prediction kept in reports: null and the empty box both become the sentinel."""
    value = as_column(predicted)
    return F.when(value.isNull() | (value == ""), F.lit(NO_ANSWER)).otherwise(value)
