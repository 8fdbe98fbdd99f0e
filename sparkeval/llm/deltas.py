"""Links among very many near copies of one text, found by how they differ from their common middle.

Members of a group of near copies share nearly everything, so lists of what they share pair all with all.
What sets them apart is small: the symmetric difference D of a set and a centre, here the pivot of most of
a set's lists, with every element flipped that more than half of the group differ in. For two sets x and y
of one group, whatever the centre, |x - y| + |y - x| = |Dx| + |Dy| - 2 |Dx & Dy|. With the score
S = (100 + p) |D| - (100 - p) |x| they share p per cent of their union exactly if

    2 (100 + p) |Dx & Dy| >= Sx + Sy.

1. If Sx + Sy <= 0 nothing need be shared. Both are then linked to the member with the least score as well,
   so one star joins all such pairs.
2. Other links share elements of their differences. These are ordered, rare ones first; the first that both
   have leaves enough behind it in either (prefix and position filter), so only such places are posted.
   Lists within one component are skipped. First each class meets one representative of the list's largest
   component, then, in lists that still have several components, classes of different ones meet.

Nothing here gathers a group: differences are rows of bounded size (two texts), lists are joined.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkeval.llm.common import stored

ROUNDS = 1  # of meetings with one representative, while they link any; what is left meets in full
Linker = Callable[[DataFrame], DataFrame]


def homes(lists: DataFrame, own: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, home): the pivot of most lists of a class. The pivot of a list is the class with the fewest
    shingles of its own, then the greatest weight: the middle of a group of near copies."""
    central = F.struct("own", (-F.col("weight")).alias("w"), "node")
    pivots = lists.join(own, "node").groupBy("key").agg(F.min(central)["node"].alias("pivot"))
    counted = lists.select("key", "node").join(nodes, "node").join(pivots, "key").groupBy("node", "pivot").agg(F.count("*").alias("n"))
    return counted.groupBy("node").agg(F.max(F.struct("n", "pivot"))["pivot"].alias("home"))


def _exclusive(a: str, b: Column) -> Column:
    """The symmetric difference of two arrays without repeats."""
    return F.concat(F.array_except(a, b), F.array_except(b, a))


def _elements(deltas: DataFrame, *keep: str) -> DataFrame:
    """(group, element, kept columns): a row per element of each difference."""
    return deltas.select("group", F.explode("delta").alias("element"), *keep)


def centred(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, group, n, delta, d, score) of the classes (node, home, n), by the middle of each group."""
    own = sets.select("node", F.col("hashes").alias("own"))
    centres = sets.select(F.col("node").alias("home"), F.col("hashes").alias("centre"))
    joined = members.join(own, "node").join(centres, "home")
    raw = joined.select("node", F.xxhash64("home").alias("group"), "n", _exclusive("own", F.col("centre")).alias("delta"))
    raw = stored(raw, "deltas")
    held = _elements(raw).groupBy("group", "element").agg(F.count("*").alias("held"))
    sizes = raw.groupBy("group").agg(F.count("*").alias("size"))
    # more than half of a group hold each of these, so they are at most twice the mean size of a difference
    flipped = held.join(sizes, "group").filter("2 * held > size").groupBy("group").agg(F.collect_list("element").alias("flip"))

    flip = F.coalesce("flip", F.array().cast("array<bigint>"))
    moved = raw.join(flipped, "group", "left").select("node", "group", "n", _exclusive("delta", flip).alias("delta"))
    moved = moved.withColumn("d", F.size("delta").cast("long"))
    return moved.withColumn("score", (100 + percent) * F.col("d") - (100 - percent) * F.col("n"))


def star(deltas: DataFrame) -> DataFrame:
    """(a, b): the member with the least score of each group, with all that surely link to it."""
    middle = deltas.groupBy("group").agg(F.min(F.struct("score", "node")).alias("least"))
    middle = middle.select("group", F.col("least.score").alias("least"), F.col("least.node").alias("middle"))
    sure = deltas.join(middle, "group").filter("score + least <= 0 and node <> middle")
    return sure.select(F.least("node", "middle").alias("a"), F.greatest("node", "middle").alias("b"))


def places(deltas: DataFrame, percent: int) -> DataFrame:
    """(group, element, node, score, rest): the places of each difference at which a link can begin.

    ``rest`` counts the elements from there on, rare ones first; elements that one class has alone come
    before all others and are not posted.
    """
    elements = _elements(deltas, "node", "score", "d")
    sizes = elements.groupBy("group", "element").agg(F.count("*").alias("size")).filter("size > 1")
    shared = elements.join(sizes, ["group", "element"])
    own = Window.partitionBy("node")  # a row per shingle of two texts at most
    ranked = shared.select(
        "*", (F.count("*").over(own) - F.row_number().over(own.orderBy("size", "element")) + 1).alias("rest")
    )
    least = deltas.groupBy("group").agg(F.min("score").alias("least"))
    enough = F.expr(f"{2 * (100 + percent)} * rest >= score + least")
    return ranked.join(least, "group").filter(enough).select("group", "element", "node", "score", "rest")


def _meet(percent: int, a: str, b: str) -> Column:
    rest = F.least(f"rest_{a}", f"rest_{b}")
    return 2 * (100 + percent) * rest >= F.col(f"score_{a}") + F.col(f"score_{b}")


def _several(posted: DataFrame, labels: DataFrame) -> DataFrame:
    """The places with their labels, in lists with several components, and each list's largest one."""
    known = posted.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = known.groupBy("group", "element", "label").agg(F.count("*").alias("size"))
    mixed = sizes.groupBy("group", "element").agg(F.max(F.struct("size", "label"))["label"].alias("main"), F.count("*").alias("labels"))
    return known.join(mixed.filter("labels > 1").select("group", "element", "main"), ["group", "element"])


def _side(known: DataFrame, s: str, *more: str) -> DataFrame:
    return known.select("group", "element", *more, *[F.col(c).alias(f"{c}_{s}") for c in ("node", "score", "rest", "label")])


def _ends() -> list[Column]:
    return [F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")]


def linked(
    members: DataFrame, sets: DataFrame, labels: DataFrame, percent: int, confirm: Linker, joined: Callable[[DataFrame, DataFrame], DataFrame]
) -> tuple[DataFrame, DataFrame]:
    """``labels``, joined by links between members (node, home, n) of one home, and the pairs (a, b) with all
    others that can still join components of them.

    ``confirm`` keeps the pairs (a, b) that are links; ``joined`` adds links to labels.
    """
    deltas = stored(centred(members, sets, percent), "centred")
    labels = joined(labels, star(deltas))
    posted = stored(places(deltas, percent), "places")
    for turn in range(ROUNDS):
        known = stored(_several(posted, labels), "several")
        order = F.struct("score", "node") if turn == 0 else F.struct(F.xxhash64("node", "element", F.lit(turn)), "score", "node")
        fields = F.struct(*[F.col(c).alias(f"{c}_b") for c in ("node", "score", "rest", "label")])
        chosen = known.filter("label = main").groupBy("group", "element").agg(F.min_by(fields, order).alias("b"))
        others = _side(known.filter("label <> main"), "a")
        met = others.join(chosen.select("group", "element", "b.*"), ["group", "element"]).filter(_meet(percent, "a", "b"))
        before, labels = labels, joined(labels, confirm(met.select(*_ends()).distinct()))
        if labels is before:
            break
    known = stored(_several(posted, labels), "several")
    left, right = _side(known.filter("label <> main"), "a"), _side(known, "b", "main")
    apart = (F.col("label_a") != F.col("label_b")) & ((F.col("label_b") == F.col("main")) | (F.col("node_a") < F.col("node_b")))
    same = (left["group"] == right["group"]) & (left["element"] == right["element"])
    return labels, left.join(right, same & apart & _meet(percent, "a", "b")).select(*_ends()).distinct()
