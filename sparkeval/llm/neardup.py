"""Near duplicates by an inverted join over the coordinates of MinHash signatures.

1. Documents with one and the same set of shingles are one class; only classes go on, so thousands of
   copies cost one row. A class has a signature of ``COORDINATES`` values.
2. Each class is posted under each pair of coordinate and value. Two sets that are similar enough agree
   in at least ``MATCHES`` coordinates (the chance of fewer is below 1e-9 at a similarity of 0.85 and
   below 3e-8 at 0.8). So
   values that nobody shares are skipped, then classes with too few shared values, and of a class that
   is left only the rarest shared values count, as many as a pair with enough collisions cannot miss
   (prefix). Long lists of frequent values thus drop out unless the classes in them agree elsewhere.
3. Lists are joined in rounds. First every class meets the pivots of its longest list and of its two
   shortest, which connects large groups by stars instead of by all pairs. Then lists whose classes are all
   connected are skipped. In the others, classes with one home (the pivot of most of their lists: near copies
   of one text) are linked by what sets them apart from its middle (``deltas``), and classes of different
   homes and components meet as far as the shingles that a class has alone leave room for a link.
4. A pair that agrees in enough coordinates is confirmed on the full sets, and the components of the
   confirmed links are found by star contraction.

No list, component or set is gathered in one task or on the driver: lists are joined, pivots and roots
are aggregates. Tables between the steps are written to shared storage.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import blake2b

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkeval.llm import deltas
from sparkeval.llm.common import SHINGLE_WORDS, append, fresh, stored, struct
from sparkeval.llm.hashing import window_hashes, word_hashes
from sparkeval.plans.session import materialize

COORDINATES = 32
MATCHES = 12
PERCENT = 85  # of the union that two linked sets share at least, unless a caller gives another share
SHORT_LISTS = 2
SIGNATURE = struct(n="bigint", node="binary", signature="array<bigint>")


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted; none without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(window_hashes(word_hashes(words), min(SHINGLE_WORDS, len(words))))


def node_of(hashes: np.ndarray) -> bytes:
    return blake2b(hashes.tobytes(), digest_size=16).digest()


@lru_cache(maxsize=1)
def _orders() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    turns, factors = rng.integers(0, 1 << 63, (2, COORDINATES), dtype=np.uint64)
    return turns, factors * np.uint64(2) + np.uint64(1)


def signature(hashes: np.ndarray) -> list[int]:
    """The least value of each of ``COORDINATES`` orders of the hashes."""
    return [int(((hashes ^ t) * f).min() >> np.uint64(1)) for t, f in zip(*_orders())]


def _signed(text: str | None) -> tuple:
    hashes = shingles(text)
    if not len(hashes):
        return 0, None, None
    return len(hashes), node_of(hashes), signature(hashes)


def signatures(df: DataFrame, text: str = "text", into: str = "minhash") -> DataFrame:
    """Add ``into``: n (distinct shingles), node (a digest of the set) and signature; null without words."""
    return append(df, into, SIGNATURE, lambda c: [_signed(t) for t in c[text]], [text])


def postings(classes: DataFrame, matches: int = MATCHES) -> DataFrame:
    """(key, node, prefix, rarest, longest, weight): the shared values of the classes that have enough.

    ``prefix`` marks those that a pair with ``matches`` collisions cannot miss; ``rarest`` and ``longest``
    number them from either end, from 1, and ``weight`` sums the lengths of all lists of the class.
    """
    posted = classes.select("node", F.posexplode("signature").alias("at", "value")).select(
        "node", F.xxhash64("at", "value").alias("key")
    )
    lists = posted.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    shared = posted.join(lists, "key")
    own = Window.partitionBy("node")  # COORDINATES rows at most
    ranked = shared.select(
        "*",
        F.count("*").over(own).alias("shared"),
        F.sum("size").over(own).alias("weight"),
        F.row_number().over(own.orderBy("size", "key")).alias("rarest"),
    )
    return ranked.filter(F.col("shared") >= matches).select(
        "key",
        "node",
        (F.col("rarest") <= F.col("shared") - matches + 1).alias("prefix"),
        "rarest",
        (F.col("shared") - F.col("rarest") + 1).alias("longest"),
        "weight",
    )


def pivot_pairs(lists: DataFrame, own: DataFrame) -> DataFrame:
    """(a, b): each class with the pivots of its longest list and of its shortest ones.

    The pivot is the class with the fewest shingles of its own, then the greatest weight: the middle of
    a group of near copies. Of equal ones it is that with the least hash of class and key.
    """
    hashed = F.xxhash64("node", "key").alias("h")
    central = F.struct("own", (-F.col("weight")).alias("w"), hashed, F.col("node").alias("node"))
    pivots = lists.join(own, "node").groupBy("key").agg(F.min(central)["node"].alias("pivot"))
    ends = (F.col("longest") == 1) | (F.col("rarest") <= SHORT_LISTS)
    met = lists.filter(ends).join(pivots, "key")
    return _ordered(met.filter("node <> pivot"), F.col("node"), F.col("pivot"))


def _ordered(pairs: DataFrame, a: Column, b: Column) -> DataFrame:
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def own_shingles(sets: DataFrame) -> DataFrame:
    """(node, own): how many shingles of each set no other one has."""

    halves = sets.select("node", F.xxhash64("node").alias("high"), F.xxhash64("node", F.lit(1)).alias("low"))
    held = sets.select(F.explode("hashes").alias("shingle"), F.xxhash64("node").alias("high"), F.xxhash64("node", F.lit(1)).alias("low"))
    counts = held.groupBy("shingle").agg(
        F.count("*").alias("holders"), F.min("high").alias("high"), F.min("low").alias("low")
    )
    alone = counts.filter("holders = 1").groupBy("high", "low").agg(F.count("*").alias("own"))
    return halves.join(alone, ["high", "low"], "left").select("node", F.coalesce("own", F.lit(0)).alias("own"))


def mixed_members(lists: DataFrame, labels: DataFrame, able: DataFrame) -> DataFrame:
    """(key, node, label, main, n, most): classes of ``able`` in lists with several components; ``main`` is
    the component with the most classes there."""
    known = lists.filter("prefix").join(able, "node").join(labels, "node", "left").select(
        "key", "node", F.coalesce("label", "node").alias("label"), "n", "most"
    )
    known = stored(known, "labelled")
    sizes = known.groupBy("key", "label").agg(F.count("*").alias("size"))
    mixed_lists = sizes.groupBy("key").agg(
        F.max(F.struct("size", "label"))["label"].alias("main"), F.count("*").alias("labels")
    ).filter("labels > 1")
    return known.join(mixed_lists.select("key", "main"), "key")


def able_classes(classes: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """(node, n, most): classes that shingles of their own do not keep from every link; ``most`` of their
    ``n`` shingles can be shared."""
    most = classes.select("node", "n").join(own, "node").select("node", "n", (F.col("n") - F.col("own")).alias("most"))
    return most.filter(100 * F.col("most") >= percent * F.col("n"))


def crossing_pairs(
    members: DataFrame, homes: DataFrame, classes: DataFrame, matches: int = MATCHES, percent: int = PERCENT
) -> DataFrame:
    """(a, b): classes of different components and homes that share a list, may be similar enough and agree
    in enough coordinates.

    Of a list, the component with the most classes stays on one side: its classes meet the others, and the
    others meet each other. Shingles that a class has alone bound what it can share: only pairs within the
    bound meet, once, in the first of their common lists.
    """
    keys = members.groupBy("node").agg(F.collect_list("key").alias("keys"))
    more = classes.select("node", "signature").join(keys, "node").join(homes, "node")
    members = stored(members.join(more, "node"), "able")
    columns = ("node", "label", "home", "n", "most", "keys", "signature")
    left = members.filter("label <> main").select("key", *[F.col(c).alias(f"{c}_a") for c in columns])
    right = members.select("key", "main", *[F.col(c).alias(f"{c}_b") for c in columns])
    apart = (F.col("label_a") != F.col("label_b")) & (F.col("home_a") != F.col("home_b")) & (
        (F.col("label_b") == F.col("main")) | (F.col("node_a") < F.col("node_b"))
    )
    most = F.least("most_a", "most_b")
    within = 100 * most >= percent * (F.col("n_a") + F.col("n_b") - most)
    first = F.array_min(F.array_intersect("keys_a", "keys_b")) == left["key"]
    agreeing = _agreeing("signature_a", "signature_b", matches)  # last, as it costs most
    met = left.join(right, (left["key"] == right["key"]) & apart & within & first & agreeing)
    return _ordered(met, F.col("node_a"), F.col("node_b"))


def _agreeing(a: str, b: str, matches: int) -> Column:
    """Whether two signatures agree in enough coordinates."""
    equal = F.zip_with(a, b, lambda x, y: x == y)
    return F.size(F.array_remove(equal, False)) >= matches


def agreeing_pairs(
    pairs: DataFrame, classes: DataFrame, matches: int = MATCHES, percent: int = PERCENT
) -> DataFrame:
    """The pairs whose signatures agree in enough coordinates and whose sizes allow a link."""
    own = classes.select("node", "n", "signature")
    a, b = (
        own.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("signature").alias(f"s_{s}"))
        for s in "ab"
    )
    sized = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return pairs.join(a, "a").join(b, "b").filter(sized & _agreeing("s_a", "s_b", matches)).select("a", "b")


def sets_of(docs: DataFrame, lists: DataFrame, classes: DataFrame, text: str) -> DataFrame:
    """(node, hashes): the full sets of the classes in ``lists``, from one document of each."""
    wanted = lists.select("node").distinct().join(classes, "node").select(
        F.col("node").alias("_node"), F.col("member.id").alias("_id"), F.col("member.text").alias("_text")
    )
    rows = docs.select(F.col("_key"), F.col(text).alias("_full"), F.xxhash64(text).alias("_hash"))
    found = rows.join(wanted, rows["_key"].eqNullSafe(wanted["_id"]) & (rows["_hash"] == wanted["_text"]))

    def hashes(columns: dict[str, list]) -> list[tuple]:
        sets = [shingles(t) for t in columns["_full"]]
        return [(s.view(np.int64) if node_of(s) == n else None,) for s, n in zip(sets, columns["_node"])]

    done = append(found.select("_node", "_full"), "_set", struct(h="array<bigint>"), hashes, ["_full", "_node"])
    kept = done.filter("_set.h is not null").select(F.col("_node").alias("node"), F.col("_set.h").alias("hashes"))
    return kept.groupBy("node").agg(F.first("hashes").alias("hashes"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs that share at least ``percent`` of their union."""
    a, b = (sets.select(F.col("node").alias(s), F.col("hashes").alias(f"h_{s}")) for s in "ab")
    both = F.size(F.array_intersect("h_a", "h_b")).cast("long")
    linked = (100 + percent) * both >= percent * (F.size("h_a").cast("long") + F.size("h_b"))
    return pairs.join(b, "b").join(a, "a").filter(linked).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node of each component, by alternating star contraction.

    A round joins each node's neighbours to the least of them; it ends when every node has one edge, to
    the least of its component. A node with very many neighbours is a skewed join key, never a collected
    list.
    """
    edges = links.select("a", "b")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b")  # at most a row per edge; the second half drops repeats
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        roots = down.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            down.join(roots, "a")
            .select(
                F.explode(
                    F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))
                ).alias("e")
            )
            .select("e.a", "e.b")
            .filter("a <> b")
            .distinct()
        )
        edges = stored(small, "edges")
        up = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        ends = up.union(edges.select(F.col("b").alias("node"), F.lit(0), F.lit(1)))
        tangled = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if tangled.filter("up > 1 or (up = 1 and down = 1)").isEmpty():
            break
    labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label): the components of ``labels`` joined by ``links`` (a, b). Only components that a link
    joins to others are contracted; a node without a label is one of its own."""
    a, b = (labels.select(F.col("node").alias(s), F.col("label").alias(f"label_{s}")) for s in "ab")
    known = links.join(a, "a", "left").join(b, "b", "left")
    across = _ordered(known, F.coalesce("label_a", "a"), F.coalesce("label_b", "b")).filter("a <> b")
    across = stored(across, "across")
    if across.isEmpty():
        return labels
    roots = stored(components(across), "roots")
    moved = labels.join(roots.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left")
    alone = roots.join(labels, "node", "left_anti").select("node", "label")
    return stored(moved.select("node", F.coalesce("root", "label").alias("label")).union(alone), "labels")


def _of_mixed_homes(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, home, n) of the homes whose classes are in several components."""
    known = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = known.groupBy("home").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("home")
    return known.select("node", "home", "n").join(several, "home")


def _members(df: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """(_key, _hash, n, node, label, component_id) per document; label is one per component."""
    docs = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    hashed = signatures(docs.select("*", F.xxhash64("_text").alias("_hash")), "_text", "_s")
    signed = materialize(hashed.select("_key", "_hash", "_s.*"), "signatures")
    member = F.struct(F.col("_key").alias("id"), F.col("_hash").alias("text"))
    classes = signed.filter("node is not null").groupBy("node").agg(
        F.min("_key").alias("least"),
        F.min(member).alias("member"),
        F.first("n").alias("n"),
        F.first("signature").alias("signature"),
    )
    classes = stored(classes, "classes")
    lists = stored(postings(classes), "postings")
    sets = stored(sets_of(docs, lists, classes, "_text"), "sets")
    own = stored(own_shingles(sets), "own")
    links = stored(confirmed(agreeing_pairs(pivot_pairs(lists, own), classes, percent=percent), sets, percent), "links")
    labels = stored(components(links), "labels")
    able = stored(able_classes(classes, own, percent), "able")
    members = stored(mixed_members(lists, labels, able), "members")
    if not members.isEmpty():
        nodes = members.select("node", "n").distinct()
        homes = stored(deltas.homes(lists, own, nodes.select("node")), "homes")
        at_home = _of_mixed_homes(nodes.join(homes, "node"), labels)
        confirm = lambda pairs: confirmed(pairs, sets, percent)
        labels, pairs = deltas.linked(at_home, sets, labels, percent, confirm, joined)
        members = stored(mixed_members(lists, labels, able), "members")
        crossing = crossing_pairs(members, homes, classes, percent=percent)
        labels = joined(labels, confirm(stored(pairs.union(crossing), "pairs")))
    least = labels.join(classes.select("node", "least"), "node")
    roots = least.groupBy("label").agg(F.min("least").alias("root"))
    ends = classes.select("node", "least").join(labels, "node", "left").join(roots, "label", "left")
    ends = ends.select("node", F.coalesce("label", "node").alias("label"), F.coalesce("root", "least").alias("root"))
    done = signed.select("_key", "_hash", "n", "node").join(ends, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("_key")).otherwise(F.col("root"))
    return done.select("_key", "_hash", "n", "node", "label", component.alias("component_id"))


def groups(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id, kept) per document.

    Words are separated by \\x20 and \\x09-\\x0D, A-Z are lowered; the set of a document holds its distinct
    shingles of five words, or all its words as one. Documents are linked if they share ``percent`` of
    the union of their sets; ``component_id`` is the smallest key that links lead to. Null and empty texts
    have an empty set and no link. Rows without a key take part and get the smallest key of their group,
    null if it has none; rows that repeat a key are documents of their own. ``kept`` says that the key is
    the component's. An empty table gives an empty table; other columns are not read.
    """
    return _members(df, key, text, percent).select(
        F.col("_key").alias(key),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("_key").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def first_of_each(
    df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT
) -> DataFrame:
    """One document of each group of near copies, the one with the smallest key, with all its columns.
    Near copies are those that ``groups`` links.

    Rows without a key come after all others. Of rows that share key and text one stays. Documents
    without words all stay.
    """
    members = materialize(_members(df, key, text, percent), "members")
    order = F.struct(F.col("_key").isNull().alias("no"), "_key", "_hash")
    first = members.filter("label is not null").groupBy("label").agg(F.min(order).alias("w"))
    wordless = members.filter("label is null").select("_key", "_hash", F.lit(None).cast("binary").alias("label"))
    names = {c: fresh(df, "_of" + c) for c in ("_key", "_hash", "label")}
    winners = first.select("w._key", "w._hash", "label").union(wordless.distinct()).withColumnsRenamed(names)
    own, of_key, of_hash, label = fresh(df, "_own"), *names.values()
    stayed = df.withColumn(own, F.xxhash64(text)).join(
        winners, F.col(key).eqNullSafe(F.col(of_key)) & (F.col(own) == F.col(of_hash))
    )
    again = members.filter("label is not null").groupBy("_key", "_hash").agg(F.count("*").alias("n")).filter("n > 1")
    if again.isEmpty():
        return stayed.select(*df.columns)
    one = stayed.filter(F.col(label).isNotNull()).groupBy(label).agg(
        F.min_by(F.struct(*df.columns), F.xxhash64(*df.columns)).alias(own)
    )
    return one.select(f"{own}.*").union(stayed.filter(F.col(label).isNull()).select(*df.columns))
