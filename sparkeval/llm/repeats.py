"""Passages that repeat across documents, by seed and extension.

A window is ``WINDOW`` consecutive words. Its anchor is the least hash among its runs of ``ANCHOR`` words
(winnowing), so equal windows have equal anchors at equal places, and a document has about one anchor in
twenty words. The windows that share one anchor are neighbours: a stretch.

1. Stretches meet at their anchors. A stretch whose whole extent also stands in an earlier document is
   removed at once: one key extends the match both ways as far as the anchor's windows reach. Of equal
   stretches only the earliest document's goes on.
2. If an anchor has several different stretches, the match with each other one ends somewhere inside.
   There every window of the remaining stretches gets its key, and the earliest document of each key
   decides.
3. What is removed in a document is the union of its matched windows: its maximal repeats.

All joins are on hashes of words, with aggregates of the smallest document, so a passage that a third of
all documents share costs a row per document and never a pair of them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkeval.llm.common import append, fresh, struct
from sparkeval.llm.hashing import PIECE, run_hashes, window_hashes, word_hashes
from sparkeval.plans.session import materialize

WINDOW = 50
ANCHOR = 10
STRETCHES = struct(anchor="array<bigint>", extent="array<bigint>", first="array<bigint>", last="array<bigint>")
KEYS = struct(anchor="array<bigint>", window="array<bigint>", start="array<bigint>")
KEPT = struct(
    n_words="bigint", n_removed="bigint", first="array<bigint>", past="array<bigint>", text="string"
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def anchors(grams: np.ndarray, window: int = WINDOW, size: int = ANCHOR) -> np.ndarray:
    """The place of each window's anchor: its least gram, the first of equal ones."""
    width = window - size + 1
    n = len(grams) - width + 1
    places = [
        np.lib.stride_tricks.sliding_window_view(grams[i : min(i + PIECE, n) + width - 1], width).argmin(axis=1)
        for i in range(0, n, PIECE)
    ]
    return np.concatenate(places) + np.arange(n)


def stretches(text: str | None) -> tuple:
    """Anchor hashes, hashes of the whole extents, and the first and last window of each stretch."""
    words = words_of(text)
    if len(words) < WINDOW:
        return (), (), (), ()
    hashes = word_hashes(words)
    grams = window_hashes(hashes, ANCHOR)
    places = anchors(grams)
    first = np.flatnonzero(np.diff(places, prepend=-1))
    last = np.append(first[1:], len(places)) - 1
    extents = run_hashes(hashes, first, last + WINDOW)
    return grams[places[first]].view(np.int64), extents.view(np.int64), first, last


def window_keys(text: str | None, wanted: list[dict]) -> tuple:
    """Anchor and hash of each window in the wanted stretches, and its place."""
    hashes = word_hashes(words_of(text))
    grams = window_hashes(hashes, ANCHOR)
    places = anchors(grams)
    starts = np.unique(np.concatenate([np.arange(w["first"], w["last"] + 1) for w in wanted]))
    windows = run_hashes(hashes, starts, starts + WINDOW)
    return grams[places[starts]].view(np.int64), windows.view(np.int64), starts


def cut(text: str | None, spans: list[dict] | None) -> tuple:
    """What is left of a text without the words of the spans, and the removed ranges."""
    words = words_of(text)
    if not spans:
        return len(words), 0, [], [], b" ".join(words).decode()
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, [s["first"] for s in spans], 1)
    np.add.at(marks, [s["past"] for s in spans], -1)
    removed = np.cumsum(marks)[:-1] > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], removed.astype(np.int8), [0]])))
    kept = b" ".join([words[i] for i in np.flatnonzero(~removed)]).decode()
    return len(words), int(removed.sum()), edges[::2], edges[1::2], kept


def without_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", into: str = "kept") -> DataFrame:
    """Add ``into``: n_words, n_removed, the removed ranges of words and the text that is left, its words
    joined by one space.

    A word is removed if a window of 50 words that covers it also starts in a row with a smaller key;
    windows are judged on the input. Words are separated by \\x20 and \\x09-\\x0D and compared unchanged.
    Null, empty and short texts lose nothing. A row without a key loses nothing and removes nothing;
    rows with one key do not remove from each other. An empty table gives an empty table. Other columns
    stay (one named ``into`` is replaced).
    """
    if into.lower() in {c.lower() for c in df.columns}:
        df = df.drop(into)
    own, spans, of_doc, of_own = (fresh(df, c) for c in ("_own", "_spans", "_of_doc", "_of_own"))
    keyed = df.withColumn(own, F.xxhash64(text))
    docs = keyed.select(F.col(key).alias("doc"), F.col(own).alias("own"), F.col(text).alias("text"))

    found = append(docs.filter("doc is not null"), "s", STRETCHES, lambda c: [stretches(t) for t in c["text"]], ["text"])
    seeds = found.select("doc", "own", F.inline(F.arrays_zip("s.anchor", "s.extent", "s.first", "s.last")))
    seeds = materialize(seeds, "seeds")
    classes = seeds.groupBy("anchor", "extent").agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
    classes = materialize(classes, "stretches")
    meeting = classes.groupBy("anchor").agg(F.min("least").alias("a"), F.max("least").alias("b"))
    several = meeting.filter("a < b").select("anchor", F.lit(True).alias("several"))
    useful = classes.join(several, "anchor", "left").filter("least < most or several")
    met = seeds.join(useful.select("anchor", "extent", "least", "several"), ["anchor", "extent"])
    met = materialize(
        met.select("doc", "own", "first", "last", (F.col("doc") > F.col("least")).alias("removed")).filter(
            "removed or several"
        ),
        "met",
    )

    open_ = met.filter("not removed").groupBy("doc", "own").agg(
        F.collect_set(F.struct("first", "last")).alias("wanted")
    )
    texts = docs.join(open_, ["doc", "own"]).select("doc", "own", "text", "wanted")
    keyed_windows = append(
        texts, "k", KEYS, lambda c: [window_keys(*r) for r in zip(c["text"], c["wanted"])], ["text", "wanted"]
    ).select("doc", "own", F.inline(F.arrays_zip("k.anchor", "k.window", "k.start")))
    windows = materialize(keyed_windows, "windows")
    earliest = windows.groupBy("anchor", "window").agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
    later = windows.join(earliest.filter("least < most"), ["anchor", "window"]).filter("doc > least")

    whole = met.filter("removed").select("doc", "own", "first", (F.col("last") + WINDOW).alias("past"))
    single = later.select("doc", "own", F.col("start").alias("first"), (F.col("start") + WINDOW).alias("past"))
    ranges = whole.union(single).groupBy(F.col("doc").alias(of_doc), F.col("own").alias(of_own)).agg(
        F.collect_set(F.struct("first", "past")).alias(spans)
    )
    joined = keyed.join(ranges, (F.col(key) == F.col(of_doc)) & (F.col(own) == F.col(of_own)), "left")
    joined = joined.drop(of_doc, of_own, own)
    return append(
        joined, into, KEPT, lambda c: [cut(*r) for r in zip(c[text], c[spans])], [text, spans]
    ).drop(spans)
