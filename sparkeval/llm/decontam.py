"""Benchmark passages in documents, by one automaton over all benchmark windows.

Texts are normalised to lower-case words with one space between; the windows of the benchmark become the
patterns of an Aho-Corasick automaton, which reads each text once. Matches are mapped back to words and to
code points of the original text.

The benchmark is measured first. Up to ``BLOCK_BYTES`` of patterns go into one automaton on every worker;
a larger benchmark is dealt into blocks of that size, and each block scans the documents.
"""

from __future__ import annotations

import re
import uuid

import ahocorasick
import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkeval.llm.common import append, fresh, struct
from sparkeval.plans.session import materialize

WINDOW = 10
BLOCK_BYTES = 32 << 20
# A-Z to lower case, every ASCII character that is neither letter nor digit to a space.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
FOUND = struct(
    n_words="bigint",
    n_hit="bigint",
    items="array<string>",
    first="array<bigint>",
    past="array<bigint>",
    start="array<bigint>",
    end="array<bigint>",
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def windows(
    benchmark: DataFrame, item: str = "item_id", text: str = "text", size: int = WINDOW
) -> DataFrame:
    """(pattern, items): every window of ``size`` words, a shorter item as one window, and the items that
    hold it. Items without words have none; windows of items without an id list no item for them."""
    pairs = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))

    def rows(columns: dict[str, list]) -> list[tuple]:
        found = []
        for text in columns["text"]:
            words = words_of(text)
            at = range(max(1, len(words) - size + 1)) if words else ()
            found.append((list(dict.fromkeys(b" ".join(words[i : i + size]).decode() for i in at)),))
        return found

    split = append(pairs, "w", struct(patterns="array<string>"), rows, ["text"])
    return (
        split.select("item", F.explode("w.patterns").alias("pattern"))
        .groupBy("pattern")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )


_BUILT: dict[str, ahocorasick.Automaton] = {}


def _automaton(name: str, patterns: Broadcast) -> ahocorasick.Automaton:
    """The automaton of a broadcast block; a worker keeps the last one."""
    if name not in _BUILT:
        _BUILT.clear()
        built = ahocorasick.Automaton()
        for pattern, items in patterns.value:
            key = f" {pattern.encode().decode('latin-1')} "
            built.add_word(key, (key.count(" ") - 1, items))
        built.make_automaton()
        _BUILT[name] = built
    return _BUILT[name]


def _ranges(hit: np.ndarray) -> tuple[list[int], list[int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return edges[::2].tolist(), edges[1::2].tolist()


def scan(text: str | None, automaton: ahocorasick.Automaton, earlier: dict | None = None) -> tuple:
    """Words, hit words, items, hit ranges in words and in code points; ``earlier`` blocks are added."""
    words = words_of(text)
    line = b" " + b" ".join(words) + b" "
    matches = list(automaton.iter(line.decode("latin-1"))) if words and len(automaton) else []
    items = set(earlier["items"] if earlier else ())
    first, past, start, end = [], [], [], []
    if matches or (earlier and earlier["first"]):
        hit = np.zeros(len(words), bool)
        for a, b in zip(earlier["first"], earlier["past"]) if earlier else ():
            hit[a:b] = True
        spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        lasts = np.searchsorted(spaces, [e for e, _ in matches])
        for last, (_, (size, owners)) in zip(lasts.tolist(), matches):
            hit[last - size : last] = True
            items.update(owners)
        first, past = _ranges(hit)
        spans = [m.span() for m in WORD.finditer(text)]
        start, end = [spans[a][0] for a in first], [spans[b - 1][1] for b in past]
    n_hit = sum(b - a for a, b in zip(first, past))
    return len(words), n_hit, sorted(items), first, past, start, end


def contamination(
    df: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    into: str = "hits",
    item: str = "item_id",
    item_text: str = "text",
    size: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Add ``into``: n_words, n_hit, items (ids as text, sorted) and the hit ranges, in words
    (``first``, ``past``) and in code points (``start``, ``end``), ends exclusive.

    Words of items without an id are hit too, and no item is listed for them. A null or empty text has no words and no hits; an empty benchmark hits nothing. Rows are scanned one
    by one, so repeated rows get equal values; other columns stay (one named ``into`` is replaced).
    """
    spark = df.sparkSession
    patterns = materialize(windows(benchmark, item, item_text, size), "windows")
    bytes_ = F.sum(F.length("pattern") + F.length(F.array_join("items", ",")) + 64)
    total = patterns.agg(bytes_.alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // block_bytes))
    if into.lower() in {c.lower() for c in df.columns}:
        df = df.drop(into)
    before = fresh(df, "_before")
    for block in range(blocks):
        here = patterns.filter(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == block)
        sent = spark.sparkContext.broadcast([(r.pattern, list(r["items"])) for r in here.toLocalIterator()])

        def rows(columns: dict[str, list], name=uuid.uuid4().hex, sent=sent) -> list[tuple]:
            built = _automaton(name, sent)
            earlier = columns.get(before) or [None] * len(columns[text])
            return [scan(t, built, e) for t, e in zip(columns[text], earlier)]

        if block == 0:
            df = append(df, into, FOUND, rows, [text])
        else:
            stored = materialize(df.withColumnRenamed(into, before), "hits")
            df = append(stored, into, FOUND, rows, [text, before]).drop(before)
    return df
