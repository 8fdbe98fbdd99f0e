"""Token counts that follow edits.

A document is cut into pre-tokens by the tokenizer's pattern; leaves of ``LEAF`` pre-tokens hold how many
code points and tokens they cover, and a binary tree above them holds the sums. An edit is located by
descending the tree; the pre-tokens are cut anew from a leaf that the edit cannot have changed to the
first place after the edit where an old leaf starts. Behind it nothing changes, as the pattern reads from
left to right. Only the leaves between are encoded; then the sums on their paths are renewed.

A leaf may hold up to ``MOST`` pre-tokens or none. So the new pre-tokens nearly always have room in the leaves
that they replace; a long insertion moves leaves within the smallest subtree that has enough empty ones, and
only if the whole tree is full is it built again, with twice the room.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkeval.llm.common import append, fresh, struct

LEAF, MOST = 64, 128  # pre-tokens of a leaf when it is built, and at most
# A pre-token's match looks at most two characters beyond its end, besides a run of whitespace.
LOOKAHEAD = 3
MEMO = 300_000
TREE = struct(chars="array<bigint>", tokens="array<bigint>")
EDITED = struct(
    n_tokens="bigint",
    n_chars="bigint",
    n_encoded="bigint",
    n_renewed="bigint",
    text="string",
    chars="array<bigint>",
    tokens="array<bigint>",
)


def restart(text: str, start: int) -> int:
    """A place that no match before it looks from as far as ``start``."""

    def before_run(at: int) -> int:
        while at > 0 and text[at - 1].isspace():
            at -= 1
        return at

    return before_run(max(0, before_run(start) - LOOKAHEAD))


class Counter:
    """Tokens of pre-tokens, with a bounded memo."""

    def __init__(self, ranks: bytes, pattern: str) -> None:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        self.encode = coder.encode_ordinary
        self.split = regex.compile(pattern)
        self.memo: dict[str, int] = {}

    def count(self, pieces: list[str]) -> int:
        memo, total = self.memo, 0
        for piece in pieces:
            n = memo.get(piece)
            if n is None:
                n = len(self.encode(piece))
                if len(piece) <= 32:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[piece] = n
            total += n
        return total

    def leaves(self, pieces: list[str], room: int = 0) -> list[tuple[int, int]]:
        """Leaves of ``LEAF`` pre-tokens, or ``room`` fuller ones if they suffice."""
        size = LEAF
        if room and LEAF * room < len(pieces) <= MOST * room:
            size = -(-len(pieces) // room)
        cut = (pieces[i : i + size] for i in range(0, len(pieces), size))
        return [(sum(map(len, part)), self.count(part)) for part in cut]


@lru_cache(maxsize=2)
def _counter(ranks: bytes, pattern: str) -> Counter:
    return Counter(ranks, pattern)


class Tree:
    """Sums over leaves. Node 1 is the root, node i has the children 2i and 2i + 1; ``chars`` and
    ``tokens`` are such arrays, as stored. Empty leaves may lie between others."""

    def __init__(self, chars: list[int], tokens: list[int]) -> None:
        self.chars, self.tokens = chars, tokens
        self.width = len(chars) // 2
        self.renewed = 0

    @classmethod
    def over(cls, leaves: list[tuple[int, int]], room: int = 1) -> Tree:
        """A tree with at least ``room`` places for leaves."""
        width = 1
        while width < max(len(leaves), room):
            width *= 2
        tree = cls([0] * (2 * width), [0] * (2 * width))
        tree.put(0, leaves)
        tree.renewed = 0
        return tree

    @property
    def n(self) -> int:
        """Places up to the last leaf that is not empty."""
        node = 1
        while node < self.width:
            node = 2 * node + (self.chars[2 * node + 1] > 0)
        return node - self.width + 1 if self.chars[1] else 0

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The last leaf, no empty one, that starts at or before ``place``, and its start."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if place >= start + self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return node - self.width, start

    def filled(self, first: int, past: int) -> list[tuple[int, int]]:
        w = self.width
        pairs = zip(self.chars[w + first : w + past], self.tokens[w + first : w + past])
        return [p for p in pairs if p[0]]

    def put(self, first: int, leaves: list[tuple[int, int]]) -> None:
        """Set consecutive leaves and renew the sums above them."""
        for i, (c, t) in enumerate(leaves, self.width + first):
            self.chars[i], self.tokens[i] = c, t
        low, high = self.width + first, self.width + first + len(leaves) - 1
        while low > 1 and leaves:
            low, high = low // 2, high // 2
            for i in range(low, high + 1):
                self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
                self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
            self.renewed += high - low + 1

    def replace(self, first: int, past: int, new: list[tuple[int, int]]) -> Tree:
        """The tree with other leaves in a range. If they have no room there, they and their neighbours are
        spread over the smallest subtree that is not too full: a small one may be filled, a large one to
        three quarters."""
        if len(new) <= past - first:
            self.put(first, new + [(0, 0)] * (past - first - len(new)))
            return self
        depth, level = self.width.bit_length() - 1, 0
        while level < depth:
            level += 1
            size = 1 << level
            low = first // size * size
            if past > low + size:
                continue
            held = [*self.filled(low, first), *new, *self.filled(past, low + size)]
            if len(held) <= size - size * level // (4 * depth):
                spread = [(0, 0)] * size
                for i, leaf in enumerate(held):
                    spread[i * size // len(held)] = leaf
                self.put(low, spread)
                return self
        held = [*self.filled(0, first), *new, *self.filled(past, self.width)]
        grown = Tree.over(held, 2 * self.width)
        grown.renewed = self.renewed + grown.width
        return grown


def edit(
    counter: Counter, text: str, tree: Tree, start: int, end: int, by: str
) -> tuple[str, Tree, int]:
    """The text with ``text[start:end]`` replaced, its tree, and the code points that were encoded."""
    changed = text[:start] + by + text[end:]
    first, begin = tree.leaf_at(restart(text, start))
    shift, settled = len(by) - (end - start), start + len(by)
    past, meets = tree.leaf_at(end)
    if meets < end or past == first:
        past, meets = past + 1, meets + tree.chars[tree.width + past]
    pieces: list[str] = []
    at, last = begin, tree.n
    for m in counter.split.finditer(changed, begin):
        # An old leaf that starts here starts the unchanged rest.
        while past < last and meets + shift < at:
            meets += tree.chars[tree.width + past]
            past += 1
        if at >= settled and past < last and meets + shift == at:
            break
        pieces.append(m.group())
        at = m.end()
    else:
        past = max(past, last)
    return changed, tree.replace(first, past, counter.leaves(pieces, past - first)), at - begin


def build(
    df: DataFrame, ranks: bytes, pattern: str, text: str = "text", into: str = "tree"
) -> DataFrame:
    """Add ``into``: the segment tree of ``text`` (``chars`` and ``tokens``; the root, element 1, is the
    sum, a null or empty text has sums 0)."""

    def rows(columns: dict[str, list]) -> list[tuple]:
        counter = _counter(ranks, pattern)
        trees = (Tree.over(counter.leaves(counter.split.findall(t or ""))) for t in columns[text])
        return [(t.chars, t.tokens) for t in trees]

    return append(df, into, TREE, rows, [text])


def apply_edits(
    df: DataFrame,
    ranks: bytes,
    pattern: str,
    text: str = "text",
    tree: str = "tree",
    edits: str = "edits",
    into: str = "edited",
) -> DataFrame:
    """Add ``into``: text, tree and counts after ``edits`` (an array of structs of start, end and by).

    Edits refer to the text before all of them and are applied from the last to the first; one that
    overlaps a later one ends where that begins. Places beyond the text mean its end, a null ``by`` is
    empty, an edit without start or end is left out, null edits are none. ``n_encoded`` counts the code
    points that were encoded again, ``n_renewed`` the inner sums. A null text stays null and has none.
    Rows are independent: repeated rows get equal values, an empty table gives an empty table.

    ``pattern`` may be any whose matches cover the text, do not look at what lies before them, and look
    beyond their end at two characters and a run of whitespace at most.
    """

    def one(counter: Counter, old: str | None, sums: dict, changes: list | None) -> tuple:
        if old is None:
            return 0, 0, 0, 0, None, sums["chars"], sums["tokens"]
        held = Tree(list(sums["chars"]), list(sums["tokens"]))
        now, encoded, limit = old, 0, len(old)
        valid = [c for c in changes or () if c and c["start"] is not None and c["end"] is not None]
        for c in sorted(valid, key=lambda c: (c["start"], c["end"], c["by"] or ""), reverse=True):
            start = min(max(c["start"], 0), limit)
            end = min(max(c["end"], start), limit)
            now, held, n = edit(counter, now, held, start, end, c["by"] or "")
            encoded += n
            limit = start
        return held.tokens[1], held.chars[1], encoded, held.renewed, now, held.chars, held.tokens

    def rows(columns: dict[str, list]) -> list[tuple]:
        counter = _counter(ranks, pattern)
        return [one(counter, *r) for r in zip(columns[text], columns[tree], columns[edits])]

    return append(df, into, EDITED, rows, [text, tree, edits])


def with_edits(df: DataFrame, edits: DataFrame, key: str = "doc_id", into: str = "edits") -> DataFrame:
    """Bring a table of edits (key, start, end, by) to the documents, as an array per document.

    An array holds the change set of one document, which is applied as a whole. Edits with a null key or
    of no document are left out; documents without edits get null.
    """
    held, of = fresh(df, "_edits"), fresh(df, "_of")
    sets = edits.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias(of)).agg(
        F.collect_list(F.struct("start", "end", "by")).alias(held)
    )
    joined = df.join(sets, F.col(key) == F.col(of), "left").drop(of)
    return joined.withColumn(into, F.col(held)).drop(held)
