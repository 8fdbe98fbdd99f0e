"""SentencePiece BPE, encoded front to back without a merge queue, and decoded.

The encoding of every prefix of a text ends in one certain token: of all pieces that end there, the one
that may follow the last token of the prefix before it. Two tokens may be neighbours if the merges of
their joined text give these two again. So the table of last tokens is filled in one pass, with an
automaton for the pieces that end at each place and a memo of pair tests, and the ids are read from it
backwards.

No piece of such a model has a space mark behind another character, so no merge crosses the start of a
space run; texts are cut there, and a bounded memo keeps the ids of short parts. A model that has such
pieces is encoded uncut.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkeval.llm.common import append_arrays, fresh, struct

SPACE = "▁"
PART = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
MEMO_PARTS, MEMO_LENGTH, MEMO_STEPS = 300_000, 48, 1_000_000


class Memo:
    """The ids of parts, one behind the other in one array."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.start = array("q", [0])
        self.ids = array("i")

    def add(self, key: str, ids: Iterable[int]) -> None:
        self.place[key] = len(self.start) - 1
        self.ids.extend(ids)
        self.start.append(len(self.ids))

    def get(self, key: str) -> array:
        at = self.place[key]
        return self.ids[self.start[at] : self.start[at + 1]]


class Pieces:
    """The vocabulary of a BPE model with byte fallback, and the prefix table over it."""

    def __init__(self, model: bytes) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.text = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.rank: dict[str, tuple[float, int]] = {}
        self.byte: dict[int, int] = {}
        self.shown: list[bytes] = []
        self.starts: list[bool] = []
        self.silent = {i for i in range(len(self.text)) if sp.is_control(i)}
        for i, piece in enumerate(self.text):
            shown = piece.replace(SPACE, " ").encode()
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                shown = bytes([int(piece[3:5], 16)])
            elif sp.is_control(i):
                shown = b""
            elif sp.is_unknown(i):
                shown = " ⁇ ".encode()
            else:
                self.rank[piece] = (-sp.get_score(i), i)
            self.shown.append(shown)
            self.starts.append(not sp.is_byte(i) and piece.startswith(SPACE))
        self._automaton()
        self.cut = not any(SPACE in p.lstrip(SPACE) for p in self.rank)
        self.lengths = [len(t) for t in self.text]
        self.kept_steps = 0
        self.memo, self.older = Memo(), Memo()

    def _automaton(self) -> None:
        """Per state: the steps, the state to fall back to, and the pieces that end there, longest first,
        each with its memo of pair tests."""
        self.steps: list[dict[str, int]] = [{}]
        ending: dict[int, tuple] = {}
        for piece, (_, i) in self.rank.items():
            state = 0
            for char in piece:
                if char not in self.steps[state]:
                    self.steps[state][char] = len(self.steps)
                    self.steps.append({})
                state = self.steps[state][char]
            ending[state] = (len(piece), i, {})
        self.back = [0] * len(self.steps)
        self.ends: list[tuple] = [()] * len(self.steps)
        level = [0]
        while level:
            below = []
            for state in level:
                for char, to in self.steps[state].items():
                    if state:
                        at = self.back[state]
                        while at and char not in self.steps[at]:
                            at = self.back[at]
                        self.back[to] = self.steps[at].get(char, 0)
                    own = (ending[to],) if to in ending else ()
                    self.ends[to] = own + self.ends[self.back[to]]
                    below.append(to)
            level = below

    def merged(self, text: str) -> list[int]:
        """The ids of a short text, merge by merge: best score first, then the leftmost."""
        symbols = list(text)
        while len(symbols) > 1:
            joined = [
                (self.rank[a + b][0], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in self.rank
            ]
            if not joined:
                break
            i = min(joined)[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return [self.rank[s][1] if s in self.rank else -1 for s in symbols]

    def follows(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left`` (-1: no token, or a character outside the vocabulary)."""
        if left < 0:
            return self.merged(self.text[right]) == [right]
        return self.merged(self.text[left] + self.text[right]) == [left, right]

    def _step(self, state: int, char: str) -> int:
        """The state after ``char``, by the states to fall back to; up to ``MEMO_STEPS`` are kept."""
        at = state
        while at and char not in self.steps[at]:
            at = self.back[at]
        to = self.steps[at].get(char, 0)
        if self.kept_steps < MEMO_STEPS:
            self.steps[state][char] = to
            self.kept_steps += 1
        return to

    def tables(self, parts: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Each part with its ids. The parts are sorted, so that what two neighbours begin with is filled
        in once: rows of the table stay for the next part as far as the two agree."""
        steps, ends, lengths = self.steps, self.ends, self.lengths
        states, last = [0], [-1]  # of the prefix of each length
        before = ""
        for part in sorted(parts):
            at = 0
            for a, b in zip(part, before):
                if a != b:
                    break
                at += 1
            before = part
            del states[at + 1 :], last[at + 1 :]
            state = states[at]
            for char in part[at:]:
                try:
                    state = steps[state][char]
                except KeyError:
                    state = self._step(state, char)
                states.append(state)
                at += 1
                for length, piece, after in ends[state]:
                    left = last[at - length]
                    try:
                        fits = after[left]
                    except KeyError:
                        fits = after[left] = self.follows(left, piece)
                    if fits:
                        last.append(piece)
                        break
                else:
                    last.append(-1)
            ids = []
            while at:
                piece = last[at]
                if piece >= 0:
                    ids.append(piece)
                    at -= lengths[piece]
                else:
                    ids.extend(self.byte[b] for b in reversed(part[at - 1].encode()))
                    at -= 1
            ids.reverse()
            yield part, ids

    def _keys(self, text: str | None) -> list[str]:
        """The parts of a text. One that is a single space mark and other characters goes by these alone."""
        if not text:
            return []
        if self.cut and SPACE not in text and "  " not in text and text[0] != " ":
            return text.split(" ")
        marked = SPACE + text.replace(" ", SPACE)
        if not self.cut:
            return [marked]
        return [p if SPACE in p[1:] else p[1:] for p in PART.findall(marked)]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text."""
        ids, ends = (x.tolist() for x in self.encode_all(texts))
        return [ids[a:b] for a, b in zip(ends, ends[1:])]

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text begins and the last one ends. A memo of two
        generations keeps the ids of short parts."""
        split = [self._keys(t) for t in texts]
        if len(self.memo.place) > MEMO_PARTS:
            self.older, self.memo = self.memo, Memo()
        memo, older = self.memo, self.older
        missing = set().union(*split).difference(memo.place)
        for key in missing & older.place.keys():
            memo.add(key, older.get(key))
        new = {k if SPACE in k else SPACE + k: k for k in missing if k not in memo.place}
        for part, ids in self.tables(new):
            memo.add(new[part], ids)
        which = np.fromiter(map(memo.place.__getitem__, chain.from_iterable(split)), np.int64)
        start = np.frombuffer(memo.start, np.int64)
        first, sizes = start[which], start[which + 1] - start[which]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = np.frombuffer(memo.ids, np.int32)[np.repeat(first - ends[:-1], sizes) + np.arange(ends[-1])] if len(which) else np.zeros(0, np.int32)
        for key in new.values():
            if len(key) > MEMO_LENGTH:
                del memo.place[key]
        return ids, ends[np.cumsum([0, *map(len, split)])]

    def decode(self, ids: list[int] | None) -> str | None:
        if ids is None:
            return None
        first = next((i for i in ids if i not in self.silent), -1) if ids else -1
        raw = b"".join(map(self.shown.__getitem__, ids))
        if first >= 0 and self.starts[first]:
            raw = raw[1:]
        return raw.decode("utf-8", "replace").replace(SPACE, " ")


@lru_cache(maxsize=1)
def _pieces(model: bytes) -> Pieces:
    return Pieces(model)


def read_model(path: str) -> bytes:
    """A model file of the driver's; tasks get its bytes (half a megabyte for 32,000 pieces)."""
    with open(path, "rb") as file:
        return file.read()


def _lists(ids: np.ndarray, start: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(ids, pa.int32()))


def encode(df: DataFrame, model: bytes, text: str = "text", into: str = "ids") -> DataFrame:
    """Add ``into``: the ids of ``text``, without begin or end ids.

    A null or empty text has no ids. Every row is encoded on its own and whole; repeated rows get equal
    ids, an empty table gives an empty table, and other columns stay (one named ``into`` is replaced).
    """

    def arrays(columns: dict[str, pa.Array]) -> list[pa.Array]:
        return [_lists(*_pieces(model).encode_all(columns[text].to_pylist()))]

    return _flat(append_arrays(df, held := fresh(df, "_ids"), struct(ids="array<int>"), arrays, [text]), held, {"ids": into})


def decode(df: DataFrame, model: bytes, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add ``into``: the text of ``ids``; null for null, empty for none. Bytes that are no UTF-8 become
    U+FFFD.

    Repeated rows get equal texts, an empty table gives an empty table, and other columns stay (one named
    ``into`` is replaced).
    """

    def arrays(columns: dict[str, pa.Array]) -> list[pa.Array]:
        column = columns[ids]
        flat = column.flatten().to_numpy(zero_copy_only=False).tolist()
        past = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
        known = column.is_valid().to_pylist()
        pieces = _pieces(model)
        return [pa.array([pieces.decode(flat[a:b]) if k else None for a, b, k in zip([0, *past], past, known)], pa.string())]

    return _flat(append_arrays(df, held := fresh(df, "_text"), struct(text="string"), arrays, [ids]), held, {"text": into})


def round_trip(df: DataFrame, model: bytes, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add what ``encode`` and then ``decode`` add, in one pass over the rows."""

    def arrays(columns: dict[str, pa.Array]) -> list[pa.Array]:
        pieces = _pieces(model)
        found, start = pieces.encode_all(columns[text].to_pylist())
        flat, ends = found.tolist(), start.tolist()
        texts = [pieces.decode(flat[a:b]) for a, b in zip(ends, ends[1:])]
        return [_lists(found, start), pa.array(texts, pa.string())]

    kind = struct(ids="array<int>", text="string")
    return _flat(append_arrays(df, held := fresh(df, "_both"), kind, arrays, [text]), held, {"ids": ids, "text": decoded})


def _flat(df: DataFrame, held: str, names: dict[str, str]) -> DataFrame:
    return df.withColumns({into: F.col(f"{held}.{field}") for field, into in names.items()}).drop(held)
