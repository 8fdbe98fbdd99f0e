"""Language identification with hyperdimensional profiles.

Every letter has a random vector of ``DIMENSIONS`` entries +1 and -1, drawn from its code point alone. An
n-gram binds the vectors of its letters, each permuted (rolled) by its place, into their product. A
document bundles the vectors of its n-grams into their sum, and a language bundles its documents, each
with the same weight. A document is given the language whose prototype has the largest cosine with it.

Bundling is linear, so a prototype is built from summed n-gram weights: documents are counted where they
are, weights per language and n-gram are summed by Spark, and only these are bundled. What reaches the
driver is one vector per language, and there are ``MAX_LANGUAGES`` at most. Weights and sums are integers,
so the model does not depend on how rows are split into tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkeval.llm.common import append, fewer, struct

DIMENSIONS = 1024
MAX_LANGUAGES = 4096  # prototypes that are broadcast; more distinct values are no language column
WEIGHT = 1 << 24  # of a document, shared out over its n-grams
SEED = 11
GRAMS_AT_ONCE = 4096  # n-gram vectors held at a time
CELLS = 1 << 24  # of a table of documents by n-grams
HELD = 1 << 20  # n-grams of a language that a task sums before it hands them on
CODES = 0x110000
UNKNOWN = "und"
FOUND = struct(language="string", score="double")


@lru_cache(maxsize=1 << 14)
def letter_vector(code: int) -> np.ndarray:
    """The vector of a letter; code 0 is the edge of a word."""
    bits = np.random.default_rng([SEED, code]).integers(0, 256, DIMENSIONS // 8, dtype=np.uint8)
    return np.unpackbits(bits).astype(np.int8) * 2 - 1


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """The bound vectors of n-grams, a row each."""
    bound = np.ones((len(grams), DIMENSIONS), np.int8)
    for place, shift in enumerate((42, 21, 0)):
        codes, which = np.unique((grams >> shift) & 0x1FFFFF, return_inverse=True)
        letters = np.stack([np.roll(letter_vector(int(c)), 2 - place) for c in codes])
        bound *= letters[which]
    return bound


@lru_cache(maxsize=1 << 16)
def _is_letter(code: int) -> bool:
    return not 0xD800 <= code < 0xE000 and chr(code).isalpha()


def grams_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, n-gram (three code points in one number) and count, for whole texts.

    Text is lowered; all that is no letter is the edge of a word, and an n-gram has an edge at its ends
    only: ``_th the he_``.
    """
    low = [(t or "").lower() for t in texts]
    codes = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    there = np.zeros(CODES, bool)
    there[codes] = True
    letters = np.array([c for c in np.flatnonzero(there).tolist() if _is_letter(c)], np.int64)
    rank = np.zeros(CODES, np.int32)
    rank[letters] = np.arange(1, len(letters) + 1)
    symbols = rank[codes]
    docs = np.repeat(np.arange(len(low)), [len(t) + 1 for t in low])
    docs = np.concatenate([[0], docs])
    stay = symbols > 0
    stay[1:] |= symbols[:-1] > 0
    stay[0] = True
    symbols, docs = symbols[stay].astype(np.int64), docs[stay]
    a, b, c = symbols[:-2], symbols[1:-1], symbols[2:]
    inside = b > 0
    size = len(letters) + 1
    keys = ((docs[1:-1] * size + a) * size + b)[inside] * size + c[inside]
    keys, counts = _counted(keys, len(low) * size**3)
    doc, gram = np.divmod(keys, size**3)
    code = np.concatenate([[0], letters])
    packed = code[gram // size**2] << 42 | code[gram // size % size] << 21 | code[gram % size]
    return doc, packed, counts


def _counted(keys: np.ndarray, past: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys below ``past`` and how often each occurs."""
    if past <= 4 * len(keys) + (1 << 22):
        counts = np.bincount(keys, minlength=1)
        found = np.flatnonzero(counts)
        return found, counts[found]
    return np.unique(keys, return_counts=True)


def bundles(doc: np.ndarray, gram: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """The bundled vector of each of ``n`` documents: whole numbers, exact below 2^53."""
    total = np.bincount(doc, count, minlength=n)
    kind = np.float32 if total.max(initial=0) < 1 << 24 else np.float64  # both exact there
    distinct, which = np.unique(gram, return_inverse=True)
    order = np.argsort(which, kind="stable")
    doc, which, count = doc[order], which[order], count[order]
    sums = np.zeros((n, DIMENSIONS), kind)
    step = max(1, min(GRAMS_AT_ONCE, CELLS // max(1, n)))
    for start in range(0, len(distinct), step):
        some = distinct[start : start + step]
        first, past = np.searchsorted(which, [start, start + len(some)])
        table = np.zeros((n, len(some)), kind)
        table[doc[first:past], which[first:past] - start] = count[first:past]
        sums += table @ gram_vectors(some).astype(kind)
    return sums.astype(np.float64)


@dataclass(frozen=True)
class Languages:
    """Prototypes of unit length, a row per language, in the order of the names."""

    names: list[str]
    prototypes: np.ndarray

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and cosine (0 if negative) of each text; equal cosines go to the first name."""
        doc, gram, count = grams_of(texts)
        lettered = np.bincount(doc, minlength=len(texts)) > 0
        if not self.names:
            return [(UNKNOWN, 0.0)] * len(texts)
        vectors = bundles(doc, gram, count, len(texts))
        lengths = np.linalg.norm(vectors, axis=1)
        cosines = vectors @ self.prototypes.T / np.where(lengths > 0, lengths, 1)[:, None]
        best = cosines.argmax(axis=1)
        scores = np.clip(cosines[np.arange(len(texts)), best], 0, 1)
        return [
            (self.names[b], float(s)) if ok else (UNKNOWN, 0.0) for b, s, ok in zip(best, scores, lettered)
        ]


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, which = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    sums = np.zeros(len(grams), np.int64)
    np.add.at(sums, which, np.concatenate([w for _, w in parts]))
    return grams, sums


def weights(df: DataFrame, text: str, language: str) -> DataFrame:
    """(language, gram, weight): what the documents of each language give to each n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def rows(name: str) -> pa.RecordBatch:
            grams, sums = held.pop(name)
            names = pa.DictionaryArray.from_arrays(np.zeros(len(grams), np.int32), pa.array([name])).cast(pa.string())
            return pa.RecordBatch.from_arrays([names, pa.array(grams), pa.array(sums)], names=["language", "gram", "weight"])

        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            doc, gram, count = grams_of(batch.column(1).to_pylist())
            total = np.bincount(doc, count, minlength=len(names))
            share = np.rint(count * (WEIGHT / total[doc])).astype(np.int64)
            of_doc = names[doc]
            for name in set(of_doc.tolist()):
                own = of_doc == name
                parts = [(gram[own], share[own])] + ([held[name]] if name in held else [])
                held[name] = _summed(parts)
                if len(held[name][0]) > HELD:
                    yield rows(name)
        for name in list(held):
            yield rows(name)

    rows = df.select(F.col(language).cast("string").alias("language"), F.col(text).alias("text"))
    rows = rows.filter("language is not null and text is not null")
    counted = fewer(rows).mapInArrow(run, "language string, gram bigint, weight bigint")
    return counted.groupBy("language", "gram").agg(F.sum("weight").alias("weight"))


def fit(df: DataFrame, text: str = "text", language: str = "lang") -> Languages:
    """Prototypes of all non-null values of ``language``, learned from all rows.

    Rows without language, text or letter teach nothing; each other row has the same weight, however long
    it is, and repeated rows count as often as they come. Without such rows there are no languages. More
    than ``MAX_LANGUAGES`` values raise ``ValueError``. No other column is read.
    """

    def bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            grams, share = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            vectors = gram_vectors(grams).astype(np.int64)
            for name in set(names.tolist()):
                own = names == name
                sums[name] = sums.get(name, 0) + share[own] @ vectors[own]
        at = pa.array(np.arange(DIMENSIONS, dtype=np.int32))
        for name, values in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * DIMENSIONS), at, pa.array(values)], names=["language", "place", "value"]
            )

    parts = fewer(weights(df, text, language)).mapInArrow(bundled, "language string, place int, value bigint")
    summed = parts.groupBy("language", "place").agg(F.sum("value").alias("value"))
    rows = summed.limit(MAX_LANGUAGES * DIMENSIONS + 1).collect()
    if len(rows) > MAX_LANGUAGES * DIMENSIONS:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names = sorted({r["language"] for r in rows})
    place = {name: i for i, name in enumerate(names)}
    sums = np.zeros((len(names), DIMENSIONS))
    for r in rows:
        sums[place[r["language"]], r["place"]] = r["value"]
    lengths = np.linalg.norm(sums, axis=1, keepdims=True)
    return Languages(names, sums / np.where(lengths > 0, lengths, 1))


def identify(df: DataFrame, model: Languages, text: str = "text", into: str = "language") -> DataFrame:
    """Add ``into``: language and score (cosine, 0 to 1) of each whole text.

    Null texts, texts without a letter and all texts under a model without languages are ``und`` with
    score 0. Rows are scored one by one, so repeated rows get equal values and an empty table stays
    empty; other columns stay (one named ``into`` is replaced).
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    return append(df, into, FOUND, lambda c: sent.value.predict(c[text]), [text])
