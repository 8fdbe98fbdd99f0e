"""Secrets in texts: patterns, and strings that a primed compressor finds new.

A candidate is a long token after a word like "key" or "credential". Its novelty is the number of bytes
that it adds to the compressed form of the text around it, where the compressor starts from a
dictionary of identifiers that code is full of. A name, path or repeated string costs few bytes; a
random key costs nearly all of its own. Letters of one case, or words joined by capitals, may be a plain
name that the dictionary lacks, so more of them must be new; in long prose a random string of letters of
one case can stay below that.
"""

from __future__ import annotations

import re
from functools import cache

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkeval.llm.common import append, fresh, struct

KINDS = ("assign", "access", "hex", "novel")
# Keywords in either case and a value of letters in either case: matched on lower-cased bytes.
ASSIGN = re.compile(
    rb"""(password|passwd|secret|token|api_?key)["']? *[:=] *["']?([a-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{16,}")
SENSITIVE = (b"key", b"secret", b"token", b"passw", b"passphrase", b"credential", b"bearer", b"auth", b"private")
NEAR = 48  # bytes before a candidate in which a sensitive word makes it one
AROUND = 256  # bytes of surrounding text that prime the compressor
MIN_SHARE = 0.6  # of its own length that a candidate must add
WORD_SHARE = 0.9  # the same for what may be plain words
WORDS = re.compile(rb"[A-Z]?[a-z]+(?:[A-Z][a-z]{2,})*|[A-Z]+")
IDENTIFIERS = """
abstract access_key account_id address api_key application args array assert async attribute auth_token
authorization await base64 bearer boolean break bucket buffer bytes cache callback certificate class client
client_id client_secret collection column config configuration connection connection_string const constructor
content context continue controller count create credentials database dataframe default definition delete
description dictionary directory document double element else encoding endpoint environment error event except
exception execute export extends false field filename final finally float for format from function generate
getattr handler header host hostname identifier implements import index information initialize input insert
instance integer interface internal iterator json lambda language length library license list localhost logger
manager message method module name namespace none null number object option output override package parameter
parent password path pattern permission port prefix primary_key private private_key process project property
protected public public_key query raise read reference register repository request required resource response
result return schema secret secret_key select self serialize server service session signature size source
static status storage string struct super switch table template this throw timeout timestamp token true type
undefined update user_id username utf-8 value variable vector version void while window with write yield
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 https://www. .com/ http:// xxxxxxxxxxxxxxxx
"""
FOUND = T.StructType(
    [
        T.StructField("kind", T.ArrayType(T.StringType())),
        T.StructField("start", T.ArrayType(T.LongType())),
        T.StructField("end", T.ArrayType(T.LongType())),
    ]
)


@cache
def _compressor() -> zstandard.ZstdCompressor:
    words = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    words.precompute_compress(level=3)
    return zstandard.ZstdCompressor(
        level=3, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False
    )


def novelty(before: bytes, candidate: bytes, after: bytes) -> int:
    """Bytes that the candidate adds to its compressed surroundings."""
    compress = _compressor().compress
    return len(compress(before + after + candidate)) - len(compress(before + after))


def _novel(raw: bytes, low: bytes) -> list[tuple[int, int]]:
    if not any(w in low for w in SENSITIVE):
        return []
    found = []
    for m in CANDIDATE.finditer(raw):
        s, e = m.span()
        context = low[max(0, s - NEAR) : s]
        if not any(w in context for w in SENSITIVE):
            continue
        token = m.group()
        added = novelty(raw[max(0, s - AROUND) : s], token, raw[e : e + AROUND])
        if added >= (WORD_SHARE if WORDS.fullmatch(token) else MIN_SHARE) * len(token):
            found.append((s, e))
    return found


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind. Matches of one kind do not overlap; a
    novel string is reported only where no pattern has matched."""
    raw = (text or "").encode()
    low = raw.lower()
    spans = [("assign", *m.span()) for m in ASSIGN.finditer(low) if len(m.group(2)) >= 6]
    spans += [("access", *m.span()) for m in ACCESS.finditer(raw)]
    spans += [("hex", *m.span()) for m in HEX.finditer(raw)]
    base = list(spans)
    spans += [
        ("novel", s, e) for s, e in _novel(raw, low) if not any(s < y and x < e for _, x, y in base)
    ]
    if spans and not raw.isascii():
        places, at, n = {}, 0, 0
        for p in sorted({p for _, s, e in spans for p in (s, e)}):
            n += len(raw[at:p].decode())
            at = p
            places[p] = n
        spans = [(k, places[s], places[e]) for k, s, e in spans]
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0])))


def find(df: DataFrame, text: str = "text", into: str = "secrets") -> DataFrame:
    """Add ``into``: arrays of kind, start and end of the secrets in ``text``, in code points.

    A null or empty text has none. Rows are scanned one by one, whole; repeated rows get equal values,
    an empty table gives an empty table, and other columns stay (one named ``into`` is replaced).
    """

    def rows(columns: dict[str, list]) -> list[tuple]:
        found = [scan(t) for t in columns[text]]
        return [tuple([x[i] for x in spans] for i in range(3)) for spans in found]

    return append(df, into, FOUND, rows, [text])


def redact_text(text: str | None, spans: list[tuple[str, int, int]], by: str) -> str | None:
    if not spans:
        return text
    kept, at = [], 0
    for _, start, end in spans:
        if start >= at:
            kept += [text[at:start], by]
        at = max(at, end)
    return "".join([*kept, text[at:]])


def redact(df: DataFrame, text: str = "text", by: str = "[secret]") -> DataFrame:
    """``df`` with every secret in ``text`` replaced; overlapping ones are replaced together. A null text
    stays null."""
    held = fresh(df, "_redacted")

    def rows(columns: dict[str, list]) -> list[tuple]:
        return [(redact_text(t, scan(t), by),) for t in columns[text]]

    done = append(df, held, struct(text="string"), rows, [text])
    return done.select(*[F.col(f"{held}.text").alias(c) if c == text else F.col(f"`{c}`") for c in df.columns])
