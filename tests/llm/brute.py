"""Plain loops that give what the operators should give."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WHITE = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def low(text: str | None) -> str:
    return (text or "").translate(LOWER)


def phrase_places(text, phrases):
    words = WORD.findall(low(text))
    found = []
    for phrase, label in phrases:
        p = phrase.split()
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return len(words), sorted(found)


def base_secrets(text):
    text = text or ""
    assign = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    spans = [("assign", *m.span()) for m in assign.finditer(text) if len(m.group(2)) >= 6]
    spans += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    spans += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    order = ["assign", "access", "hex"]
    return sorted(spans, key=lambda x: (x[1], order.index(x[0])))


def shingle_set(text):
    words = WHITE.findall(low(text))
    if not words:
        return set()
    if len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def near_groups(docs):
    """doc id -> (set size, smallest id of its component)."""
    sets = {i: shingle_set(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def without_repeats(docs):
    """doc id -> (words, removed, text left) for unique ids."""
    words = {i: WHITE.findall(t or "") for i, t in docs}
    least = {}
    for i, w in words.items():
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            least[key] = min(least.get(key, i), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if least[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def measures(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = WHITE.findall(text)
    lines = [x for x in text.split("\n") if WHITE.search(x)]
    grams = Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for i, g in enumerate(zip(words, words[1:], words[2:])):
        if grams[g] > 1:
            hit |= {i, i + 1, i + 2}
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(hit),
    )


def base_failed(m):
    return m[0] < 50 or 100 * m[4] > 50 * m[0]


def contamination(text, items, size=10):
    """Words, hit words, item ids as sorted text."""
    words = WORD.findall(low(text))
    hit, found = set(), set()
    for item, item_text in items:
        w = WORD.findall(low(item_text))
        n = min(size, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for i in range(len(words) - n + 1) if n else ():
            if tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


def view(turns, speaker):
    """The rendered dialogue and the masked spans."""
    text, mask = "", []
    for role, said in turns:
        if role == "system":
            text += "<|im_start|>system\n"
        elif role == speaker:
            text += "<|im_start|>assistant\n"
        else:
            text += f"<|im_start|>user name={role or 'unknown'}\n"
        start = len(text)
        text += (said or "") + "<|im_end|>"
        if role == speaker:
            mask.append((start, len(text)))
    return text, mask
