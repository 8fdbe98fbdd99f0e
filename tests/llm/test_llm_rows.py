"""Operators that look at one row at a time, against plain loops, on given and on odd texts."""

from __future__ import annotations

import random
import re
import string
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
import zstandard
from conftest import SF, odd_texts
from pyspark.sql import functions as F

from sparkeval.llm import classifier, decontam, licenses, pieces, quality, queries, secret_scan, tokens

MODEL = pieces.read_model(queries.PIECES)
RANKS = pieces.read_model(queries.RANKS)


def given():
    import pyarrow.parquet as pq

    return pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()


TEXTS = odd_texts() + given()


def check_columns(odd, done, into):
    """All other columns stay as they are, one row for each row, also on an empty table."""
    others = [c for c in odd.columns if c != into]
    assert sorted(done.columns) == sorted([*others, into])
    kept = done.select(*others).collect()
    assert sorted(map(str, kept)) == sorted(map(str, odd.select(*others).collect()))


def test_quality(odd):
    done = quality.ledger(odd)
    check_columns(odd, done, "quality")
    for r in done.collect():
        want = brute.measures(r.text)
        q = r.quality
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == want
        assert bool(q.failures & quality.mask(quality.POLICIES[1])) == brute.base_failed(want)
    assert quality.ledger(odd.limit(0)).count() == 0


@pytest.mark.parametrize("text", TEXTS)
def test_measures(text):
    assert quality.measure_text(text)[:5] == brute.measures(text)


def test_policies_and_ablations(odd):
    ledgers = quality.ledger(odd).cache()
    rows = ledgers.select("quality.failures").collect()
    for version, rules in quality.POLICIES.items():
        allowed = quality.mask(rules)
        kept = ledgers.filter(quality.passes(F.col("quality.failures"), version)).count()
        assert kept == sum(r.failures & allowed == 0 for r in rows)
        for r in quality.ablations(ledgers, version).collect():
            bit = quality.mask((r.rule,))
            assert r.failed == sum(bool(x.failures & bit) for x in rows)
            assert r.failed_alone == sum(x.failures & allowed == bit for x in rows)
            assert r.kept_without == sum(x.failures & allowed & ~bit == 0 for x in rows)
    assert {r.failed for r in quality.ablations(ledgers.limit(0), 2).collect()} == {0}


@pytest.mark.parametrize("text", TEXTS)
def test_secret_spans(text):
    spans = secret_scan.scan(text)
    assert [s for s in spans if s[0] != "novel"] == brute.base_secrets(text)
    for _, s, e in spans:
        assert 0 <= s < e <= len(text)


def test_novel_strings():
    def novel(text):
        return [text[s:e] for k, s, e in secret_scan.scan(text) if k == "novel"]

    key = "q7Zk2Lm9Xw4Rt8Yp3Vn6"
    assert novel(f"the signing key is {key}, keep it") == [key]
    assert novel(f"ünï the signing key is {key}") == [key]
    assert novel(f"the parcel number is {key}") == []
    assert novel("the private key is in configuration_connection_string_2") == []
    assert novel("the key is aaaaaaaaaaaaaaaaaaaaaaaa1111111111") == []
    assert novel("authentication and responsibilities without borders") == []


def test_novel_strings_of_one_class():
    """Letters alone and digits alone are measured like all others."""
    rng = random.Random(5)
    keys = ["QzXwVbNmLkJhGfDsApOi"]
    keys += ["".join(rng.choices(kind, k=n)) for kind in (string.ascii_letters, string.digits) for n in (16, 20, 32)]
    keys += ["".join(rng.choices(kind, k=20)) for kind in (string.ascii_lowercase, string.ascii_uppercase)]
    for key in keys:
        text = f"the private key: {key} and then the rest of the text goes on."
        assert [text[s:e] for _, s, e in secret_scan.scan(text)] == [key]
        assert key not in secret_scan.redact_text(text, secret_scan.scan(text), "[secret]")
    assert [s[0] for s in secret_scan.scan("private: QzXwVbNmLkJhGfDsApOi")] == ["novel"]
    for plain in ("responsibilities", "internationalization", "n" * 40, "0" * 20, "applicationConfiguration"):
        assert secret_scan.scan(f"the private key: {plain} and then the rest of the text goes on.") == []


def slow_novel(text, base):
    """Novel strings by hand: each run of candidate characters, its bytes before and after compressed anew."""
    text = text or ""
    found, at = [], 0
    allowed = set(string.ascii_letters + string.digits + "+/_=-")
    while at < len(text):
        end = at
        while end < len(text) and text[end] in allowed:
            end += 1
        if end - at >= 16:
            before, token, after = text[:at].encode(), text[at:end], text[end:].encode()
            near = before[-48:].decode("latin-1").translate(brute.LOWER)
            if any(w in near for w in ("key", "secret", "token", "passw", "passphrase", "credential", "bearer", "auth", "private")):
                words = zstandard.ZstdCompressionDict(secret_scan.IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                size = lambda raw: len(
                    zstandard.ZstdCompressor(level=3, dict_data=words, write_content_size=False, write_checksum=False,
                                             write_dict_id=False).compress(raw))
                around = before[-256:] + after[:256]
                plain = re.fullmatch("[A-Z]?[a-z]+([A-Z][a-z]{2,})*|[A-Z]+", token)
                added = size(around + token.encode()) - size(around)
                if added >= (0.9 if plain else 0.6) * len(token) and not any(at < e and s < end for _, s, e in base):
                    found.append(("novel", at, end))
        at = max(end, at + 1)
    return found


def test_secret_query(llm_spark, tmp_path):
    """The registered query on every document and on odd texts, against loops of their own."""
    texts = given() + odd_texts()[:13] + [
        "é the signing key is q7Zk2Lm9Xw4Rt8Yp3Vn6, auth_token q7Zk2Lm9Xw4Rt8Yp3Vn6+/A=", "private QzXwVbNmLkJhGfDsApOi",
        "key token = q7Zk2Lm9Xw4Rt8Yp3Vn6 secret applicationConfiguration 日本 bearer 8fK2-mQ9_zR4tW7yB1nC",
    ]
    docs = llm_spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in queries.op3_secret_scan(llm_spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts)
    novel = 0
    for i, text in enumerate(texts):
        base = brute.base_secrets(text)
        added = slow_novel(text, base)
        novel += len(added)
        named = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        order = ["assign", "access", "hex", "novel"]
        r = rows[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for k, _, _ in base) for kind in order[:3])
        assert r.base_sha256 == brute.sha(named(base))
        assert r.spans == named(sorted(base + added, key=lambda x: (x[1], order.index(x[0])))), i
    assert novel >= 4


def test_secrets(odd):
    done = secret_scan.find(odd, into="hits")
    check_columns(odd, done, "hits")
    for r in done.collect():
        assert list(zip(r.hits.kind, r.hits.start, r.hits.end)) == secret_scan.scan(r.text)
    assert secret_scan.find(odd.limit(0)).count() == 0


def test_redaction(odd):
    done = secret_scan.redact(odd)
    assert done.columns == odd.columns and done.count() == odd.count()
    texts = {r.text for r in done.collect()}
    assert None in texts and "" in texts
    assert all(not brute.base_secrets(t) for t in texts if t and "abcdefgh" not in t)
    assert secret_scan.redact_text("abcdef", [("a", 1, 3), ("b", 2, 5)], "#") == "a#f"


ITEMS = [(1, "the of alpha beta"), (2, " ".join(f"k{i}" for i in range(25))), (3, None), (4, "..."), (None, "one"), ("x", "日本")]


def test_decontamination(llm_spark):
    rng = random.Random(2)
    passage = [f"K{i}" for i in range(25)]
    texts = TEXTS[:60] + [
        "The, of; ALPHA (beta) the of alpha beta",
        " ".join(["a"] * 5 + passage[3:14] + ["b"] + passage[:9] + ["x"] + passage[10:20]),
        "-".join(passage) + "日本 日本",
    ]
    texts += [" ".join(rng.choice(passage + ["the", "of", "alpha", "beta"]) for _ in range(200)) for _ in range(5)]
    docs = llm_spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id int, text string, hits string")
    items = llm_spark.createDataFrame([(str(i) if i else None, t) for i, t in ITEMS], "item_id string, text string")
    for block_bytes in (1 << 20, 400):  # one automaton, and several blocks
        found = decontam.contamination(docs, items, block_bytes=block_bytes).collect()
        assert len(found) == len(texts)
        for r in found:
            n_words, n_hit, _ = brute.contamination(r.text, ITEMS)
            named = brute.contamination(r.text, [x for x in ITEMS if x[0]])[2]
            assert (r.hits.n_words, r.hits.n_hit, r.hits["items"]) == (n_words, n_hit, named)
            words = brute.WORD.findall(brute.low(r.text))
            for a, b, s, e in zip(r.hits.first, r.hits.past, r.hits.start, r.hits.end):
                assert brute.WORD.findall(brute.low(r.text[s:e])) == words[a:b]
    none = decontam.contamination(docs, items.limit(0)).collect()
    assert {r.hits.n_hit for r in none} == {0}
    assert decontam.contamination(docs.limit(0), items).count() == 0


def test_passages_of_items_without_an_id(llm_spark):
    """Their words are hit, also in a block behind the first; no item is listed for them."""
    texts = ["one two", "two one 日本", "the of alpha beta", "nothing here"]
    docs = llm_spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    items = llm_spark.createDataFrame([(str(i) if i else None, t) for i, t in ITEMS], "item_id string, text string")
    for block_bytes in (1 << 20, 400):
        found = decontam.contamination(docs, items, block_bytes=block_bytes).collect()
        got = {r.doc_id: (r.hits.n_hit, r.hits["items"]) for r in found}
        assert got == {0: (1, []), 1: (2, ["x"]), 2: (4, ["1"]), 3: (0, [])}


def test_licences(odd, llm_spark):
    found = licenses.scan(odd)
    rows = found.collect()
    assert len(rows) == odd.count() and found.columns == ["doc_id", "licences"]
    by_id = {r.doc_id: r.licences for r in rows}
    for i, t in enumerate(odd_texts()):
        n, places = brute.phrase_places(t, licenses.PHRASES)
        got = by_id[i]
        assert (got.n_words, got.n_base) == (n, len(places))
        assert got.first_word == (places[0][0] if places else None)
        assert got.last_word == (places[-1][0] if places else None)
        assert got.base_labels == sorted({label for _, label in places})
        assert set(got.base_labels) <= set(got.labels) and 0 <= got.score <= 1
    assert licenses.scan(odd.limit(0)).count() == 0


def test_notices_with_changes(llm_spark):
    bsd = licenses.NOTICES[8][0]
    words = bsd.split()
    texts = [
        "x " + bsd,
        " ".join(words[:6] + ["always"] + words[6:]),  # a word put in
        " ".join(words[:6] + words[7:]),  # a word left out
        " ".join(words[:5]),
        " ".join(reversed(words)),
        "Licensed under CC BY-NC 4.0.",
    ]
    docs = llm_spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.licences for r in licenses.scan(docs).collect()}
    assert [got[i].labels for i in range(6)] == [["bsd"], ["bsd"], ["bsd"], [], [], ["cc-by-nc"]]
    assert got[0].score == 1 and got[0].spans[0].first == 1 and 0.85 <= got[1].score < 1


def test_spans_as_a_whole(llm_spark):
    """A notice's pairs that drift apart are no notice; stray pairs beside a notice do not hide it."""
    mit, bsd = licenses.NOTICES[0][0], licenses.NOTICES[8][0]
    words = mit.split()
    apart = " ".join(f"{a} {b} zz" for a, b in zip(words, words[1:]))
    stray = " ".join(f"{a} {b} x" for a, b in zip(bsd.split()[:5], bsd.split()[1:6]))
    thirds = " ".join(words[:6] + ["one"] + words[6:12] + ["two"] + words[12:])
    slid = " ".join(words[:5] + ["one", "two", "three"] + words[5:10] + ["four", "five", "six"] + words[10:])
    texts = [apart, f"{stray} {bsd} {stray}", thirds, slid, f"{mit} {bsd} {mit}", f"{mit} {mit}", None, ""]
    docs = llm_spark.createDataFrame([*enumerate(texts), (0, apart), (None, mit), (None, mit), (None, bsd)], "doc_id int, text string")
    rows = licenses.scan(docs).collect()
    assert len(rows) == docs.count()
    got = {r.doc_id: r.licences for r in rows if r.doc_id is not None}
    assert [got[i].labels for i in range(8)] == [[], ["bsd"], ["mit"], [], ["bsd", "mit"], ["mit"], [], []]
    assert got[0].score == 0 and got[1].score == 1 and [s.first for s in got[1].spans] == [15]
    assert [(s.first, s.label, s.share) for s in got[4].spans] == [
        (0, "mit", 1.0), (len(words), "bsd", 1.0), (len(words) + len(bsd.split()), "mit", 1.0)]
    assert [s.first for s in got[5].spans] == [0, len(words)]
    assert sorted(r.licences.labels for r in rows if r.doc_id is None) == [["bsd"], ["mit"], ["mit"]]


def test_pieces_against_the_library(odd):
    library = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    own = pieces.Pieces(MODEL)
    for text in TEXTS:
        ids = own.encode([text])[0]
        assert ids == library.encode(text or "")
        assert own.decode(ids) == library.decode(ids)
    rng = random.Random(4)
    alphabet = list("      abcdefghinorst<>0x41_\t\n\r▁é中文😀\x00ñíß.,!'\"-") + ["ing", " the", "    ", "http://", "===="]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        ids = own.encode([text])[0]
        assert ids == library.encode(text) and own.decode(ids) == library.decode(ids)
    for _ in range(500):
        text = "".join(rng.choice(own.text[259:]) for _ in range(rng.randint(0, 30))).replace("▁", " ")
        assert own.encode([text])[0] == library.encode(text)
    assert own.decode([]) == "" and own.decode(None) is None


def test_pieces(odd):
    library = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    done = pieces.decode(pieces.encode(odd, MODEL, into="hits"), MODEL, ids="hits", into="label")
    assert set(done.columns) == set(odd.columns) and done.count() == odd.count()
    for r in done.collect():
        assert r.hits == library.encode(r.text or "") and r.label == library.decode(r.hits)
    assert pieces.encode(odd.limit(0), MODEL).count() == 0


def test_pieces_when_the_memo_turns_over(monkeypatch):
    monkeypatch.setattr(pieces, "MEMO_PARTS", 50)
    monkeypatch.setattr(pieces, "MEMO_STEPS", 20)
    library = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    own = pieces.Pieces(MODEL)
    for at in range(0, len(TEXTS), 7):
        some = TEXTS[at : at + 7]
        assert own.encode(some) == [library.encode(t or "") for t in some]


def test_round_trip_and_lone_ids(llm_spark, odd):
    library = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    done = pieces.round_trip(odd, MODEL, ids="hits", decoded="label")
    assert set(done.columns) == set(odd.columns)
    rows = done.collect()
    assert len(rows) == odd.count() and pieces.round_trip(odd.limit(0), MODEL).count() == 0
    for r in rows:
        assert r.hits == library.encode(r.text or "") and r.label == library.decode(r.hits)
    lists = [None, [], [5, 6, 7], [1], [0], [198, 199, 300], *[library.encode(t or "") for t in TEXTS[:9]]]
    ids = llm_spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "k int, ids array<int>").repartition(3)
    for r in pieces.decode(ids, MODEL).collect():
        assert r.decoded == (None if r.ids is None else library.decode(r.ids))


def test_sentencepiece_query(llm_spark):
    """The registered query against the library, on every document."""
    library = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    docs = {r.doc_id: r.text for r in llm_spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op10_sentencepiece(llm_spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), brute.sha(",".join(map(str, ids))))
        assert r.decoded_sha256 == brute.sha(library.decode(ids))


def test_token_edits(llm_spark):
    ranks = {a: b for a, b in tokens.Counter(RANKS, public_tokenizers.PATTERN).encode.__self__._mergeable_ranks.items()}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(8)
    rows = []
    for i, text in enumerate(TEXTS[:80]):
        n = len(text or "")
        edits = [(rng.randint(0, n + 3), rng.randint(0, n + 9), rng.choice([None, "", " x", "'ll", "\n\n ", "é" * 9])) for _ in range(4)]
        edits = [(min(a, b), min(max(a, b), min(a, b) + 30), c) for a, b, c in edits]
        rows.append((i, text, [*edits, (None, 3, "no"), (-5, 1, "head ")] if i % 5 else None, 1))
    docs = llm_spark.createDataFrame(rows, "doc_id int, text string, edits array<struct<start:int,end:int,by:string>>, tree int")
    built = tokens.build(docs, RANKS, public_tokenizers.PATTERN)
    done = tokens.apply_edits(built, RANKS, public_tokenizers.PATTERN).collect()
    assert len(done) == len(rows)
    for r in done:
        assert r.tree.tokens[1] == len(coder.encode_ordinary(r.text or "")) and r.tree.chars[1] == len(r.text or "")
        if r.text is None:
            assert r.edited.text is None and r.edited.n_tokens == 0
            continue
        want, limit = r.text, len(r.text)
        edits = [e for e in r.edits or [] if e.start is not None]
        for e in sorted(edits, key=lambda e: (e.start, e.end, e.by or ""), reverse=True):
            start = min(max(e.start, 0), limit)
            want = want[:start] + (e.by or "") + want[min(max(e.end, start), limit) :]
            limit = start
        assert r.edited.text == want
        assert r.edited.n_tokens == len(coder.encode_ordinary(want)) == r.edited.tokens[1]
        assert r.edited.n_chars == len(want)
    long_one = next(r for r in done if r.text and len(r.text) > 400_000 and " " in r.text and r.edits)
    assert long_one.edited.n_encoded < len(long_one.text) / 50
    assert tokens.build(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_edits_behind_long_whitespace():
    """A match that reads a whole run of whitespace sees an edit behind it."""
    for pattern in (r"\s*[\r\n]+|\s|\S+", public_tokenizers.PATTERN):
        counter = tokens.Counter(RANKS, pattern)
        for text, at in (("a" + " " * 300 + "b", 301), ("word " * 100 + "\t" * 500 + "x" * 3, 1000), (" " * 200, 200)):
            for by in ("\n", "y", "  \r\n z"):
                tree = tokens.Tree.over(counter.leaves(counter.split.findall(text)))
                changed, tree, _ = tokens.edit(counter, text, tree, at, at, by)
                assert changed == text[:at] + by + text[at:]
                assert tree.tokens[1] == counter.count(counter.split.findall(changed))


def long_text(rng, n):
    return "".join(rng.choice(["word ", "a, ", "x1\n", "Ünicode ", "don't "]) for _ in range(n))


def test_small_edits_renew_their_paths_only():
    """Nodes renewed by an edit of a few words grow with the height of the tree, not with its leaves."""
    counter, rng = tokens.Counter(RANKS, public_tokenizers.PATTERN), random.Random(2)
    for n in (3_000, 30_000, 120_000):
        text = long_text(rng, n)
        tree = tokens.Tree.over(counter.leaves(counter.split.findall(text)))
        height, most = tree.width.bit_length(), 0
        for _ in range(150):
            at, before = rng.randint(0, len(text)), tree.renewed
            by = rng.choice(["", " some more words", "\n\n", "x", " An inserted sentence."])
            text, tree, _ = tokens.edit(counter, text, tree, at, min(len(text), at + rng.choice([0, 0, 9, 30])), by)
            most = max(most, tree.renewed - before)
        assert most <= 4 * height
        assert tree.tokens[1] == counter.count(counter.split.findall(text)) and tree.chars[1] == len(text)


def test_edits_of_every_length():
    """Texts that grow from nothing, at one place or all over, shrink to nothing and grow again."""
    counter, rng = tokens.Counter(RANKS, public_tokenizers.PATTERN), random.Random(5)
    for one_place in (True, False):
        text, tree = "", tokens.Tree.over([])
        for step in range(240):
            start = min(len(text), 40) if one_place else rng.randint(0, len(text))
            shrinks = 120 <= step < 160 or not step % 7
            end = min(len(text), start + rng.choice([5, 400, 20_000])) if shrinks else start
            by = "" if shrinks else long_text(rng, rng.choice([1, 30, 200, 1500]))
            text, tree, _ = tokens.edit(counter, text, tree, start, end, by)
            if step == 150:
                text, tree, _ = tokens.edit(counter, text, tree, 0, len(text), "")
                assert text == "" and tree.tokens[1] == tree.n == 0
            assert tree.chars[1] == len(text) == sum(tree.chars[tree.width :])
            if step % 20 == 19:
                assert tree.tokens[1] == counter.count(counter.split.findall(text))
                for i in range(1, tree.width):
                    assert tree.tokens[i] == tree.tokens[2 * i] + tree.tokens[2 * i + 1]
        assert tree.renewed < 240 * 400


def test_edit_table(llm_spark):
    docs = llm_spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "doc_id int, text string")
    edits = llm_spark.createDataFrame([(1, 0, 1, "z"), (1, 1, 1, "y"), (None, 0, 0, "n"), (9, 0, 0, "q")], "doc_id int, start int, end int, by string")
    got = {r.doc_id: r.edits for r in tokens.with_edits(docs, edits).collect()}
    assert sorted(e.by for e in got[1]) == ["y", "z"] and got[2] is None and got[None] is None


def test_statistics():
    for text in TEXTS:
        x = classifier.statistics(text)
        assert len(x) == len(classifier.FEATURES) and all(v == v and abs(v) < 1e6 for v in x)


def test_pooled():
    values = classifier.pooled([0.1, 0.5, 0.2, 0.9, 0.8], [1, 1, 3, 1, 1])
    assert list(values) == pytest.approx([0.1, 0.275, 0.275, 0.85, 0.85])


def test_classifier_on_held_out_rows(llm_spark):
    rows = {r.doc_id: r for r in queries.op9_quality_classifier(llm_spark, "/root/testdata/sf0.1").collect()}
    labels = llm_spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()
    held = [(rows[x.doc_id], x.quality) for x in labels if rows[x.doc_id].held_out]
    assert len(held) > 500 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    assert sum(r.predicted == q for r, q in held) / len(held) > 0.95
    assert sum(r.predicted for r, q in held if q) / sum(q for _, q in held) > 0.98


def rising(values, weights):
    """Isotonic regression by its formula: the greatest over starts of the least over ends of the means."""
    n = len(values)
    mean = {(a, b): np.average(values[a : b + 1], weights=weights[a : b + 1]) for a in range(n) for b in range(a, n)}
    return [max(min(mean[a, b] for b in range(i, n)) for a in range(i + 1)) for i in range(n)]


def test_classifier_query_against_one_machine(llm_spark):
    """The registered query against a fit in memory: a least-squares solution and plain isotonic means."""
    docs = llm_spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    labels = {r.doc_id: r.quality for r in llm_spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = {r.doc_id: r for r in queries.op9_quality_classifier(llm_spark, SF).collect()}
    assert len(got) == len(docs)
    x = {r.doc_id: np.array(classifier.statistics(r.text)) for r in docs}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in x}
    train = [i for i in x if i in labels and not held[i]]
    stats = llm_spark.createDataFrame([(i, x[i].tolist()) for i in train], "i long, x array<double>")
    folds = {r.i: r.f for r in stats.select("i", F.pmod(F.xxhash64("x"), F.lit(5)).alias("f")).collect()}
    assert 0 < sum(f == 0 for f in folds.values()) < len(train)
    mean = np.mean([x[i] for i in train], axis=0).round(9)
    scale = np.std([x[i] for i in train], axis=0).round(9)
    scale[scale == 0] = 1
    directions, phases = classifier._basis()

    def features(v):
        z = np.clip((v - mean) / scale, -6, 6)
        return np.concatenate([np.sqrt(2 / len(phases)) * np.cos(z @ directions + phases), 0.1 * z, [1]])

    learn = [i for i in train if folds[i]]
    a, y = np.array([features(x[i]) for i in learn]), np.array([labels[i] for i in learn], float)
    width = a.shape[1]
    ridge = np.sqrt(classifier.RIDGE * len(learn) / width) * np.eye(width)
    weights = np.linalg.lstsq(np.vstack([a, ridge]), np.concatenate([y, np.zeros(width)]), rcond=None)[0]
    raw = {i: round(float(features(v) @ weights), 6) for i, v in x.items()}
    bins = {}
    for i in train:
        if not folds[i]:
            b = min(max(int((raw[i] + 1) / 3 * 2048 // 1), 0), 2047)
            bins.setdefault(b, []).append(labels[i])
    share = np.mean([v for vs in bins.values() for v in vs])
    at = sorted(bins)
    sizes = [len(bins[b]) for b in at]
    levels = rising([(sum(bins[b]) + 1e-3 * share) / (n + 1e-3) for b, n in zip(at, sizes)], sizes)
    for i, r in got.items():
        level = np.interp(raw[i], [-1 + (b + 0.5) * 3 / 2048 for b in at], levels)
        want = 0.999 * level + 0.001 * (min(max(raw[i], -1), 2) + 1) / 3
        assert r.held_out == held[i] and abs(r.score - want) < 2e-3, i
        assert r.predicted == (r.score >= 0.3)


def test_classifier_with_repeated_and_conflicting_rows(llm_spark, odd):
    rows = classifier.featurize(odd, into="hits").withColumn("y", (F.coalesce("doc_id", F.lit(0)) % 2).cast("int"))
    both = rows.union(rows.withColumn("y", 1 - F.col("y"))).union(rows.withColumn("hits", F.lit(None).cast("array<double>")))
    model = classifier.fit(both, "hits", "y")
    scores = [r.label for r in classifier.score(rows, model, "hits", "label").collect()]
    assert all(abs(s - 0.5) < 0.05 for s in scores)


def test_classifier_without_labels(odd):
    found = classifier.featurize(odd, into="hits")
    assert classifier.fit(found.withColumn("none", F.lit(None).cast("int")), "hits", "none") is None
    assert {r.score for r in classifier.score(found, None, "hits").collect()} == {0.5}
    one = classifier.fit(found.withColumn("y", F.lit(1)), "hits", "y")
    scores = classifier.score(found, one, "hits", "label").collect()
    assert len(scores) == odd.count() and all(r.label > 0.9 for r in scores)
    assert classifier.score(found.limit(0), one, "hits").count() == 0
