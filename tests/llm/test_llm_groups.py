"""Operators over pairs, passages and conversations, and the pipeline, against plain loops."""

from __future__ import annotations

import os
import random

import brute
import corpus_pipeline
import duckdb
import public_tokenizers
import pytest
import sentencepiece
from check import rows_of
from conftest import SCHEMA, odd_texts
from pyspark.sql import functions as F

from sparkeval.llm import chat_views, common, deltas, neardup, quality, queries, repeats, secret_scan
from sparkeval.llm.common import TASKS_PER_CORE, fresh
from sparkeval.plans import session


def test_near_groups(llm_spark, near_docs):
    docs = llm_spark.createDataFrame(near_docs, "doc_id long, text string").repartition(5)
    want = brute.near_groups(near_docs)
    assert len({c for _, c in want.values()}) < len(want) - 40
    rows = neardup.groups(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows) and len(rows) == len(near_docs)


def test_crossing_pairs_find_what_pivots_miss(llm_spark, near_docs, monkeypatch):
    """Without the stars the second round alone gives the same groups."""
    monkeypatch.setattr(neardup, "pivot_pairs", lambda lists, own: neardup._ordered(lists.limit(0).selectExpr("node a", "node b"), "a", "b"))
    docs = llm_spark.createDataFrame(near_docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.groups(docs).collect()}
    assert got == brute.near_groups(near_docs)


def test_near_groups_of_odd_rows(odd):
    rows = neardup.groups(odd).collect()
    assert len(rows) == odd.count()
    want = brute.near_groups(list(enumerate(odd_texts())))
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
    assert sum(r.doc_id is None and not r.kept for r in rows) == sum(n > 0 for n, _ in want.values())
    assert neardup.groups(odd.limit(0)).count() == 0


def test_first_of_each(llm_spark, odd, near_docs):
    docs = llm_spark.createDataFrame(near_docs, "doc_id long, text string")
    want = brute.near_groups(near_docs)
    kept = neardup.first_of_each(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c)
    some = neardup.first_of_each(odd)
    assert some.columns == odd.columns
    texts = [r.text for r in some.collect()]
    worded = [t for t in odd_texts() if t and t.split()]
    assert sorted(t for t in texts if t and t.split()) == sorted(worded)
    assert len(texts) == len(worded) + 9  # documents without words all stay
    assert neardup.first_of_each(odd.limit(0)).count() == 0


def least_of_near(docs, percent):
    """The ids that are the least of their component at a share of ``percent``."""
    sets = {i: brute.shingle_set(t) for i, t in docs}
    ids = sorted(sets)
    label = {i: i for i in ids}
    linked = [
        (a, b)
        for k, a in enumerate(ids)
        for b in ids[k + 1 :]
        if sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return {i for i in ids if label[i] == i}


def test_near_duplicates_of_the_pipeline_share_80_percent(llm_spark, near_docs):
    """Copies between 80 and 85 % are near copies in the stage, not in op4."""
    base = [f"s{i}" for i in range(200)]
    edited = list(base)
    for i in range(10, 190, 45):
        edited[i] = f"other{i}"  # 4 edits of 5 shingles: 176 of 216 shared, 81 %
    docs = [*near_docs, (5000, " ".join(base)), (5001, " ".join(edited))]
    df = llm_spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(llm_spark, df, "").collect()}
    want = least_of_near(docs, 80)
    assert got == want and 5001 not in got
    assert want < least_of_near(docs, 85)
    assert {r.doc_id for r in neardup.groups(df, percent=80).filter("kept").collect()} == want
    assert {r.doc_id for r in neardup.groups(df).filter("kept").collect()} == least_of_near(docs, 85)


def test_components_of_a_path_and_a_star(llm_spark):
    node = lambda i: i.to_bytes(4, "big")
    edges = [(node(i), node(i + 1)) for i in range(60)] + [(node(100), node(101 + i)) for i in range(50)]
    links = llm_spark.createDataFrame(edges, "a binary, b binary")
    got = {int.from_bytes(r.node, "big"): int.from_bytes(r.label, "big") for r in neardup.components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 151)}


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(6)
    word = lambda: f"u{rng.randrange(50_000)}"
    shared = [[word() for _ in range(n)] for n in (30, 49, 50, 51, 75, 200)]
    docs = []
    for i in range(60):
        words = [word() for _ in range(rng.randrange(1, 120))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(shared)
            a = rng.randrange(len(p))
            words += p if rng.random() < 0.6 else p[a : a + 60]
            words += [word() for _ in range(rng.randrange(60))]
        docs.append((i, " ".join(words)))
    base = docs[7][1]
    docs += [(100, base), (101, base), (102, base.replace(" ", "\n", 20)), (103, "a b " * 200), (104, "a b " * 150)]
    docs += [(105, " ".join(["same"] * 60)), (106, " ".join(["same"] * 55)), (107, None), (108, ""), (109, base.upper())]
    rng.shuffle(docs)
    return docs


def test_repeats(llm_spark, passages):
    docs = llm_spark.createDataFrame(passages, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.kept.n_words, r.kept.n_removed, r.kept.text) for r in repeats.without_repeats(docs).collect()}
    want = brute.without_repeats(passages)
    assert got == want and sum(n > 0 for _, n, _ in want.values()) > 20


def test_repeats_in_odd_rows(odd):
    done = repeats.without_repeats(odd, into="label")
    assert set(done.columns) == set(odd.columns)
    rows = done.collect()
    assert len(rows) == odd.count()
    want = brute.without_repeats(list(enumerate(odd_texts())))
    for r in rows:
        if r.doc_id is None:
            assert r.label.n_removed == 0
        else:
            assert (r.label.n_words, r.label.n_removed, r.label.text) == want[r.doc_id]
    assert repeats.without_repeats(odd.limit(0)).count() == 0


def test_views(llm_spark):
    rng = random.Random(1)
    rows, said = [], {}
    for conv in (1, 2, 3):
        names = ["ann", "bob", "cy", "system", None][: conv + 2]
        turns = [(rng.choice(names), rng.choice(["hi", "", None, "é😀"]) ) for _ in range(conv * 70)]
        said[conv] = turns
        rows += [(conv, i, r, t, "x") for i, (r, t) in enumerate(turns)]
    rows += rows[:9] + [(None, 0, "ann", "null conversation", "x"), (4, 0, "system", "alone", "x"), (5, None, "ann", "no turn", "x")]
    df = llm_spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, speaker string").repartition(3)
    out = chat_views.views(df).collect()
    assert {r.conv_id for r in out} == {1, 2, 3, None, 5}
    for conv, turns in said.items():
        speakers = {r for r, _ in turns} - {"system", None}
        assert {r.speaker for r in out if r.conv_id == conv} == speakers
        for speaker in speakers:
            parts = sorted((r for r in out if (r.conv_id, r.speaker) == (conv, speaker)), key=lambda r: r.part)
            assert "".join(r.text for r in parts) == brute.view(turns, speaker)[0]
            for r in parts:
                here = turns[r.part * 64 : r.part * 64 + 64]
                assert r.n_turns == len(here) and [tuple(m) for m in r["mask"]] == brute.view(here, speaker)[1]
    assert chat_views.views(df.limit(0)).count() == 0


def test_turns_with_one_number_are_cut(llm_spark):
    rows = [(1, 3, "ann", f"t{i}") for i in range(200)] + [(1, 2, "bob", "before"), (1, 4, "bob", "after")]
    df = llm_spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    out = sorted((r for r in chat_views.views(df, part_rows=20).collect() if r.speaker == "bob"), key=lambda r: (r.part, r.first_turn, r.piece))
    assert sum(r.n_turns for r in out) == 202 and max(r.n_turns for r in out) < 60 and len(out) > 8
    joined = "".join(r.text for r in out)
    whole = "".join(r.text for r in chat_views.views(df).collect() if r.speaker == "bob")
    assert joined == whole


def against_sql(llm_spark, folder, name, **tables):
    """What is wrong with a query over ``tables``, held against its SQL, if anything."""
    con = duckdb.connect()
    for table, df in tables.items():
        df.write.parquet(os.path.join(folder, f"{table}.parquet"))
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = queries.QUERIES[name](llm_spark, str(folder))
    result = con.execute(queries.ORACLE[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(columns, result.fetchall())


def test_chat_query_with_large_parts_and_nulls(llm_spark, tmp_path):
    rng = random.Random(3)
    rows = [(1, i, rng.choice(["ann", "bob", "system"]), f"t{i}") for i in range(150)]
    rows += [(2, rng.choice([5, 6, None]), rng.choice(["ann", "bob", None]), f"u{i}") for i in range(2600)]
    rows += [(None, rng.randrange(200), "cy", rng.choice(["x", None, "é😀"])) for _ in range(300)]
    rows += [(3, 0, "system", "alone"), (4, None, "ann", None), (5, -3, "ann", "before zero")] + rows[:5]
    df = llm_spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").repartition(3)
    against_sql(llm_spark, tmp_path, "op7_chat_formatting", conversations=df)
    out = queries.op7_chat_formatting(llm_spark, str(tmp_path)).filter("conv_id = 2 and speaker = 'ann'").collect()
    assert len({r.piece for r in out}) > 1 and sum(r.n_turns for r in out) == len({r for r in rows if r[0] == 2})


def test_decontamination_query_with_nameless_items(llm_spark, tmp_path):
    docs = [(1, "one two three"), (1, "one two three"), (None, "FOUR five"), (2, None), (3, ""), (4, "six " * 30), (5, "none")]
    items = [(None, "two"), ("a", "four five"), ("b", None), (None, "four"), ("c", " ".join(["six"] * 12)), ("d", "")]
    df = llm_spark.createDataFrame([(*d, 7) for d in docs], "doc_id int, text string, hits int").repartition(2)
    bench = llm_spark.createDataFrame(items, "item_id string, text string")
    queries_rows = {(r.doc_id, r.n_words): r.n_hit for r in _decontaminated(llm_spark, tmp_path, df, bench)}
    assert queries_rows == {(1, 3): 1, (None, 2): 2, (2, 0): 0, (3, 0): 0, (4, 30): 30, (5, 1): 0}


def _decontaminated(llm_spark, folder, docs, benchmark):
    unique = docs.distinct().filter("doc_id is not null")
    against_sql(llm_spark, str(folder / "unique"), "op8_decontamination", documents=unique, benchmark=benchmark)
    for name, df in (("documents", docs), ("benchmark", benchmark)):
        df.write.parquet(str(folder / f"{name}.parquet"))
    return queries.op8_decontamination(llm_spark, str(folder)).collect()


def test_fresh_names(odd):
    assert fresh(odd, "_KEY") == "__KEY" and fresh(odd, "other") == "other"


def test_pipeline(llm_spark, tmp_path):
    """All stages against loops, on documents with every kind of fault."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    clean = lambda: " ".join(rng.sample(words, 120))
    docs = [clean() for _ in range(12)]
    docs += [docs[0], docs[1] + " more", "short", "again and again " * 60, None, ""]
    question = " ".join(f"q{i}" for i in range(14))
    docs += [clean() + " " + question, clean() + " password = hunter22x and é", clean() + "\n日本 \x00"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(docs)]
    d = str(tmp_path)
    llm_spark.createDataFrame(rows, SCHEMA).write.parquet(os.path.join(d, "documents.parquet"))
    llm_spark.createDataFrame([(1, question), (2, None)], "item_id int, text string").write.parquet(os.path.join(d, "benchmark.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(llm_spark, d).collect()}

    good = [(i, t) for i, t in enumerate(docs) if not quality.measure_text(t)[0] < 50 and not brute.base_failed(brute.measures(t))]
    groups = brute.near_groups(good)
    good = [(i, t) for i, t in good if groups[i][1] == i and not brute.contamination(t, [(1, question)])[1]]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {i: library.encode(secret_scan.redact_text(t, secret_scan.scan(t), "[secret]")) for i, t in good}
    assert {i: r["ids"] for i, r in got.items()} == want
    assert all(r.exact and r.n_tokens == len(r["ids"]) for r in got.values())
    assert set(got) == {*range(12), 19, 20}
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline_of_nothing(llm_spark, tmp_path):
    d = str(tmp_path)
    llm_spark.createDataFrame([], SCHEMA).write.parquet(os.path.join(d, "documents.parquet"))
    llm_spark.createDataFrame([], "item_id int, text string").write.parquet(os.path.join(d, "benchmark.parquet"))
    assert corpus_pipeline.run(llm_spark, d).count() == 0


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries_give_a_row_per_document(llm_spark, name):
    """On the smallest tables; those with SQL are compared with it."""
    import check

    import __spark_entry__ as entry

    d = "/root/testdata/sf0.001"
    df = entry.queries()[name](llm_spark, d)
    assert check.compare(df, check.database(d), name) is None
    if "doc_id" in df.columns:
        assert df.count() == 200


def edited_copies(n, most, seed, least=0):
    """Copies of one text of 150 words, each with ``least`` to ``most`` words replaced."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(150)]
    docs = []
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(150), rng.randint(least, most)):
            words[at] = f"e{rng.randrange(40_000)}"
        docs.append((i, " ".join(words)))
    return docs


def test_copies_without_a_common_original(llm_spark):
    """Every copy has edits of its own, so no class is the middle of the group."""
    docs = edited_copies(300, 8, 7, least=2)
    df = llm_spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in neardup.groups(df, percent=80).filter("kept").collect()}
    assert kept == least_of_near(docs, 80)


@pytest.mark.parametrize("percent", [80, 85])
def test_pairs_of_a_large_near_group_grow_with_its_size(llm_spark, monkeypatch, percent):
    """No link is lost in a group of edited copies, and twice the copies make fewer than 2.5 times the
    pairs that are compared."""
    met = []
    confirmed = neardup.confirmed

    def counted(pairs, sets, share):
        done = pairs.cache()
        met.append(done.count())
        return confirmed(done, sets, share)

    monkeypatch.setattr(neardup, "confirmed", counted)
    made = []
    for n in (300, 600):
        met.clear()
        docs = edited_copies(n, 8, 7)
        df = llm_spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
        kept = {r.doc_id for r in neardup.groups(df, percent=percent).filter("kept").collect()}
        if n == 300:
            assert kept == least_of_near(docs, percent)
        made.append(sum(met))
    assert made[1] < 2.5 * made[0], made


def test_steps_between_near_duplicates_need_no_python(llm_spark):
    """Sets and signatures are compared by Spark's own expressions, with the results of sets of Python's."""
    rng = random.Random(9)
    sets = {bytes([i]) * 16: rng.sample(range(-40, 40), rng.randrange(30, 70)) for i in range(24)}
    values = {n: [rng.randrange(2) for _ in range(neardup.COORDINATES)] for n in sets}
    rows = [(n, len(s), s, values[n]) for n, s in sets.items()]
    df = llm_spark.createDataFrame(rows, "node binary, n long, hashes array<long>, signature array<long>")
    pairs = [(a, b) for a in sets for b in sets if a < b]
    met = llm_spark.createDataFrame(pairs, "a binary, b binary")
    linked = neardup.confirmed(met, df.select("node", "hashes"), 60)
    agreeing = neardup.agreeing_pairs(met, df, 17, 60)
    own = neardup.own_shingles(df.select("node", "hashes"))
    apart = df.filter(F.size("hashes") > 60).select("node", deltas._exclusive("hashes", F.sequence(F.lit(0), F.lit(29)).cast("array<long>")).alias("d"))
    for found in (linked, agreeing, own, apart):
        assert "MapInArrow" not in found._jdf.queryExecution().toString()
    share = lambda a, b: (len({*sets[a]} & {*sets[b]}), len({*sets[a]} | {*sets[b]}))
    close = {(a, b) for a, b in pairs if 100 * share(a, b)[0] >= 60 * share(a, b)[1]}
    assert {(bytes(r.a), bytes(r.b)) for r in linked.collect()} == close and 0 < len(close) < len(pairs)
    alike = {
        (a, b)
        for a, b in pairs
        if sum(x == y for x, y in zip(values[a], values[b])) >= 17
        and 100 * min(len(sets[a]), len(sets[b])) >= 60 * max(len(sets[a]), len(sets[b]))
    }
    assert {(bytes(r.a), bytes(r.b)) for r in agreeing.collect()} == alike and 0 < len(alike) < len(pairs)
    others = lambda n: {x for m, s in sets.items() if m != n for x in s}
    assert {bytes(r.node): r.own for r in own.collect()} == {n: len({*s} - others(n)) for n, s in sets.items()}
    assert {bytes(r.node): {*r.d} for r in apart.collect()} == {n: {*s} ^ {*range(30)} for n, s in sets.items() if len(s) > 60}


def test_near_duplicates_store_small_tables_in_few_files(llm_spark, near_docs, monkeypatch):
    """However many partitions shuffles have, a table between the steps has a few files for each core."""
    most = TASKS_PER_CORE * llm_spark.sparkContext.defaultParallelism
    held = {"spark.sql.shuffle.partitions": str(most + 8), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: llm_spark.conf.get(k) for k in held}
    docs = llm_spark.createDataFrame(near_docs[:60], "doc_id long, text string").repartition(2)
    tables = []
    kept = session.materialize

    def noted(df, name="table"):
        tables.append((name, kept(df, name)))
        return tables[-1][1]

    for module in (neardup, deltas, common):
        monkeypatch.setattr(module, "materialize", noted, raising=False)
    for k, v in held.items():
        llm_spark.conf.set(k, v)
    try:
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.groups(docs).collect()}
    finally:
        for k, v in before.items():
            llm_spark.conf.set(k, v)
    assert got == brute.near_groups(near_docs[:60])
    files = {name: len(df.inputFiles()) for name, df in tables}
    assert len(files) > 5 and max(files.values()) <= most, files
