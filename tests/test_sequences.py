"""Arrays, vocabulary, batches, prompts and chats."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from pyspark.sql import functions as F

from bindings import sequences as bound
from sparkeval.functions import prompts as P
from sparkeval.functions import sequences as A
from sparkeval.operators import chat as C
from sparkeval.operators import sequences as S
from sparkeval.operators.distillation import assemble, collate_prompts, prompt_pairs, with_reasoning
from sparkeval.plans.session import materialize
from sparkeval.registry import collate_with


def one(spark, column, ids=(5, 6, 0, 7, 8, 0)):
    df = spark.createDataFrame([(list(ids),)], "ids array<int>")
    return df.select(column).first()[0]


def test_labels_and_masks(spark):
    assert one(spark, A.labels("ids", F.lit(2))) == [-100, -100, -100, 7, 8, -100]
    assert one(spark, A.mask_pads("ids")) == [5, 6, -100, 7, 8, -100]
    assert one(spark, A.attention_mask("ids")) == [1, 1, 0, 1, 1, 0]
    assert one(spark, A.drop_ids("ids", [0, 7])) == [5, 6, 8]


def test_lengths(spark):
    assert one(spark, A.truncate("ids", 2)) == [5, 6]
    assert one(spark, A.fix_length("ids", 3)) == [5, 6, 0]
    assert one(spark, A.fix_length("ids", 8, 9)) == [5, 6, 0, 7, 8, 0, 9, 9]
    assert one(spark, A.fix_length("ids", 2), ()) == [0, 0]
    assert one(spark, A.pad_to("ids", F.lit(8), 1, "left"))[:3] == [1, 1, 5]
    assert one(spark, A.pad_to("ids", F.lit(3))) == [5, 6, 0, 7, 8, 0]
    assert one(spark, A.after_prompt("ids", F.lit(4))) == [8, 0]
    assert one(spark, A.after_prompt("ids", F.lit(0)), ()) == []
    with pytest.raises(ValueError):
        A.pad_to("ids", F.lit(3), side="top")


def test_padding_is_undone_by_slicing(spark):
    rng = random.Random(1)
    rows = [([rng.randrange(1, 9) for _ in range(rng.randrange(9))],) for _ in range(200)]
    df = spark.createDataFrame(rows, "ids array<int>")
    back = F.slice(A.pad_to("ids", F.lit(12)), F.lit(1), F.size("ids"))
    assert df.filter(back != F.col("ids")).count() == 0


def test_prompt_budget(spark):
    df = spark.createDataFrame([(100, 30), (20, 30), (None, 30), (0, 30)], "m int, c int")
    assert [r[0] for r in df.select(A.prompt_budget("m", "c")).collect()] == [70, 1, None, None]


TEXTS = {1: "the cat the dog", 2: "", 3: "dog\tthe\n  bird ", 4: " " + "the " * 500}


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(list(TEXTS.items()), "doc long, text string")


def test_vocabulary(spark, corpus):
    vocab = {r.token: r for r in S.build_vocab(corpus, "text").collect()}
    assert {t: r.n for t, r in vocab.items()} == {"the": 503, "dog": 2, "cat": 1, "bird": 1}
    assert sorted(r.id for r in vocab.values()) == [2, 3, 4, 5]
    assert {r.token for r in S.build_vocab(corpus, "text", 2).collect()} == {"the", "dog"}


@pytest.mark.parametrize("head", [50_000, 1, 0])
def test_encode(spark, corpus, head):
    vocab = S.build_vocab(corpus, "text", 2)
    ids = {r.token: r.id for r in vocab.collect()}
    got = {r.doc: r.ids for r in S.encode(corpus, "doc", "text", vocab, 1, head=head).collect()}
    assert got == {d: [ids.get(w, 1) for w in t.split()] for d, t in TEXTS.items()}


@pytest.mark.parametrize("rows_per_range", [10**6, 3])
def test_batches(spark, rows_per_range):
    df = spark.range(10).select((F.col("id") * 7).alias("o"))
    got = S.assign_batch(df, 4, "o", rows_per_range=rows_per_range).orderBy("o").collect()
    assert [(r.batch_id, r.batch_pos) for r in got] == [(i // 4, i % 4) for i in range(10)]
    assert S.effective_batch(2, 2, 8) == 32


@pytest.mark.parametrize("rows_per_salt", [10**6, 2])
def test_collate(spark, rows_per_salt):
    rows = [(1, 0, [1, 2, 3, 4]), (2, 0, [5]), (3, 1, []), (4, 0, [6, 7])]
    df = spark.createDataFrame(rows, "doc int, batch_id int, ids array<int>")
    out = S.collate(df, "ids", 3, spread=["doc"], rows_per_salt=rows_per_salt)
    got = {r.doc: (r.ids, r.length, r.attention_mask) for r in out.collect()}
    assert got == {
        1: ([1, 2, 3], 3, [1, 1, 1]),
        2: ([5, 0, 0], 1, [1, 0, 0]),
        3: ([], 0, []),
        4: ([6, 7, 0], 2, [1, 1, 0]),
    }


def test_user_collator(spark):
    df = spark.createDataFrame([(0, 1), (0, 2), (1, 5)], "batch_id int, x int")
    out = collate_with(df, lambda pdf: pdf.groupby("batch_id", as_index=False).x.sum(), "batch_id int, x long")
    assert sorted(tuple(r) for r in out.collect()) == [(0, 3), (1, 5)]


def test_statistics(spark):
    df = spark.createDataFrame([([1, 2],), ([3],)], "ids array<int>")
    row = S.generation_stats(df, "ids", 2.0).first()
    assert (row.num_prompts, row.total_tokens, row.avg_length, row.tokens_per_sec) == (2, 3, 1.5, 1.5)
    empty = S.generation_stats(df.limit(0), "ids", 0.0).first()
    assert (empty.num_prompts, empty.total_tokens, empty.avg_length, empty.tokens_per_sec) == (0, 0, 0, 0)


def test_alignment(spark):
    scores = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c")], "seq_id int, pos int, s string")
    ids = spark.createDataFrame([(1, 0, 10), (1, 1, 11), (1, 2, 12)], "seq_id int, pos int, id int")
    got = sorted((r.pos, r.s, r.id) for r in S.align_next(scores, ids).collect())
    assert got == [(1, "a", 11), (2, "b", 12)]


# Wording of the prompts, written out.
TAIL = "Please reason step by step, and put your final answer within \\boxed{}."
MOVE = (
    "\n\nAfter understanding the reference solution and the rationale behind each step, now articulate your "
    "own step-by-step reasoning that derives the same final answer to the problem below:\n"
)


def test_prompts(spark):
    df = spark.createDataFrame([("P?", "S!")], "p string, s string")
    row = df.select(
        P.sft_text("p", "s"),
        P.grpo_prompt("p"),
        P.student_prompt("p"),
        P.teacher_prompt("p", "s"),
        P.reasoning_prompt("p", "s"),
        P.teacher_context("p", "s"),
        P.eval_prompt("p"),
        P.teacher_prompt_by_mode("p", "s", F.lit(True)),
        P.preview("p", 1),
    ).first()
    assert row[0] == "Problem: P?\nSolution: S!"
    assert row[1] == f"Problem: P?\n {TAIL}"
    assert row[2] == f"Problem: P?\n\n{TAIL}"
    assert row[3] == f"P?\n\nHere is a reference solution to this problem:\nS!\n{MOVE}\n{TAIL}"
    assert row[4].startswith(
        "Problem: P?\n\nHere is a correct reasoning to this problem:=== Reference Reasoning Start ===\nS!\n"
        "=== Reference Reasoning End ===\n\n\n\nThe reference reasoning above arrives at the correct answer. "
    )
    assert row[4].endswith("Simply analyze and explain the reference solution provided above.\n")
    assert row[5] == f"P?S!\n{MOVE}\n{TAIL}"
    assert row[6] == f"P?\n\n{TAIL}"
    assert row[7:] == ("", "P")


def test_strip_special(spark):
    df = spark.createDataFrame([("<s>a<s>|b.*c",)], "t string")
    assert df.select(P.strip_special("t", ["<s>", "<s>|", ".*"])).first()[0] == "abc"
    assert df.select(P.strip_special("t", [])).first()[0] == "<s>a<s>|b.*c"


def test_chat(spark):
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(7)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(5)
    whole = C.render_chat(df, prefix="<{role}>", suffix="\n", generation_prompt="<go>").first().rendered
    assert whole == "".join(f"<{r}>{t}\n" for _, _, r, t in turns) + "<go>"
    parts = C.render_chat(df, prefix="<{role}>", suffix="\n", generation_prompt="<go>", part_size=3)
    rows = parts.orderBy("part").collect()
    assert len(rows) == 3 and "".join(r.rendered for r in rows) == whole
    quiet = C.render_chat(df, enable_thinking=False).first().rendered
    assert quiet.endswith("assistant\n<think>\n\n</think>\n\n")
    assert [(r.prompt, r.completion) for r in C.exchanges(df).orderBy("turn").collect()] == [
        ("t0", "t1"), ("t2", "t3"), ("t4", "t5")
    ]


def test_distillation_batch(spark):
    corpus = spark.createDataFrame(
        [(1, "one two", "three"), (2, "two", "three four")], "k long, problem string, solution string"
    )
    pairs = prompt_pairs(corpus, "k").orderBy("k").collect()
    assert pairs[0].student.startswith("<|im_start|>user\nProblem: one two\n\nPlease reason")
    assert "Here is a reference solution to this problem:\nthree\n" in pairs[0].teacher
    assert pairs[0].teacher.endswith("<|im_end|>\n<|im_start|>assistant\n")
    analysed = prompt_pairs(corpus, "k", reason_first=True).first().teacher
    assert "=== Reference Reasoning Start ===\nthree\n" in analysed

    texts = spark.createDataFrame([(1, "a b c d", "a a a"), (2, "b", "d c")], "k long, student string, teacher string")
    vocab = spark.createDataFrame([(w, 1, i) for i, w in enumerate("abcd", 2)], "token string, n long, id int")
    replies = spark.createDataFrame([(1, [9, 9, 9]), (2, [7])], "k long, reply array<int>")
    encoded = S.encode(texts, "k", ["student", "teacher"], vocab).withColumn("batch_id", F.lit(0))
    prompts = collate_prompts(encoded.join(replies, "k"), max_length=3)
    row = prompts.filter("k = 2").first()
    assert (row.student_prompts, row.student_prompt_length) == ([3, 0, 0], 3)
    assert (row.teacher_prompts, row.teacher_prompt_lengths_per_example) == ([5, 4, 0], 2)
    assert row.teacher_prompt_attention_mask == [1, 1, 0]
    full = {r.k: r for r in assemble(prompts, "reply", 2, ["k", "batch_id"]).collect()}
    assert full[1].student_input_ids == [2, 3, 4, 9, 9] and full[1].labels == [-100, -100, -100, 9, 9]
    assert full[2].student_input_ids == [3, 0, 0, 7, 0] and full[2].labels == [-100, -100, -100, 7, -100]
    assert full[2].teacher_input_ids == [5, 4, 0, 7, 0]
    assert full[2].teacher_attention_mask == [1, 1, 0, 1, 0]
    reasoned = with_reasoning(
        prompts.withColumns({"reasoning": F.array(F.lit(8)), "transition": F.array(F.lit(6), F.lit(6))}), max_reasoning=2
    )
    long = {r.k: r for r in assemble(reasoned, "reply", 2, ["k"]).collect()}
    assert long[2].teacher_input_ids == [5, 4, 0, 8, 0, 6, 6, 7, 0]
    assert long[2].teacher_attention_mask == [1, 1, 0, 1, 0, 1, 1, 1, 0]
    assert long[2].student_input_ids == full[2].student_input_ids and long[2].labels == full[2].labels


def test_reasoning_is_kept_whole(spark):
    """Reasoning of any length, padded to the longest of its batch; a given length still holds."""
    rows = [(1, 0, [5], list(range(10, 1510))), (2, 0, [5], [8]), (3, 1, [4, 0], [9, 9])]
    prompts = spark.createDataFrame(rows, "k int, batch_id int, teacher_prompts array<int>, reasoning array<int>")
    prompts = prompts.withColumn("transition", F.array(F.lit(6)))
    got = {r.k: r for r in with_reasoning(prompts).collect()}
    assert got[1].teacher_prompts == [5, *range(10, 1510), 6]
    assert got[2].teacher_prompts == [5, 8, *[0] * 1499, 6]
    assert got[2].teacher_prompt_attention_mask == [1, 1, *[0] * 1499, 1]
    assert (got[3].teacher_prompts, got[3].teacher_prompt_length) == ([4, 0, 9, 9, 6], 5)
    cut = {r.k: r.teacher_prompts for r in with_reasoning(prompts, max_reasoning=3).collect()}
    assert cut[1] == [5, 10, 11, 12, 6] and cut[2] == [5, 8, 0, 0, 6]


def test_distillation_shuffles(spark):
    """All sides in one pass: few exchanges, whatever the number of texts."""
    import __spark_entry__ as entry

    df = entry.queries()["distillation_batch"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") < 10


ODD = [None, "", " \t\n\r ", "one", "a\x0bb a\x0cb é\xa0é", "two  two\ttwo\n", "x" * 70 + " one", "\n".join("w%d the" % (i % 40) for i in range(900))]


@pytest.mark.parametrize("head", [50_000, 3])
def test_words_are_looked_up_without_a_row_each(spark, head):
    """Frequent words never become rows, which would be joined and grouped again."""
    df = spark.createDataFrame(list(enumerate(ODD)), "k int, text string").repartition(3)
    vocab = materialize(S.build_vocab(df, "text"))
    words = {k: [w for w in re.split("[ \t\n\r]+", t or "") if w] for k, t in enumerate(ODD)}
    counts = Counter(w for ws in words.values() for w in ws)
    rows = vocab.collect()
    assert {r.token: r.n for r in rows} == counts
    ids = {r.token: r.id for r in rows}
    encoded = S.encode(df, "k", "text", vocab, head=head)
    assert {r.k: r.ids for r in encoded.collect()} == {k: [ids[w] for w in ws] for k, ws in words.items()}
    assert "split(" not in encoded._jdf.queryExecution().toString()


def test_collate_query(spark, tmp_path):
    """The text of padded ids and masks, also of rows that are pads only and of a batch without words."""
    texts = [*ODD, *["the " * 2050, "b a"] * 12, *[None, " "] * 16]
    docs = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    ids = {r.token: r.id for r in S.build_vocab(df, "text").collect()}
    cut = [[ids[w] for w in re.split("[ \t\n\r]+", t or "") if w][:2048] for t in texts]
    want = {}
    for i, row in enumerate(cut):
        longest = max(map(len, cut[i // 32 * 32 : i // 32 * 32 + 32]))
        pads = longest - len(row)
        want[i] = (i // 32, len(row), " ".join(map(str, row + [0] * pads)), "1" * len(row) + "0" * pads)
    got = bound.collated(spark, str(tmp_path))
    assert {r.doc_id: (r.batch_id, r.length, r.ids, r.attention_mask) for r in got.collect()} == want
    lambdas = got._jdf.queryExecution().optimizedPlan().toString().count("lambda")
    assert lambdas == 0  # ids and masks leave without a function call for each pad


def test_mask_of_rows_without_ids(spark):
    df = spark.createDataFrame([(1, 0, [5, 6]), (2, 0, None), (3, 1, None)], "doc int, batch_id int, ids array<int>")
    got = {r.doc: (r.ids, r.attention_mask) for r in S.collate(df, "ids", 9).collect()}
    assert got == {1: ([5, 6], [1, 1]), 2: (None, [None, None]), 3: (None, [])}
