"""Chat messages, prompt-completion sequences and generation logs over conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindings import Bindings
from bindings.tables import encoded_sql, ids_sql, joined_ids, quote, table, vocab_sql
from sparkeval.functions import prompts as P
from sparkeval.functions import sequences as S
from sparkeval.functions.prompts import strip_special
from sparkeval.operators.chat import exchanges, render_chat
from sparkeval.operators.distillation import (
    assemble,
    collate_prompts,
    prompt_pairs,
    with_reasoning,
)
from sparkeval.operators.selection import dedup_first, last_n, sample_exact
from sparkeval.operators.sequences import align_next, assign_batch, build_vocab, encode
from sparkeval.operators.telemetry import generation_log, generation_log_files
from sparkeval.plans.session import materialize, spread, work_dir
from sparkeval.sources.sinks import generation_log_sink, write_generation_log
from sparkeval.streaming.tables import start

B = Bindings()
FIXED = 64
TURNS = 4_294_967_296  # more than the turns of any conversation: seq = conv_id * TURNS + turn

EXCHANGES = """pairs AS (
  SELECT q.conv_id, q.turn, q.conv_id * 4294967296 + q.turn AS seq, q.text AS prompt,
         a.text AS completion
  FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
  WHERE q.role = 'user' AND a.role = 'assistant')"""
SEQUENCES = f"""WITH {vocab_sql('conversations')},
{EXCHANGES},
{encoded_sql('prompts', 'pairs', 'seq', 'prompt')},
{encoded_sql('answers', 'pairs', 'seq', 'completion')},
sequences AS (
  SELECT seq, p.ids AS prompt, a.ids AS completion, list_concat(p.ids, a.ids) AS ids, len(p.ids) AS plen
  FROM prompts p JOIN answers a USING (seq))"""


def pairs(spark: SparkSession, d: str) -> DataFrame:
    turns = spread(table(spark, d, "conversations"), "conv_id", "turn")
    return exchanges(turns).withColumn("seq", F.col("conv_id") * TURNS + F.col("turn"))


def sequences(spark: SparkSession, d: str) -> DataFrame:
    """(seq, prompt, completion) as ids of one vocabulary."""
    vocab = materialize(build_vocab(table(spark, d, "conversations"), "text"), "vocab")
    rows = pairs(spark, d)
    return encode(rows, "seq", ["prompt", "completion"], vocab)


@B.add(
    "chat_render",
    """SELECT conv_id, CAST(0 AS INTEGER) AS part,
  string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn)
    || '<|im_start|>assistant' || chr(10) AS rendered
FROM conversations GROUP BY conv_id""",
)
def chat_render(spark, d):
    return render_chat(table(spark, d, "conversations"))


@B.add(
    "strip_special",
    """SELECT conv_id, CAST(0 AS INTEGER) AS part,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) || 'assistant' || chr(10) AS plain
FROM conversations GROUP BY conv_id""",
)
def stripped(spark, d):
    chats = render_chat(table(spark, d, "conversations"))
    plain = strip_special("rendered", ["<|im_start|>", "<|im_end|>"])
    return chats.select("conv_id", "part", plain.alias("plain"))


@B.add("concat_seq", f"{SEQUENCES} SELECT seq, {ids_sql('ids')} AS ids FROM sequences")
def concat_seq(spark, d):
    ids = S.concat_ids("prompt", "completion")
    return sequences(spark, d).select("seq", joined_ids(ids).alias("ids"))


@B.add(
    "make_labels",
    f"""{SEQUENCES} SELECT seq, {ids_sql('list_transform(ids, lambda x, i: CASE WHEN i <= plen THEN -100 ELSE x END)')}
  AS labels FROM sequences""",
)
def make_labels(spark, d):
    made = S.labels(S.concat_ids("prompt", "completion"), F.size("prompt"))
    return sequences(spark, d).select("seq", joined_ids(made).alias("labels"))


@B.add(
    "fix_length",
    f"{SEQUENCES} SELECT seq, {ids_sql(f'list_resize(completion, {FIXED}, 0)')} AS ids FROM sequences",
)
def fix_length(spark, d):
    return sequences(spark, d).select("seq", joined_ids(S.fix_length("completion", FIXED)).alias("ids"))


@B.add("slice_completion", f"{SEQUENCES} SELECT seq, {ids_sql('completion')} AS ids FROM sequences")
def slice_completion(spark, d):
    rest = S.after_prompt(S.concat_ids("prompt", "completion"), F.size("prompt"))
    return sequences(spark, d).select("seq", joined_ids(rest).alias("ids"))


@B.add(
    "prompt_budget",
    f"""{SEQUENCES} SELECT seq, CASE WHEN plen < 10 THEN NULL
  ELSE greatest(1, 200 - len(completion)) END AS budget FROM sequences""",
)
def prompt_budget(spark, d):
    limit = F.when(F.size("prompt") >= 10, 200)
    budget = S.prompt_budget(limit, F.size("completion")).cast("long")
    return sequences(spark, d).select("seq", budget.alias("budget"))


@B.add(
    "shift_align",
    f"""{SEQUENCES}, cells AS (
  SELECT seq, unnest(ids) AS id, generate_subscripts(ids, 1) - 1 AS pos FROM sequences)
SELECT b.seq, b.pos, a.id * 2 AS score, b.id AS token_id
FROM cells a JOIN cells b ON b.seq = a.seq AND b.pos = a.pos + 1""",
)
def shift_align(spark, d):
    ids = S.concat_ids("prompt", "completion")
    cells = sequences(spark, d).select("seq", F.posexplode(ids).alias("pos", "id"))
    cells = materialize(cells.withColumn("pos", F.col("pos").cast("long")), "cells")
    scores = cells.select("seq", "pos", (F.col("id") * 2).alias("score"))
    tokens = cells.select("seq", "pos", F.col("id").alias("token_id"))
    return align_next(scores, tokens, "seq").select("seq", "pos", "score", "token_id")


# Distillation batches -------------------------------------------------------------------------------

BATCH, LONGEST, REPLY = 8, 2048, 1024


def chat_sql(text: str) -> str:
    return f"""'<|im_start|>user' || chr(10) || {text} || '<|im_end|>' || chr(10) || '<|im_start|>assistant'
    || chr(10)"""


STUDENT = f"'Problem: ' || prompt || chr(10) || chr(10) || {quote(P.INSTRUCTION)}"
TEACHER = f"prompt || {quote(P.SOLUTION_START)} || completion || {quote(P.TRANSITION_SUFFIX)}"


def padded_sql(ids: str, size: str) -> str:
    return f"list_resize({ids}[1:{LONGEST}], {size}, 0)"


BATCHED = f"""WITH {vocab_sql('conversations')},
{EXCHANGES},
rendered AS (
  SELECT seq, {chat_sql(STUDENT)} AS student, {chat_sql(TEACHER)} AS teacher, completion FROM pairs),
{encoded_sql('students', 'rendered', 'seq', 'student')},
{encoded_sql('teachers', 'rendered', 'seq', 'teacher')},
{encoded_sql('answers', 'rendered', 'seq', 'completion')},
batched AS (
  SELECT seq, (row_number() OVER (ORDER BY seq) - 1) // {BATCH} AS batch_id, s.ids AS s, t.ids AS t,
         list_resize(a.ids, {REPLY}, 0) AS c, least(len(s.ids), {LONGEST}) AS slen,
         least(len(t.ids), {LONGEST}) AS tlen
  FROM students s JOIN teachers t USING (seq) JOIN answers a USING (seq)),
sized AS (
  SELECT *, max(slen) OVER (PARTITION BY batch_id) AS smax, max(tlen) OVER (PARTITION BY batch_id) AS tmax
  FROM batched),
joined AS (
  SELECT seq, batch_id, slen, list_concat({padded_sql('s', 'smax')}, c) AS sids,
         list_concat({padded_sql('t', 'tmax')}, c) AS tids FROM sized)"""


ASKED = f"""'Problem: ' || prompt || {quote(chr(10) * 2 + P.REASONING_START)} || completion
    || {quote(P.REASONING_END + P.ANALYSE)}"""
REASONED = (
    BATCHED.replace(chat_sql(TEACHER) + " AS teacher, completion", chat_sql(ASKED) + f" AS teacher, completion, {quote(P.TRANSITION_SUFFIX)} AS transition")
    .replace("batched AS (", f"{encoded_sql('transitions', 'rendered', 'seq', 'transition')},\nbatched AS (")
    .replace(f"list_resize(a.ids, {REPLY}, 0) AS c", f"list_resize(a.ids, {REPLY}, 0) AS c, a.ids AS r, x.ids AS x")
    .replace("JOIN answers a USING (seq))", "JOIN answers a USING (seq) JOIN transitions x USING (seq))")
    .replace("AS tmax", "AS tmax, max(len(r)) OVER (PARTITION BY batch_id) AS rmax")
    .replace(
        f"list_concat({padded_sql('t', 'tmax')}, c) AS tids",
        f"list_concat(list_concat({padded_sql('t', 'tmax')}, list_concat(list_resize(r, rmax, 0), x)), c) AS tids",
    )
)


@B.add(
    "distillation_batch",
    f"""{BATCHED} SELECT seq, batch_id, {ids_sql('sids')} AS student_input_ids,
  {ids_sql('tids')} AS teacher_input_ids,
  {ids_sql('list_transform(tids, lambda x: CASE WHEN x = 0 THEN 0 ELSE 1 END)')} AS teacher_attention_mask,
  {ids_sql('list_transform(sids, lambda x, i: CASE WHEN i <= slen OR x = 0 THEN -100 ELSE x END)')} AS labels
FROM joined""",
)
def distillation_batch(spark, d):
    """User turns as problems, the replies as solutions and as completions."""
    prompts = collate_prompts(distillation_rows(spark, d), LONGEST)
    return distilled(assemble(prompts, "completion", REPLY, ["seq", "batch_id"]))


def distillation_rows(spark: SparkSession, d: str, reason_first: bool = False) -> DataFrame:
    """(seq, batch_id, student, teacher, completion, transition) as ids, from one pass over all texts."""
    vocab = materialize(build_vocab(table(spark, d, "conversations"), "text"), "vocab")
    rows = pairs(spark, d)
    corpus = rows.select(
        "seq", F.col("prompt").alias("problem"), F.col("completion").alias("solution"), "completion"
    )
    transition = F.lit(P.TRANSITION_SUFFIX)
    texts = prompt_pairs(corpus, "seq", reason_first, ["completion"]).withColumn("transition", transition)
    ids = encode(texts, "seq", ["student", "teacher", "completion", "transition"], vocab)
    return assign_batch(materialize(ids, "encoded"), BATCH, "seq").drop("batch_pos")


@B.add(
    "distillation_batch_reasoning",
    f"""{REASONED} SELECT seq, batch_id, {ids_sql('sids')} AS student_input_ids,
  {ids_sql('tids')} AS teacher_input_ids,
  {ids_sql('list_transform(tids, lambda x: CASE WHEN x = 0 THEN 0 ELSE 1 END)')} AS teacher_attention_mask,
  {ids_sql('list_transform(sids, lambda x, i: CASE WHEN i <= slen OR x = 0 THEN -100 ELSE x END)')} AS labels
FROM joined""",
)
def distillation_batch_reasoning(spark, d):
    """The teacher reasons first; here the reply, whole, stands for its reasoning too."""
    prompts = collate_prompts(distillation_rows(spark, d, reason_first=True), LONGEST)
    reasoned = with_reasoning(prompts, "completion", "transition")
    return distilled(assemble(reasoned, "completion", REPLY, ["seq", "batch_id"]))


def distilled(out: DataFrame) -> DataFrame:
    columns = ["student_input_ids", "teacher_input_ids", "teacher_attention_mask", "labels"]
    return out.select("seq", "batch_id", *[joined_ids(c).alias(c) for c in columns])


# Generation logs -----------------------------------------------------------------------------------


def records(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select(F.col("conv_id").alias("step"), "seq", "prompt", "completion")


LOG = f"""WITH {EXCHANGES}, flushed AS (
  SELECT conv_id AS step, seq, prompt, completion,
         CAST(greatest(ceil(conv_id / 5.0) * 5, 5) AS BIGINT) AS flush_step FROM pairs),
log AS (
  SELECT *, row_number() OVER (PARTITION BY flush_step ORDER BY seq) - 1 AS place FROM flushed)"""


@B.add("gen_log", f"{LOG} SELECT flush_step, place, step, seq, prompt, completion FROM log")
def gen_log(spark, d):
    return generation_log(records(spark, d))


@B.add(
    "gen_log_files",
    f"""{LOG} SELECT flush_step, CAST(0 AS BIGINT) AS part, count(*) AS num_samples,
  string_agg(step || '|' || prompt || '|' || completion, ';' ORDER BY place) AS generations
FROM log GROUP BY flush_step""",
)
def gen_log_files(spark, d):
    """Writes one folder per flush and reads the JSON back."""
    path = work_dir(spark, "generations")
    write_generation_log(generation_log_files(generation_log(records(spark, d))), path)
    back = spark.read.json(path)
    record = lambda g: F.concat_ws("|", g["step"].cast("string"), g["prompt"], g["completion"])
    return back.select(
        F.col("flush_step").cast("long").alias("flush_step"),
        "part",
        "num_samples",
        F.array_join(F.transform("generations", record), ";").alias("generations"),
    )


@B.add(
    "stream_gen_log",
    f"""{LOG} SELECT flush_step, count(*) AS num_samples,
  string_agg(step || '|' || prompt || '|' || completion, ';' ORDER BY step || '|' || prompt || '|' || completion)
    AS generations
FROM log GROUP BY flush_step""",
)
def stream_gen_log(spark, d):
    """The same log from a stream: nested files per micro-batch, whose parts add up."""
    path, arrivals = work_dir(spark, "stream-generations"), work_dir(spark, "arrivals")
    rows = records(spark, d)
    rows.write.parquet(arrivals)
    stream = spark.readStream.schema(rows.schema).parquet(arrivals)
    start(stream, f"{path}/run", generation_log_sink(f"{path}/log"), "append").awaitTermination()
    record = lambda g: F.concat_ws("|", g["step"].cast("string"), g["prompt"], g["completion"])
    parts = spark.read.json(f"{path}/log")
    all_records = F.array_sort(F.flatten(F.collect_list(F.transform("generations", record))))
    parts = parts.groupBy(F.col("flush_step").cast("long").alias("flush_step"), "batch").agg(
        F.max("num_samples").alias("n"), F.flatten(F.collect_list("generations")).alias("generations")
    )
    return parts.groupBy("flush_step").agg(
        F.sum("n").alias("num_samples"), F.array_join(all_records, ";").alias("generations")
    )


@B.add(
    "completion_preview",
    f"""WITH {EXCHANGES}, firsts AS (
  SELECT prompt, min(seq) AS seq, arg_min(conv_id, seq) AS step, arg_min(completion, seq) AS completion
  FROM pairs GROUP BY prompt)
SELECT CAST(step AS VARCHAR) AS step, prompt, completion FROM firsts
ORDER BY md5('42:' || seq), seq LIMIT 20""",
)
def completion_preview(spark, d):
    firsts = dedup_first(records(spark, d), ["prompt"], ["step", "seq"])
    sample = sample_exact(firsts, 20, 42, "seq")
    return sample.select(F.col("step").cast("string").alias("step"), "prompt", "completion")


@B.add(
    "last_n_logs",
    f"""WITH {EXCHANGES} SELECT conv_id, turn, prompt, completion FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM pairs) WHERE r <= 2""",
)
def last_n_logs(spark, d):
    return last_n(pairs(spark, d).drop("seq"), ["conv_id"], ["turn"], 2)
