"""Benchmarks, prompts, splits, samples and deduplication over documents, benchmark, part and pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindings import Bindings
from bindings.tables import CORPUS_SQL, corpus, quote, table
from sparkeval.functions import prompts as P
from sparkeval.functions.hashing import hash_below
from sparkeval.operators.selection import dedup_first, sample_exact, sample_fraction, split
from sparkeval.operators.selection import with_ordinal
from sparkeval.plans.ordering import numbered
from sparkeval.sources.benchmarks import SHAPES, first_samples, unify_benchmarks
from sparkeval.sources.tables import read_corpus

B = Bindings()
WITH = f"WITH {CORPUS_SQL}"

# Benchmarks ----------------------------------------------------------------------------------------


def sources(spark: SparkSession, d: str) -> dict[str, tuple[DataFrame, str]]:
    """Four tables shaped like four of the benchmarks."""
    item = table(spark, d, "benchmark")
    boxed = F.concat("text", F.lit(" Thus \\boxed{ "), F.col("item_id").cast("string"), F.lit(" }"))
    math = item.select(
        "item_id",
        F.col("text").alias("problem"),
        F.when(F.contains("text", F.lit("and")), boxed).otherwise(F.col("text")).alias("solution"),
    )
    part = table(spark, d, "part").select(
        F.col("p_partkey").alias("problem_idx"),
        F.concat("p_name", F.lit(" "), "p_type").alias("problem"),
        F.col("p_size").alias("answer"),
    )
    pages = table(spark, d, "pages").select(
        F.col("page_id").alias("id"), F.col("html").alias("question"), F.col("url").alias("answer")
    )
    supplier = table(spark, d, "supplier").select(
        "s_suppkey", F.col("s_name").alias("prompt"), F.col("s_nationkey").alias("answer")
    )
    return {
        "math500": (math, "item_id"),
        "aime25": (part, "problem_idx"),
        "minerva": (pages, "id"),
        "amo-bench": (supplier, "s_suppkey"),
    }


UNIFIED = r"""WITH unified AS (
  SELECT 'math500' AS dataset, row_number() OVER (ORDER BY item_id) - 1 AS ord,
         CAST(row_number() OVER (ORDER BY item_id) - 1 AS VARCHAR) AS problem_id, text AS problem,
         CASE WHEN contains(text, 'and') THEN CAST(item_id AS VARCHAR) ELSE text END AS ground_truth
  FROM benchmark
  UNION ALL SELECT 'aime25', row_number() OVER (ORDER BY p_partkey) - 1, CAST(p_partkey AS VARCHAR),
         p_name || ' ' || p_type, CAST(p_size AS VARCHAR) FROM part
  UNION ALL SELECT 'minerva', row_number() OVER (ORDER BY page_id) - 1, CAST(page_id AS VARCHAR), html, url
  FROM pages
  UNION ALL SELECT 'amo-bench', row_number() OVER (ORDER BY s_suppkey) - 1,
         CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS VARCHAR), s_name, CAST(s_nationkey AS VARCHAR)
  FROM supplier)"""
INSTRUCTION = quote(P.INSTRUCTION)


def unified(spark: SparkSession, d: str) -> DataFrame:
    return unify_benchmarks(sources(spark, d))


@B.add("bench_unified", f"{UNIFIED} SELECT * FROM unified")
def bench_unified(spark, d):
    return unified(spark, d)


@B.add(
    "bench_registry",
    f"""{UNIFIED} SELECT dataset, CASE dataset WHEN 'aime25' THEN 'train' ELSE 'test' END AS split,
  count(*) AS num_problems, count(ground_truth) AS num_answers FROM unified GROUP BY dataset""",
)
def bench_registry(spark, d):
    rows = unified(spark, d).filter(F.col("dataset").isin(*SHAPES))
    split_of = reduce(
        lambda c, name: F.when(F.col("dataset") == name, SHAPES[name].split).otherwise(c),
        SHAPES,
        F.lit(None).cast("string"),
    )
    return rows.groupBy("dataset", split_of.alias("split")).agg(
        F.count("*").alias("num_problems"), F.count("ground_truth").alias("num_answers")
    )


@B.add("bench_limit", f"{UNIFIED} SELECT * FROM unified WHERE dataset = 'minerva' AND ord < 30")
def bench_limit(spark, d):
    return first_samples(unified(spark, d).filter(F.col("dataset") == "minerva"), 30)


@B.add(
    "ordinal_id",
    "SELECT page_id, url, row_number() OVER (ORDER BY page_id) - 1 AS ordinal FROM pages",
)
def ordinal_id(spark, d):
    return with_ordinal(table(spark, d, "pages").select("page_id", "url"), "page_id")


@B.add(
    "ordinal_text",
    "SELECT page_id, url, row_number() OVER (ORDER BY url, page_id) - 1 AS ordinal FROM pages",
)
def ordinal_text(spark, d):
    """In the order of a text, with cuts far below the size of the table."""
    pages = table(spark, d, "pages").select("page_id", "url")
    return numbered(pages, [], ["url", "page_id"], "ordinal", rows_per_range=40)


@B.add(
    "prompt_eval",
    f"""{UNIFIED} SELECT dataset, problem_id, problem || chr(10) || chr(10) || {INSTRUCTION} AS prompt
FROM unified""",
)
def prompt_eval(spark, d):
    return unified(spark, d).select("dataset", "problem_id", P.eval_prompt("problem").alias("prompt"))


@B.add(
    "preview",
    f"{UNIFIED} SELECT dataset, problem_id, substring(problem, 1, 100) AS preview FROM unified",
)
def preview(spark, d):
    return unified(spark, d).select("dataset", "problem_id", P.preview("problem").alias("preview"))


# Corpus and prompts --------------------------------------------------------------------------------


@B.add("scan_corpus", f"{WITH} SELECT * FROM corpus")
def scan_corpus(spark, d):
    return corpus(spark, d)


@B.add("scan_pruned", "SELECT doc_id, lang, source FROM documents")
def scan_pruned(spark, d):
    return read_corpus(spark, f"{d}/documents.parquet", ["doc_id", "lang", "source"])


@B.add(
    "prompt_sft",
    f"""{WITH} SELECT *, 'Problem: ' || "Question" || chr(10) || 'Solution: ' || solution AS text
FROM corpus""",
)
def prompt_sft(spark, d):
    return corpus(spark, d).withColumn("text", P.sft_text("Question", "solution"))


@B.add(
    "prompt_grpo",
    f"""{WITH} SELECT 'Problem: ' || "Question" || chr(10) || ' ' || {INSTRUCTION} AS prompt, "Answer"
FROM corpus""",
)
def prompt_grpo(spark, d):
    return corpus(spark, d).select(P.grpo_prompt("Question").alias("prompt"), "Answer")


@B.add(
    "prompt_student",
    f"""{WITH} SELECT doc_id, 'Problem: ' || problem || chr(10) || chr(10) || {INSTRUCTION} AS prompt
FROM corpus""",
)
def prompt_student(spark, d):
    return corpus(spark, d).select("doc_id", P.student_prompt("problem").alias("prompt"))


@B.add(
    "prompt_rendered",
    f"""{WITH} SELECT doc_id, '<|im_start|>user' || chr(10) || 'Problem: ' || problem || chr(10) || chr(10)
  || {INSTRUCTION} || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS prompt FROM corpus""",
)
def prompt_rendered(spark, d):
    """The student prompt as a chat of one message."""
    messages = P.user_message(P.student_prompt("problem"))
    return corpus(spark, d).select("doc_id", P.render_messages(messages).alias("prompt"))


TEACHER = f"problem || {quote(P.SOLUTION_START)} || solution || {quote(P.TRANSITION_SUFFIX)}"
REASONING = (
    f"'Problem: ' || problem || chr(10) || chr(10) || {quote(P.REASONING_START)} || solution || "
    f"{quote(P.REASONING_END)} || {quote(P.ANALYSE)}"
)


@B.add("prompt_teacher", f"{WITH} SELECT doc_id, {TEACHER} AS prompt FROM corpus")
def prompt_teacher(spark, d):
    return corpus(spark, d).select("doc_id", P.teacher_prompt("problem", "solution").alias("prompt"))


@B.add("prompt_teacher_reasoning", f"{WITH} SELECT doc_id, {REASONING} AS prompt FROM corpus")
def prompt_teacher_reasoning(spark, d):
    return corpus(spark, d).select("doc_id", P.reasoning_prompt("problem", "solution").alias("prompt"))


@B.add(
    "teacher_context",
    f"""{WITH} SELECT doc_id, {REASONING} || "Answer" || {quote(P.TRANSITION_SUFFIX)} AS context
FROM corpus""",
)
def teacher_context(spark, d):
    prompt = P.reasoning_prompt("problem", "solution")
    return corpus(spark, d).select("doc_id", P.teacher_context(prompt, "Answer").alias("context"))


@B.add(
    "teacher_mode",
    f"""SELECT doc_id, lang = 'en' AS reason_first,
  CASE WHEN lang = 'en' THEN '' ELSE {TEACHER} END AS prompt
FROM documents JOIN (SELECT doc_id, text AS problem, source || ' / ' || lang AS solution FROM documents)
  USING (doc_id)""",
)
def teacher_mode(spark, d):
    first = F.endswith(F.col("solution"), F.lit(" / en"))
    prompt = P.teacher_prompt_by_mode("problem", "solution", first)
    return corpus(spark, d).select("doc_id", first.alias("reason_first"), prompt.alias("prompt"))


# Splits, samples, copies ---------------------------------------------------------------------------


def split_sql(size: str) -> str:
    return f"""{WITH}, ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS r,
         (SELECT ceil({size} * count(*)) FROM corpus) AS n FROM corpus)
SELECT doc_id, CASE WHEN r <= n THEN 'test' ELSE 'train' END AS part FROM ranked"""


def split_parts(spark: SparkSession, d: str, size: float) -> DataFrame:
    train, test = split(corpus(spark, d).select("doc_id"), size, 42, "doc_id")
    named = [df.withColumn("part", F.lit(n)) for n, df in (("train", train), ("test", test))]
    return named[0].unionByName(named[1])


@B.add("split_sft", split_sql("0.01"))
def split_sft(spark, d):
    return split_parts(spark, d, 0.01)


@B.add("split_grpo", split_sql("0.007"))
def split_grpo(spark, d):
    return split_parts(spark, d, 0.007)


@B.add("split_disjoint", "SELECT 0 AS shared, 0 AS lost, count(*) AS rows FROM documents")
def split_disjoint(spark, d):
    """Rows in both parts, rows in neither, and all rows."""
    ids = corpus(spark, d).select("doc_id")
    train, test = split(ids, 0.01, 42, "doc_id")
    both = train.intersect(test).select(F.count("*").cast("int")).scalar()
    lost = ids.exceptAll(train.unionByName(test)).select(F.count("*").cast("int")).scalar()
    return ids.agg(F.count("*").alias("rows")).withColumns({"shared": both, "lost": lost})


@B.add(
    "sample_n",
    f"{WITH} SELECT doc_id, problem FROM corpus ORDER BY md5('42:' || doc_id), doc_id LIMIT 50",
)
def sample_n(spark, d):
    return sample_exact(corpus(spark, d).select("doc_id", "problem"), 50, 42, "doc_id")


@B.add(
    "sample_bernoulli",
    "SELECT doc_id, text FROM documents WHERE substring(md5('7:' || doc_id), 1, 8) < '028f5c28'",
)
def sample_bernoulli(spark, d):
    return sample_fraction(table(spark, d, "documents").select("doc_id", "text"), 0.01, 7, "doc_id")


@B.add(
    "sample_flags",
    """SELECT count(*) AS rows,
  count(*) FILTER (WHERE substring(md5('7:' || doc_id), 1, 8) < '028f5c28') AS sampled
FROM documents""",
)
def sample_flags(spark, d):
    """How many rows a 1 % sample would log."""
    return table(spark, d, "documents").agg(
        F.count("*").alias("rows"), F.count_if(hash_below(7, "doc_id", 0.01)).alias("sampled")
    )


@B.add(
    "dedup_prompts",
    "SELECT text, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM documents GROUP BY text",
)
def dedup_prompts(spark, d):
    return dedup_first(table(spark, d, "documents").select("doc_id", "lang", "text"), ["text"], ["doc_id"])
