"""The given tables in the roles that the operators need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkeval.plans.ordering import ranks
from sparkeval.plans.session import spread
from sparkeval.sources.tables import read_corpus

VAL_N = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(*columns: str) -> dict[str, Column]:
    """Six places: sums of doubles depend on the order of the rows in the last digits."""
    return {c: F.round(c, 6) for c in columns}


# Problems and completions --------------------------------------------------------------------------


def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    gold = F.when(status == "P", "A").when(status == "F", "R").otherwise("N")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("problem_id"),
        F.col("o_orderkey").alias("ord"),
        F.concat(
            F.lit("Order "),
            F.col("o_orderkey").cast("string"),
            F.lit(" of customer "),
            F.col("o_custkey").cast("string"),
        ).alias("problem"),
        gold.alias("ground_truth"),
    )


def completion_text() -> Column:
    flag = F.col("l_returnflag")
    discount = F.col("l_discount")
    return (
        F.when((F.col("l_linestatus") == "O") & (F.col("l_tax") == 0), F.lit("No final answer"))
        .when(discount == 0, F.concat(F.lit("Try \\boxed{X}, so \\boxed{"), flag, F.lit("}")))
        .when(discount == 0.01, F.lit("So \\boxed{}"))
        .when(discount == 0.02, F.concat(F.lit("See \\boxed{"), flag, F.lit("} then \\boxed{")))
        .when(discount == 0.03, F.concat(F.lit("So \\boxed{\\text{"), flag, F.lit("}}")))
        .otherwise(F.concat(F.lit("So \\boxed{ "), flag, F.lit(" }")))
    )


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    lines = read_corpus(
        spark,
        f"{sf_dir}/lineitem.parquet",
        ["l_orderkey", *order, "l_returnflag", "l_linestatus", "l_tax", "l_discount"],
    )
    named = lines.select(
        F.col("l_orderkey").alias("problem_id"),
        F.concat(F.lit("run-"), F.pmod("l_suppkey", F.lit(4)).cast("string")).alias("run_id"),
        *order,
        completion_text().alias("text"),
    )
    numbered = ranks(named, ["problem_id"], order, "sample_idx")
    return numbered.select("run_id", "problem_id", F.col("sample_idx").cast("int"), "text")


PROBLEMS_SQL = """problems AS (
  SELECT o_orderkey AS problem_id, o_orderkey AS ord,
         'Order ' || o_orderkey || ' of customer ' || o_custkey AS problem,
         CASE o_orderstatus WHEN 'P' THEN 'A' WHEN 'F' THEN 'R' ELSE 'N' END AS ground_truth
  FROM orders)"""
COMPLETIONS_SQL = r"""completions AS (
  SELECT l_orderkey AS problem_id, 'run-' || (l_suppkey % 4) AS run_id,
         CAST(row_number() OVER (PARTITION BY l_orderkey
           ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INTEGER) AS sample_idx,
         CASE WHEN l_linestatus = 'O' AND l_tax = 0 THEN 'No final answer'
              WHEN l_discount = 0 THEN 'Try \boxed{X}, so \boxed{' || l_returnflag || '}'
              WHEN l_discount = 0.01 THEN 'So \boxed{}'
              WHEN l_discount = 0.02 THEN 'See \boxed{' || l_returnflag || '} then \boxed{'
              WHEN l_discount = 0.03 THEN 'So \boxed{\text{' || l_returnflag || '}}'
              ELSE 'So \boxed{ ' || l_returnflag || ' }' END AS text
  FROM lineitem)"""
LAST_SQL = r"""last_box AS (
  SELECT problem_id, run_id, sample_idx, text,
         CASE WHEN contains(text, '\boxed')
                   AND regexp_matches(tail, '^\{((?:[^{}]|\{[^{}]*\})*)\}')
              THEN trim(regexp_extract(tail, '^\{((?:[^{}]|\{[^{}]*\})*)\}', 1)) END AS answer
  FROM (SELECT *, list_extract(string_split(text, '\boxed'), -1) AS tail FROM completions))"""
GRADED_SQL = r"""graded AS (
  SELECT run_id, problem_id, sample_idx, text, answer, ground_truth,
         CASE WHEN answer IS NULL OR answer = '' THEN '[No boxed answer found]' ELSE answer END
           AS predicted,
         answer IS NOT NULL AS formatted,
         coalesce(regexp_replace(answer, '^\\text\{([^{}]*)\}$', '\1') = ground_truth, false) AS correct
  FROM last_box JOIN problems USING (problem_id))"""
EVALUATED = ",\n".join([PROBLEMS_SQL, COMPLETIONS_SQL, LAST_SQL, GRADED_SQL])


def votes_sql(keys: str = "problem_id") -> str:
    """votes, scored: the winner per problem and all per-problem measures."""
    on = " AND ".join(f"c.{k} = v.{k}" for k in keys.split(", "))
    cs = ", ".join(f"c.{k}" for k in keys.split(", "))
    return rf"""votes AS (
  SELECT {keys}, predicted AS majority_answer, n AS votes,
         coalesce(regexp_replace(predicted, '^\\text\{{([^{{}}]*)\}}$', '\1') = gold, false) AS won
  FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, f) AS r
        FROM (SELECT {keys}, predicted, count(*) AS n, min(sample_idx) AS f, max(ground_truth) AS gold
              FROM graded WHERE formatted GROUP BY {keys}, predicted))
  WHERE r = 1),
scored AS (
  SELECT {cs}, c.num_samples, c.num_correct, c.num_formatted, c.num_correct > 0 AS has_correct,
         coalesce(v.won, false) AS majority_vote_correct
  FROM (SELECT {keys}, count(*) AS num_samples, count(*) FILTER (WHERE correct) AS num_correct,
               count(*) FILTER (WHERE formatted) AS num_formatted FROM graded GROUP BY {keys}) c
  LEFT JOIN votes v ON {on})"""


# Corpus --------------------------------------------------------------------------------------------


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as training rows: the text is the problem, source and language stand for the rest."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("text").alias("problem"),
        F.col("text").alias("Question"),
        F.concat("source", F.lit(" / "), "lang").alias("solution"),
        F.col("n_chars").cast("string").alias("Answer"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long texts, over all cores."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")


CORPUS_SQL = """corpus AS (
  SELECT doc_id, text AS problem, text AS "Question", source || ' / ' || lang AS solution,
         CAST(n_chars AS VARCHAR) AS "Answer" FROM documents)"""


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# Words and ids -------------------------------------------------------------------------------------

WORDS = r"list_filter(regexp_split_to_array({}, '[ \t\n\r]+'), lambda w: w <> '')"


def vocab_sql(source: str, text: str = "text") -> str:
    return f"""vocab AS (
  SELECT token, n, CAST(row_number() OVER (ORDER BY md5(token), token) + 1 AS INTEGER) AS id
  FROM (SELECT token, count(*) AS n
        FROM (SELECT unnest({WORDS.format(text)}) AS token FROM {source}) GROUP BY token))"""


def encoded_sql(name: str, source: str, key: str, text: str, vocab: str = "vocab") -> str:
    """name(key, ids): the ids of the words in order."""
    return f"""{name} AS (
  SELECT {key}, coalesce(list(coalesce(id, 1) ORDER BY pos) FILTER (WHERE pos IS NOT NULL),
                         CAST([] AS INTEGER[])) AS ids
  FROM (SELECT d.{key}, w.pos, w.token
        FROM {source} d LEFT JOIN (
          SELECT {key}, generate_subscripts({WORDS.format(text)}, 1) AS pos,
                 unnest({WORDS.format(text)}) AS token FROM {source}) w USING ({key})) x
  LEFT JOIN {vocab} USING (token) GROUP BY {key})"""


def joined_ids(ids: Column | str) -> Column:
    """Arrays leave the queries as text, which every engine compares alike."""
    return F.array_join((F.col(ids) if isinstance(ids, str) else ids).cast("array<string>"), " ")


def ids_sql(ids: str) -> str:
    return f"coalesce(list_aggregate(list_transform({ids}, lambda x: CAST(x AS VARCHAR)), 'string_agg', ' '), '')"
