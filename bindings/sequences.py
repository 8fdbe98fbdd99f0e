"""Vocabulary, encoding and batching over documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindings import Bindings
from bindings.tables import documents, encoded_sql, ids_sql, joined_ids, table, vocab_sql
from sparkeval.functions.sequences import attention_mask, tokens, truncate
from sparkeval.operators.sequences import (
    assign_batch,
    batch_lengths,
    build_vocab,
    collate,
    encode,
    generation_stats,
    pad_batch,
)
from sparkeval.plans.session import materialize
from sparkeval.registry import collate_with

B = Bindings()
MAX_LENGTH = 2048
LONGEST_TEXT = 2 * MAX_LENGTH  # of a row of pads
BATCH = 32
VOCAB = vocab_sql("documents")
ENCODED = f"WITH {VOCAB},\n{encoded_sql('encoded', 'documents', 'doc_id', 'text')}"
BATCHED = f"""{ENCODED},
batched AS (
  SELECT doc_id, ids, CAST((row_number() OVER (ORDER BY doc_id) - 1) // {BATCH} AS BIGINT) AS batch_id,
         CAST((row_number() OVER (ORDER BY doc_id) - 1) % {BATCH} AS INTEGER) AS batch_pos
  FROM encoded)"""
COLLATED = f"""{BATCHED},
cut AS (SELECT doc_id, batch_id, ids[1:{MAX_LENGTH}] AS ids, len(ids[1:{MAX_LENGTH}]) AS length
        FROM batched),
collated AS (SELECT *, max(length) OVER (PARTITION BY batch_id) AS max_len FROM cut)"""
WHOLE = f"""{BATCHED},
padded AS (SELECT doc_id, batch_id, ids, len(ids) AS length, max(len(ids)) OVER (PARTITION BY batch_id) AS max_len
           FROM batched)"""


def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return materialize(build_vocab(documents(spark, d), "text"), "vocab")


def encoded(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).select("doc_id", "text")
    return encode(docs, "doc_id", "text", vocabulary(spark, d))


def batches(spark: SparkSession, d: str) -> DataFrame:
    """Encoded documents in batches; stored, as numbering reads its input more than once."""
    return assign_batch(materialize(encoded(spark, d), "encoded"), BATCH, "doc_id")


@B.add("vocab_build", f"WITH {VOCAB} SELECT token, n, id FROM vocab")
def vocab_build(spark, d):
    return build_vocab(documents(spark, d), "text")


@B.add("encode_tokens", f"{ENCODED} SELECT doc_id, {ids_sql('ids')} AS ids FROM encoded")
def encode_tokens(spark, d):
    return encoded(spark, d).select("doc_id", joined_ids("ids").alias("ids"))


@B.add(
    "truncate",
    f"{ENCODED} SELECT doc_id, {ids_sql(f'ids[1:{MAX_LENGTH}]')} AS ids FROM encoded",
)
def truncated(spark, d):
    return encoded(spark, d).select("doc_id", joined_ids(truncate("ids", MAX_LENGTH)).alias("ids"))


@B.add(
    "seq_len",
    f"{ENCODED} SELECT doc_id, CAST(least(len(ids), {MAX_LENGTH}) AS INTEGER) AS length FROM encoded",
)
def seq_len(spark, d):
    """Ids are one to a word, so lengths need no vocabulary."""
    words = truncate(tokens("text"), MAX_LENGTH)
    return documents(spark, d).select("doc_id", F.size(words).alias("length"))


@B.add("assign_batch", f"{BATCHED} SELECT doc_id, batch_id, batch_pos FROM batched")
def assigned(spark, d):
    return assign_batch(table(spark, d, "documents").select("doc_id"), BATCH, "doc_id")


@B.add(
    "batch_max_len",
    f"""{BATCHED} SELECT batch_id, count(*) AS batch_size, CAST(max(len(ids)) AS INTEGER) AS max_len
FROM batched GROUP BY batch_id""",
)
def batch_max_len(spark, d):
    words = documents(spark, d).select("doc_id", tokens("text").alias("ids"))
    return batch_lengths(assign_batch(words, BATCH, "doc_id"), "ids")


@B.add(
    "pad_batch",
    f"""{WHOLE} SELECT doc_id, batch_id, CAST(max_len AS INTEGER) AS max_len,
  {ids_sql('list_resize(ids, max_len, 0)')} AS ids FROM padded""",
)
def padded(spark, d):
    rows = batches(spark, d).select("doc_id", "batch_id", "ids")
    return pad_batch(rows, "ids").select("doc_id", "batch_id", "max_len", joined_ids("ids").alias("ids"))


@B.add(
    "pad_left",
    f"""{WHOLE} SELECT doc_id, batch_id,
  {ids_sql('list_concat(list_resize(CAST([] AS INTEGER[]), max_len - length, 0), ids)')} AS ids
FROM padded""",
)
def padded_left(spark, d):
    rows = batches(spark, d).select("doc_id", "batch_id", "ids")
    out = pad_batch(rows, "ids", side="left")
    return out.select("doc_id", "batch_id", joined_ids("ids").alias("ids"))


@B.add(
    "collate",
    f"""{COLLATED} SELECT doc_id, batch_id, CAST(length AS INTEGER) AS length,
  {ids_sql('list_resize(ids, max_len, 0)')} AS ids,
  repeat('1', length) || repeat('0', max_len - length) AS attention_mask FROM collated""",
)
def collated(spark, d):
    out = collate(batches(spark, d), "ids", MAX_LENGTH)
    real = F.size(F.array_remove("attention_mask", 0))  # ones come first, and so do ids; then pads
    pads = F.size("attention_mask") - real
    mask = F.concat(F.repeat(F.lit("1"), real), F.repeat(F.lit("0"), pads))
    ids = F.concat(joined_ids(F.slice("ids", F.lit(1), real)), F.repeat(F.lit(" 0"), pads))
    ids = F.when(real > 0, ids).otherwise(F.substring(ids, 2, LONGEST_TEXT))
    return out.select("doc_id", "batch_id", "length", ids.alias("ids"), mask.alias("attention_mask"))


@B.add(
    "collate_registry",
    f"""{WHOLE} SELECT batch_id, count(*) AS n, CAST(max(max_len) AS BIGINT) AS longest, CAST(sum(length) AS BIGINT) AS used
FROM padded GROUP BY batch_id""",
)
def collate_registry(spark, d):
    """A collator of a user's own: it reports how full each batch is."""

    def fullness(rows: pd.DataFrame) -> pd.DataFrame:
        sizes = rows["ids"].map(len)
        return pd.DataFrame(
            {"batch_id": [rows["batch_id"][0]], "n": [len(rows)], "longest": [sizes.max()], "used": [sizes.sum()]}
        )

    rows = batches(spark, d).select("batch_id", "ids")
    return collate_with(rows, fullness, "batch_id long, n long, longest long, used long")


@B.add(
    "attention_mask",
    f"{WHOLE} SELECT doc_id, repeat('1', length) || repeat('0', max_len - length) AS mask FROM padded",
)
def masks(spark, d):
    """Of whole sequences, padded to the longest of their batch."""
    rows = pad_batch(batches(spark, d).select("doc_id", "batch_id", "ids"), "ids")
    mask = F.array_join(F.transform(attention_mask("ids"), lambda x: x.cast("string")), "")
    return rows.select("doc_id", mask.alias("mask"))


@B.add(
    "gen_stats",
    f"""{ENCODED} SELECT count(*) AS num_prompts, CAST(sum(len(ids)) AS BIGINT) AS total_tokens,
  round(avg(len(ids)), 6) AS avg_length, round(sum(len(ids)) / 12.5::DOUBLE, 6) AS tokens_per_sec
FROM encoded""",
)
def gen_stats(spark, d):
    words = documents(spark, d).select(tokens("text").alias("ids"))
    stats = generation_stats(words, "ids", 12.5)
    return stats.withColumns({c: F.round(c, 6) for c in ("avg_length", "tokens_per_sec")})
