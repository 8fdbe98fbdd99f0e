"""From texts to batches of padded id arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkeval.functions.sequences import pad_to, tokens
from sparkeval.plans.ordering import numbered
from sparkeval.plans.skew import attach

# Frequent words that are looked up without a shuffle, and their longest: a few megabytes at most.
HEAD = 50_000
LONGEST_HEAD = 64
TEXTS_AT_ONCE = 512  # bounds the memory of a Python worker; it changes no result


def build_vocab(df: DataFrame, text: str, min_count: int = 1, first_id: int = 2) -> DataFrame:
    """(token, n, id): the words of a corpus, how often they occur, and their ids.

    Ids follow the order of the tokens' md5. Distinct tokens spread evenly over the 4,096 hash
    prefixes, so numbering needs no global sort. Ids below ``first_id`` are left for pad and unknown.
    """
    counts = (
        df.select(F.explode(tokens(text)).alias("token"))
        .groupBy("token")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= min_count)
        .withColumn("_h", F.md5("token"))
        .withColumn("_p", F.substring("_h", 1, 3))
    )
    earlier = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        counts.groupBy("_p")
        .agg(F.count("*").alias("_size"))
        .select("_p", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    )
    place = F.row_number().over(Window.partitionBy("_p").orderBy("_h", "token"))
    return (
        counts.withColumn("_place", place)
        .join(F.broadcast(offsets), "_p")  # one row per prefix: 4,096 at most
        .select(
            "token", "n", (F.col("_before") + F.col("_place") - 1 + first_id).cast("int").alias("id")
        )
    )


def encode(
    df: DataFrame,
    key: str,
    text: str | list[str],
    vocab: DataFrame,
    unk_id: int = 1,
    head: int = HEAD,
) -> DataFrame:
    """(key, ids): the id of each word in order; words outside the vocabulary become ``unk_id``.

    With a list of text columns there is one column of ids per text, all from one pass. ``key`` is unique;
    texts without words give an empty array. The ``head`` most frequent words of the vocabulary, a table
    of bounded size, are looked up where the text is, a batch of texts at once, and leave it as one array
    per text; only the other words are rows of their own that are shuffled, and none of them is frequent.
    Head words are looked up when this is called. ``vocab`` is read twice: pass a stored table.
    """
    texts = [text] if isinstance(text, str) else text
    sides = F.posexplode(F.array(*[F.col(t) for t in texts])).alias("_side", "_text")
    rows = df.select(F.col(key).alias("_key"), sides)
    short = vocab.filter(F.length("token") <= LONGEST_HEAD)
    frequent = short.orderBy(F.desc("n"), "token").limit(head).select("token", "id").toArrow()
    keyed = [f for f in rows.schema.fields if f.name != "_text"]
    known = rows.mapInArrow(_looked_up(frequent), T.StructType([*keyed, T.StructField("packed", T.ArrayType(T.LongType()))]))
    others = [T.StructField("pos", T.LongType()), T.StructField("token", T.StringType())]
    rare = rows.mapInArrow(_left_over(frequent), T.StructType([*keyed, *others]))
    found = rare.join(vocab.select("token", "id"), "token", "left").withColumn("id", F.coalesce("id", F.lit(unk_id)))
    # Position and id in one long: arrays of longs are sorted without objects.
    one = (F.shiftleft("pos", 32) + F.col("id")).alias("one")
    parts = known.withColumn("one", F.lit(None).cast("long")).union(
        found.select("_key", "_side", F.lit(None).cast("array<bigint>").alias("packed"), one)
    )
    of_text = lambda i, c: F.collect_list(F.when(F.col("_side") == i, F.col(c)))
    lower = F.lit(2**32 - 1)
    ids = [
        F.transform(
            F.sort_array(F.concat(F.flatten(of_text(i, "packed")), of_text(i, "one"))),
            lambda x: x.bitwiseAND(lower).cast("int"),
        ).alias("ids" if isinstance(text, str) else name)
        for i, name in enumerate(texts)
    ]
    return parts.groupBy(F.col("_key").alias(key)).agg(*ids)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of texts, as ``tokens`` cuts them, with the text and the place in it of each."""
    for blank in "\t\n\r":
        texts = pc.replace_substring(texts, blank, " ")
    cut = pc.split_pattern(texts, " ")
    words, at = cut.flatten(), pc.list_parent_indices(cut)
    real = pc.not_equal(words, "")
    at = at.filter(real).to_numpy(zero_copy_only=False)
    counts = np.bincount(at, minlength=len(texts))
    return words.filter(real), at, np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, TEXTS_AT_ONCE):
            yield batch.slice(start, TEXTS_AT_ONCE)


def _looked_up(head: pa.Table):
    """The words in ``head`` (token, id) of each text, as one array of packed places and ids."""
    tokens, ids = (head.column(c).combine_chunks() for c in ("token", "id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            words, at, pos = _words(batch.column(2))
            found = pc.index_in(words, value_set=tokens)
            there = found.is_valid().to_numpy(zero_copy_only=False)
            values = ids.take(found.drop_null()).to_numpy().astype(np.int64)
            ends = np.cumsum(np.bincount(at[there], minlength=batch.num_rows))
            offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
            packed = pa.ListArray.from_arrays(offsets, pa.array((pos[there] << 32) + values, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], names=["_key", "_side", "packed"])

    return run


def _left_over(head: pa.Table):
    """A row per word that is not in ``head``, with its place."""
    tokens = head.column("token").combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            words, at, pos = _words(batch.column(2))
            other = pc.invert(pc.is_in(words, value_set=tokens))
            rare = other.to_numpy(zero_copy_only=False)
            rows = batch.select([0, 1]).take(pa.array(at[rare]))
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(pos[rare], pa.int64()), words.filter(other)], names=["_key", "_side", "pos", "token"]
            )

    return run


def assign_batch(
    df: DataFrame, size: int, order: str, name: str = "batch_id", **ranges
) -> DataFrame:
    """Consecutive batches of ``size`` rows in ``order`` (unique), with the place inside."""
    return numbered(df, [], [order], "_rank", **ranges).select(
        *df.columns,
        F.floor(F.col("_rank") / size).cast("long").alias(name),
        F.pmod(F.col("_rank"), F.lit(size)).cast("int").alias("batch_pos"),
    )


def effective_batch(per_device: int, accumulation: int, processes: int) -> int:
    return per_device * accumulation * processes


def batch_lengths(df: DataFrame, ids: str, batch: str = "batch_id") -> DataFrame:
    return df.groupBy(batch).agg(
        F.count("*").alias("batch_size"), F.max(F.size(ids)).alias("max_len")
    )


def pad_batch(
    df: DataFrame,
    ids: str,
    batch: str = "batch_id",
    pad: int = 0,
    side: str = "right",
    spread: list[str] | None = None,
    **salting,
) -> DataFrame:
    """Pad ``ids`` to the longest of its batch and add ``max_len``.

    Lengths are aggregated alone and joined back, so the arrays are not sorted through a window.
    Batches from ``assign_batch`` are small; for other batch ids, which may be very uneven, name in
    ``spread`` the columns that tell the rows of a batch apart, and large batches are salted.
    """
    lengths = batch_lengths(df, ids, batch)
    if spread:
        joined = attach(df, lengths, [batch], spread, "batch_size", **salting)
    else:
        joined = df.join(lengths, batch)
    return joined.withColumn(ids, pad_to(ids, "max_len", pad, side)).drop("batch_size")


def collate(
    df: DataFrame, ids: str, max_length: int, batch: str = "batch_id", pad: int = 0, **options
) -> DataFrame:
    """Truncate, measure, pad and mask one id column: the batch a trainer reads."""
    cut = df.withColumn(ids, F.slice(F.col(ids), 1, max_length))
    cut = cut.withColumn("length", F.size(ids))
    padded = pad_batch(cut, ids, batch, pad, **options)
    length = F.coalesce("length", F.lit(0))  # of a row without ids, whose mask is null at every place
    pads = F.array_repeat(F.when(F.col("length").isNotNull(), 0), F.col("max_len") - length)
    mask = F.concat(F.array_repeat(F.lit(1), length), pads)
    return padded.withColumn("attention_mask", F.coalesce(mask, F.array().cast("array<int>")))


def align_next(scores: DataFrame, ids: DataFrame, seq: str = "seq_id", pos: str = "pos") -> DataFrame:
    """Scores made at a position, paired with the token they predict: the one at the next position.

    A join on the unique (sequence, position); a lag over the sequence would gather it in one task.
    """
    return scores.withColumn(pos, F.col(pos) + 1).join(ids, [seq, pos])


def generation_stats(
    df: DataFrame, ids: str, elapsed: Column | float | None = None, by: list[str] | None = None
) -> DataFrame:
    """Prompts, tokens, mean length and tokens per second; 0 where the divisor is 0."""
    rows = df.groupBy(*by) if by else df
    stats = rows.agg(
        F.count("*").alias("num_prompts"),
        F.coalesce(F.sum(F.size(ids)), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.avg(F.size(ids)), F.lit(0.0)).alias("avg_length"),
    )
    if elapsed is None:
        return stats
    seconds = elapsed if isinstance(elapsed, Column) else F.lit(float(elapsed))
    speed = F.when(seconds > 0, F.try_divide(F.col("total_tokens"), seconds)).otherwise(F.lit(0.0))
    return stats.withColumn("tokens_per_sec", speed)


