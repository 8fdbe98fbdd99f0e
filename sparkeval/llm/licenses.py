"""Licence notices in documents, by votes on diagonals.

A document's rolling word pairs are hashed and joined to the places of the same pairs in the templates.
Matches of one template that come from one passage have the same difference between the two places, a
diagonal; words that were put in or left out shift it a little, so diagonals are merged that lie at most
``MAX_SHIFT`` apart, the first from the last. So a span is at most that many words longer than its notice, and
its pairs stand in the notice's order; it is verified word by word at every vote, and by the share of the
template that it covers.

Only DataFrame functions are used. The templates are a fixed list, so their table is broadcast. Votes are
counted before they are shuffled, and then brought together by document; texts are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkeval.llm.common import fresh

# Phrases that name a licence where they stand as a whole.
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)
# The opening words of well-known notices, found with small changes too.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("the software is provided as is without warranty of any kind express or implied", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
GRAM = 2
MIN_SHARE = 0.85  # of a notice's pairs
MAX_SHIFT = 2  # words between the first and the last diagonal that are merged
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def gram(words: Column, at: Column) -> Column:
    return F.xxhash64(*[F.get(words, at + i) for i in range(GRAM)])


def templates(spark: SparkSession) -> DataFrame:
    """(template, label, phrase, grams, at, hash, words): a row per pair of words of a template, and one
    row with ``at`` -1 and hash 0, which every document meets."""
    rows = ", ".join(
        f"({number}, '{label}', {number < len(PHRASES)}, '{text}')"
        for number, (text, label) in enumerate(PHRASES + NOTICES)
    )
    listed = spark.sql(f"SELECT * FROM VALUES {rows} AS t(template, label, phrase, text)")
    words = F.split("text", " ")
    starts = F.sequence(F.lit(0), F.size(words) - GRAM)
    pairs = listed.select(
        "template",
        "label",
        "phrase",
        (F.size(words) - GRAM + 1).alias("grams"),
        F.posexplode(F.transform(starts, lambda i: F.slice(words, i + 1, GRAM))).alias("at", "pair"),
    ).withColumn("hash", gram(F.col("pair"), F.lit(0)))
    mark = spark.sql("SELECT -1, '', false, 0, -1, CAST(array() AS array<string>), 0L")
    return pairs.union(mark)


def votes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(_key, _own, template, ..., diagonal, mask, n_words, copies): per document and diagonal the matched
    pairs of the template as bits. The row with template -1 is there for every document."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    worded = df.select(
        F.col(key).alias("_key"), F.xxhash64(text).alias("_own"), F.regexp_extract_all(low, F.lit(WORD), F.lit(0)).alias("w")
    )
    places = F.sequence(F.lit(0), F.size("w") - GRAM)
    rolled = F.when(F.size("w") >= GRAM, F.transform(places, lambda i: gram(F.col("w"), i))).otherwise(
        F.array().cast("array<bigint>")
    )
    # "outer" only keeps the array from being computed once more, for a filter: it is never empty.
    posted = worded.withColumn("h", F.concat(F.array(F.lit(0).cast("bigint")), rolled)).select(
        "_key", "_own", "w", F.posexplode_outer("h").alias("place", "hash")
    )
    place = F.col("place") - 1
    same = [F.get("w", place + i) == F.get("pair", F.lit(i)) for i in range(GRAM)]
    met = posted.join(F.broadcast(templates(df.sparkSession)), "hash").filter(
        ((F.col("at") < 0) & (place < 0)) | ((F.col("at") >= 0) & (place >= 0) & same[0] & same[1])
    )
    hits = met.select(
        "_key",
        "_own",
        "template",
        "label",
        "phrase",
        "grams",
        (place - F.col("at")).alias("diagonal"),
        F.when(F.col("at") >= 0, F.expr("shiftleft(1L, at)")).otherwise(0).alias("bit"),
        F.size("w").cast("bigint").alias("n_words"),
    )
    counted = hits.groupBy("_key", "_own", "template", "label", "phrase", "grams", "diagonal").agg(
        F.bit_or("bit").alias("mask"), F.max("n_words").alias("n_words"), F.count("*").alias("copies")
    )
    return counted.repartition("_key", "_own")


def spans(found: DataFrame) -> DataFrame:
    """``votes`` with ``share`` and ``first``: the part of the template that is covered on a diagonal and
    those up to ``MAX_SHIFT`` behind it, and where that starts. ``best``: no span of the template that
    starts as near by covers more, nor as much on an earlier diagonal."""
    order = Window.partitionBy("_key", "_own", "template").orderBy("diagonal")
    ahead, around = order.rangeBetween(0, MAX_SHIFT), order.rangeBetween(-MAX_SHIFT, MAX_SHIFT)
    lowest = F.bit_count(F.col("mask").bitwiseAND(-F.col("mask")) - 1)  # place of the first matched pair
    start = F.when(F.col("mask") != 0, F.col("diagonal") + lowest).cast("bigint")
    covered = F.when(F.col("phrase"), F.col("mask")).otherwise(F.bit_or("mask").over(ahead))
    rank = F.struct("share", -F.col("diagonal"))
    return (
        found.withColumn("start", start)
        .withColumn("first", F.when(F.col("phrase"), F.col("start")).otherwise(F.min("start").over(ahead)))
        .withColumn("share", F.when(F.col("grams") > 0, F.bit_count(covered) / F.col("grams")).otherwise(0.0))
        .withColumn("best", F.max(rank).over(around) == rank)
    )


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", into: str = "licences") -> DataFrame:
    """(key, ``into``) per document; ``into`` has n_words, n_base, first_word, last_word, base_labels,
    labels, score and spans (label, first word, share).

    A-Z are lowered; words are runs of ASCII letters, digits and characters beyond ASCII. Base places are
    those where a phrase stands as a whole; a notice counts from ``MIN_SHARE`` of its word pairs on, all moved
    against each other by two words at most. ``score`` is the largest share. Null and empty texts have no words and
    no labels. Every row gives one row: rows with the same key and text give equal ones, rows with one key
    and different texts their own; a null key is a key. An empty table gives an empty table; other columns
    are not read.
    """
    found = spans(votes(df, key, text))
    whole = F.col("phrase") & (F.col("share") == 1)
    notice = ~F.col("phrase") & (F.col("grams") > 0)
    kept = whole | (notice & F.col("best") & (F.col("share") >= MIN_SHARE))
    marked = F.col("template") < 0
    span = F.struct("first", "label", F.round("share", 6).alias("share"))
    per = found.groupBy("_key", "_own").agg(
        F.max("n_words").alias("n_words"),
        F.count(F.when(whole, 1)).alias("n_base"),
        F.min(F.when(whole, F.col("first"))).alias("first_word"),
        F.max(F.when(whole, F.col("first"))).alias("last_word"),
        F.array_sort(F.collect_set(F.when(whole, F.col("label")))).alias("base_labels"),
        F.array_sort(F.collect_set(F.when(kept, F.col("label")))).alias("labels"),
        F.round(F.coalesce(F.max(F.when(kept, F.col("share"))), F.lit(0.0)), 6).alias("score"),
        F.array_sort(F.collect_list(F.when(kept, span))).alias("spans"),
        F.max(F.when(marked, F.col("copies"))).alias("copies"),
    )
    held = F.struct(*[c for c in per.columns if c not in ("_key", "_own", "copies")]).alias(into)
    rows = per.select("_key", held, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias(fresh(df, "_copy")))
    return rows.select(F.col("_key").alias(key), into)
