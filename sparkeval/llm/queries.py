"""The operators of this subpackage over the given tables, and equivalent SQL where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkeval.llm import (
    centroids,
    chat_views,
    classifier,
    decontam,
    language,
    licenses,
    neardup,
    pieces,
    quality,
    repeats,
    secret_scan,
    tokens,
    whitening,
)
from sparkeval.llm.common import prepared
from sparkeval.plans.session import materialize

PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text")


def joined(items: Column | str) -> Column:
    return F.array_join(items, ",")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        *[f"licences.{c}" for c in ("n_words", "n_base", "first_word", "last_word")],
        joined("licences.base_labels").alias("base_labels"),
        joined("licences.labels").alias("labels"),
        "licences.score",
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts before and after three edits of every document, the places drawn from its id: a
    sentence goes in, thirty characters go, ten become upper case."""
    with open(RANKS, "rb") as file:
        ranks = file.read()
    docs = documents(spark, sf_dir)
    n = F.char_length(F.coalesce("text", F.lit("")))

    def place(salt: int) -> Column:
        return F.pmod(F.xxhash64("doc_id", F.lit(salt)), n + 1)

    def change(start: Column, length: int, by: Column) -> Column:
        return F.struct(start.alias("start"), (start + length).alias("end"), by.alias("by"))

    upper = F.upper(F.substr("text", (place(3) + 1).cast("int"), F.lit(10)))
    edits = F.array(
        change(place(1), 0, F.lit(" An inserted sentence.")),
        change(place(2), 30, F.lit("")),
        change(place(3), 10, upper),
    )
    built = tokens.build(docs.withColumn("edits", edits), ranks, public_tokenizers.PATTERN)
    done = tokens.apply_edits(built, ranks, public_tokenizers.PATTERN)
    return done.select(
        "doc_id",
        F.get("tree.tokens", F.lit(1)).alias("n_tokens"),
        F.col("edited.n_tokens").alias("n_tokens_after"),
        F.col("edited.n_chars").alias("n_chars_after"),
        F.col("edited.n_encoded").alias("n_chars_encoded_again"),
    )


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find(documents(spark, sf_dir))
    parts = F.arrays_zip("secrets.kind", "secrets.start", "secrets.end")
    base = F.filter(parts, lambda s: s["kind"] != "novel")

    def listed(spans: Column) -> Column:
        return joined(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        )

    def number(kind: str) -> Column:
        return F.size(F.filter("secrets.kind", lambda k: k == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(number, secret_scan.KINDS),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(parts).alias("spans"),
    )


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(documents(spark, sf_dir), percent=85)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(documents(spark, sf_dir)).select(
        "doc_id", "kept.n_words", "kept.n_removed", F.sha2("kept.text", 256).alias("kept_sha256")
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality.ledger(documents(spark, sf_dir))
    failures = F.col("quality.failures")
    return q.select(
        "doc_id",
        *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        (~quality.passes(failures, 1)).alias("base_failed"),
        quality.passes(failures, 2).alias("kept"),
        failures.alias("failures"),
    )


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    span = lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))
    return chat_views.views(turns).select(
        "conv_id", "speaker", "part", "first_turn", "piece", "n_turns", "text", joined(F.transform("mask", span)).alias("mask")
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = table(spark, sf_dir, "benchmark", "item_id", "text")
    found = decontam.contamination(documents(spark, sf_dir), benchmark)
    return found.select(
        "doc_id",
        "hits.n_words",
        "hits.n_hit",
        F.size("hits.items").cast("bigint").alias("n_items"),
        F.sha2(joined("hits.items"), 256).alias("items_sha256"),
        (F.col("hits.n_hit") > 0).alias("contaminated"),
    )


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 0
    found = materialize(classifier.featurize(documents(spark, sf_dir)).drop("text"), "statistics")
    labels = table(spark, sf_dir, "labels", "doc_id", F.col("quality").alias("label"))
    model = classifier.fit(found.filter(~held_out).join(labels, "doc_id"))
    scored = classifier.score(found, model)
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pieces.read_model(PIECES)
    done = pieces.round_trip(documents(spark, sf_dir), model)
    return done.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(joined(F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) == 2
    model = language.fit(docs.filter(~held_out))
    return language.identify(docs.select("doc_id", "text"), model).select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("language.language").alias("lang_pred"),
        F.col("language.score").alias("score"),
    )


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return centroids.clusters(vectors, "vec_id", "embedding").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), "vec_id", "embedding")


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_token_counts,
        op3_secret_scan,
        op4_minhash_near_dedup,
        op5_substring_dedup,
        op6_quality_rules,
        op7_chat_formatting,
        op8_decontamination,
        op9_quality_classifier,
        op10_sentencepiece,
        op11_language_id,
        op12_centroid_clustering,
        op13_embedding_whitening,
    )
}
WHITE_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '')"
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def clustering_sql(k: int = 8, rounds: int = 10, seed: int = 3) -> str:
    """A table of assignments and one of centroids for each round."""
    parts = [
        rf"""v AS MATERIALIZED (
        SELECT row_number() OVER () AS r, vec_id, embedding,
          list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS x
        FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
      c0 AS MATERIALIZED (
        SELECT row_number() OVER (ORDER BY h, embedding) - 1 AS c, x
        FROM (SELECT *, sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h FROM v)
        ORDER BY h, embedding LIMIT {k})"""
    ]
    for i in range(rounds + 1):
        parts.append(rf"""a{i} AS MATERIALIZED (
        SELECT r, x, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
          SELECT r, v.x, c, list_sum(list_transform(list_zip(v.x, p.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
          FROM v, c{i} AS p) GROUP BY r, x)""")
        if i < rounds:
            parts.append(rf"""c{i + 1} AS MATERIALIZED (
        SELECT c, list(m ORDER BY p) AS x FROM (
          SELECT c, p, CAST((sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
          FROM (SELECT c, unnest(x) AS e, generate_subscripts(x, 1) AS p FROM a{i}) GROUP BY c, p) GROUP BY c
        UNION ALL SELECT c, x FROM c{i} WHERE c NOT IN (SELECT c FROM a{i}))""")
    return rf"""
      WITH {", ".join(parts)},
      told AS (SELECT c, sha256(array_to_string(x, ',')) AS centroid_sha256 FROM c{rounds})
      SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
        CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
        centroid_sha256
      FROM a{rounds} JOIN v USING (r) JOIN told USING (c)"""


TEMPLATES = ", ".join(
    f"({number}, '{label}', {str(number < len(licenses.PHRASES)).lower()}, string_split('{text}', ' '))"
    for number, (text, label) in enumerate(licenses.PHRASES + licenses.NOTICES)
)
ORACLE = {
    "op12_centroid_clustering": clustering_sql(),
    "op1_license_scan": rf"""
      WITH d AS (
        SELECT doc_id, regexp_extract_all({LOWERED}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
      t AS (SELECT * FROM (VALUES {TEMPLATES}) v(template, label, phrase, w)),
      tg AS (
        SELECT template, label, phrase, len(w) - 1 AS grams, i, w[i] || ' ' || w[i + 1] AS g
        FROM (SELECT *, unnest(range(1, len(w))) AS i FROM t)),
      dg AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] AS g
             FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d)),
      hits AS (SELECT DISTINCT doc_id, template, label, phrase, grams, dg.i - tg.i AS diagonal, tg.i AS tpos, dg.i AS p
               FROM dg JOIN tg USING (g)),
      diagonals AS (SELECT DISTINCT doc_id, template, diagonal FROM hits),
      spans AS (
        SELECT doc_id, label, phrase, d.diagonal, count(DISTINCT tpos) / max(grams) AS share, min(p) - 1 AS first
        FROM hits JOIN diagonals d USING (doc_id, template)
        WHERE hits.diagonal - d.diagonal BETWEEN 0 AND CASE WHEN phrase THEN 0 ELSE {licenses.MAX_SHIFT} END
        GROUP BY doc_id, template, label, phrase, d.diagonal),
      good AS (SELECT *, phrase AS base FROM spans WHERE share >= CASE WHEN phrase THEN 1 ELSE {licenses.MIN_SHARE} END),
      per AS (
        SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(first) FILTER (WHERE base) AS first_word,
          max(first) FILTER (WHERE base) AS last_word,
          array_to_string(list_sort(list_distinct(list(label) FILTER (WHERE base))), ',') AS base_labels,
          array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(share) AS score
        FROM good GROUP BY doc_id)
      SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
        CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
        coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
        CAST(round(coalesce(score, 0), 6) AS DOUBLE) AS score
      FROM d LEFT JOIN per USING (doc_id)""",
    "op7_chat_formatting": rf"""
      WITH c AS (SELECT DISTINCT conv_id, turn, role, text, CAST(floor(turn / {chat_views.PART_TURNS}) AS BIGINT) AS part FROM conversations),
      h AS (
        SELECT *, CAST('0x' || substr(md5(coalesce(role, '') || chr(31) || coalesce(text, '')), 1, 15) AS BIGINT) AS h,
          ceil(count(*) OVER (PARTITION BY conv_id, part) / {chat_views.PART_ROWS}) AS shares FROM c),
      k AS (SELECT *, CASE WHEN shares > 1 THEN turn END AS in_turn,
              least(shares - 1, floor(h / power(2, 60) * shares)) AS piece FROM h),
      speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM c WHERE role <> 'system'),
      s AS (
        SELECT k.conv_id, speaker, part, in_turn, piece, turn, h, role, text, coalesce(role = speaker, false) AS own,
          '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = speaker THEN 'assistant'
            ELSE 'user name=' || coalesce(role, 'unknown') END || chr(10) AS head,
          coalesce(text, '') || '<|im_end|>' AS said
        FROM k JOIN speakers ON k.conv_id IS NOT DISTINCT FROM speakers.conv_id),
      p AS (SELECT *, coalesce(sum(length(head) + length(said)) OVER (PARTITION BY conv_id, speaker, part, in_turn, piece
                      ORDER BY turn NULLS FIRST, h, role NULLS FIRST, text NULLS FIRST
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS said_at FROM s)
      SELECT conv_id, speaker, CAST(part AS BIGINT) AS part, CAST(min(turn) AS BIGINT) AS first_turn,
        CAST(piece AS BIGINT) AS piece, count(*) AS n_turns,
        string_agg(head || said, '' ORDER BY turn NULLS FIRST, h, role NULLS FIRST, text NULLS FIRST) AS text,
        coalesce(string_agg(CAST(said_at AS BIGINT) || ':' || CAST(said_at + length(said) AS BIGINT), ','
          ORDER BY said_at) FILTER (WHERE own), '') AS mask
      FROM p GROUP BY conv_id, speaker, part, in_turn, piece""",
    "op4_minhash_near_dedup": rf"""
      WITH RECURSIVE d AS (
        SELECT doc_id, {WHITE_WORDS.replace("coalesce(text, '')", LOWERED)} AS w FROM documents),
      s AS (
        SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
      n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
      links AS (
        SELECT a, b FROM (
          SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
          GROUP BY 1, 2)
        JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
      reach AS (
        SELECT doc_id AS a, doc_id AS b FROM documents
        UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
      SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, min(b) AS component_id, doc_id = min(b) AS kept
      FROM documents LEFT JOIN n USING (doc_id) JOIN reach ON a = doc_id GROUP BY doc_id, n""",
    "op5_substring_dedup": rf"""
      WITH d AS (SELECT doc_id, {WHITE_WORDS} AS w FROM documents),
      windows AS (
        SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
      later AS (
        SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY g) AS least FROM windows)
        WHERE least < doc_id),
      gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM later),
      words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
      kept AS (
        SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text
        FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
      SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
        sha256(coalesce(text, '')) AS kept_sha256
      FROM d LEFT JOIN kept USING (doc_id)""",
    "op6_quality_rules": rf"""
      WITH d AS (
        SELECT doc_id, coalesce(text, '') AS text, {WHITE_WORDS} AS w FROM documents),
      grams AS (
        SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
      again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
      covered AS (
        SELECT doc_id, count(DISTINCT p) AS n_repeat_words
        FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id),
      lines AS (
        SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
        WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]')),
      dup AS (
        SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY doc_id),
      m AS (
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
          CAST(length(regexp_replace(text, '[ \t\n\x0B\f\r]+', '', 'g')) AS BIGINT) AS word_chars,
          CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
          CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
          CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
          length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) AS n_upper,
          length(text) - length(regexp_replace(text, '\p{{L}}', '', 'g')) AS n_letters
        FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id)),
      r AS (
        SELECT *, n_words < 50 AS r0, 100 * n_repeat_words > 50 * n_words AS r1, 2 * n_symbols > n_words AS r2,
          2 * n_dup_lines > n_lines AS r3, word_chars > 40 * n_words AS r4,
          n_letters >= 50 AND 10 * n_upper > 7 * n_letters AS r5 FROM m)
      SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, r0 OR r1 AS base_failed,
        NOT (r0 OR r1 OR r2 OR r3 OR r4 OR r5) AS kept,
        CAST(r0 AS BIGINT) + 2 * CAST(r1 AS BIGINT) + 4 * CAST(r2 AS BIGINT) + 8 * CAST(r3 AS BIGINT)
          + 16 * CAST(r4 AS BIGINT) + 32 * CAST(r5 AS BIGINT) AS failures
      FROM r""",
    "op8_decontamination": r"""
      WITH d AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
          'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
      b AS (
        SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
        FROM benchmark),
      patterns AS (
        SELECT DISTINCT item, len(p) AS n, array_to_string(p, ' ') AS g
        FROM (SELECT item, w[i:least(i + 9, len(w))] AS p
              FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0))),
      sizes AS (SELECT DISTINCT n FROM patterns),
      places AS (
        SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
      hits AS (SELECT doc_id, i, n, item FROM places JOIN patterns USING (n, g)),
      words AS (SELECT doc_id, count(DISTINCT p) AS n_hit
                FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
      items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
                FROM (SELECT DISTINCT doc_id, item FROM hits WHERE item IS NOT NULL) GROUP BY doc_id)
      SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
        CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
        coalesce(n_hit, 0) > 0 AS contaminated
      FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
