"""Distances between next-token distributions; embeddings play the logits of student and teacher."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindings import Bindings
from bindings.tables import rounded, table
from sparkeval.functions import distributions as D
from sparkeval.functions.sequences import IGNORE, mask_pads
from sparkeval.operators import distributions as O
from sparkeval.operators import shards as H
from sparkeval.plans.session import materialize, spread

B = Bindings()
T = 0.1
K = 8
KEYS = ["seq_id", "pos"]


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """(vec_id, seq_id, pos, label, token_id, logits): eight positions to a sequence."""
    token = F.pmod("vec_id", F.lit(64)).cast("int")
    return spread(table(spark, d, "embeddings"), "vec_id").select(
        "vec_id",
        F.floor(F.col("vec_id") / 8).alias("seq_id"),
        F.pmod("vec_id", F.lit(8)).cast("int").alias("pos"),
        F.when(F.col("label") == 0, F.lit(IGNORE)).otherwise(token).alias("label"),
        token.alias("token_id"),
        F.col("embedding").alias("logits"),
    )


def paired(spark: SparkSession, d: str) -> DataFrame:
    """The teacher's vector for a position is the one of the next ``vec_id``, in a circle."""
    student = vectors(spark, d)
    size = table(spark, d, "embeddings").select(F.count("*")).scalar()
    source = table(spark, d, "embeddings").withColumn("_n", size)
    home = F.pmod(F.col("vec_id") - 1 + F.col("_n"), F.col("_n"))
    teacher = source.select(home.alias("vec_id"), F.col("embedding").alias("logits"))
    return O.pair(student, teacher, ["vec_id"])


LONG = """pairs AS (
  SELECT s.vec_id, s.vec_id // 8 AS seq_id, CAST(s.vec_id % 8 AS INTEGER) AS pos,
         CASE WHEN s.label = 0 THEN -100 ELSE CAST(s.vec_id % 64 AS INTEGER) END AS label,
         CAST(s.vec_id % 64 AS INTEGER) AS token, s.embedding AS sv, t.embedding AS tv
  FROM embeddings s JOIN embeddings t ON t.vec_id = (s.vec_id + 1) % (SELECT count(*) FROM embeddings)),
cells AS (
  SELECT vec_id, seq_id, pos, label, token, generate_subscripts(sv, 1) - 1 AS token_id,
         CAST(unnest(sv) AS DOUBLE) AS s, CAST(unnest(tv) AS DOUBLE) AS t FROM pairs)"""
RANKED = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY t DESC, token_id) AS rank FROM cells)"""
TERMS = {
    0.0: "exp(lt) * (lt - ls)",
    1.0: "exp(ls) * (ls - lt)",
}


def mixture(beta: float) -> str:
    m = f"ln({1 - beta} * exp(ls) + {beta} * exp(lt))"
    return f"{beta} * exp(lt) * (lt - {m}) + {1 - beta} * exp(ls) * (ls - {m})"


def softmax_sql(source: str = "cells", t: float = T) -> str:
    return f"""logs AS (
  SELECT *, s / {t} - ln(sum(exp(s / {t})) OVER p) AS ls, t / {t} - ln(sum(exp(t / {t})) OVER p) AS lt
  FROM {source} WINDOW p AS (PARTITION BY vec_id))"""


def divergence_sql(term: str, source: str = "cells", more: str = "") -> str:
    return f"""WITH {LONG}{more}, {softmax_sql(source)},
div AS (SELECT vec_id, seq_id, pos, label, sum({term}) AS divergence FROM logs GROUP BY ALL)"""


ROWS = "SELECT vec_id, round(divergence, 6) + 0.0 AS divergence FROM div"


def clean(df: DataFrame, *columns: str) -> DataFrame:
    """Rounded, and without negative zeros."""
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in columns})


def diverged(spark: SparkSession, d: str, beta: float, **options) -> DataFrame:
    term = D.divergence("student", "teacher", beta, T, **options)
    return paired(spark, d).select("vec_id", *KEYS, "label", term.alias("divergence"))


@B.add(
    "pair_distributions",
    f"""WITH {LONG} SELECT vec_id, seq_id, pos, round(sum(s * t), 6) + 0.0 AS dot FROM cells
GROUP BY ALL""",
)
def pair_distributions(spark, d):
    product = F.zip_with("student", "teacher", lambda s, t: s.cast("double") * t.cast("double"))
    dot = F.aggregate(product, F.lit(0.0), lambda a, x: a + x)
    return clean(paired(spark, d).select("vec_id", *KEYS, dot.alias("dot")), "dot")


@B.add(
    "gather_token",
    f"""WITH {LONG} SELECT seq_id, pos, CAST(token_id AS INTEGER) AS token_id, round(s, 6) + 0.0 AS s, round(t, 6) + 0.0 AS t
FROM cells WHERE token_id = token""",
)
def gather_token(spark, d):
    return clean(O.gather(paired(spark, d), "token_id"), "s", "t")


@B.add(
    "temp_scale",
    """SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS token_id,
  round(CAST(unnest(embedding) AS DOUBLE) / 0.1, 6) + 0.0 AS scaled FROM embeddings""",
)
def temp_scale(spark, d):
    cells = F.posexplode(D.temperature_scale("logits", T)).alias("token_id", "scaled")
    out = vectors(spark, d).select("vec_id", cells)
    return clean(out.withColumn("token_id", F.col("token_id").cast("long")), "scaled")


@B.add(
    "log_softmax",
    f"""WITH {LONG}, {softmax_sql()}
SELECT vec_id, token_id, round(ls, 6) + 0.0 AS logprob FROM logs""",
)
def log_softmax(spark, d):
    cells = F.posexplode(D.log_softmax("logits", T)).alias("token_id", "logprob")
    out = vectors(spark, d).select("vec_id", cells)
    return clean(out.withColumn("token_id", F.col("token_id").cast("long")), "logprob")


@B.add(
    "probs_input",
    f"""WITH {LONG}, logs AS (
  SELECT *, ln(greatest(s, 1e-8)) AS ls, ln(greatest(t, 1e-8)) AS lt FROM cells)
SELECT vec_id, round(sum({mixture(0.5)}), 6) + 0.0 AS divergence FROM logs GROUP BY vec_id""",
)
def probs_input(spark, d):
    out = diverged(spark, d, 0.5, are_probs=True)
    return clean(out.select("vec_id", "divergence"), "divergence")


@B.add("kl_forward", f"{divergence_sql(TERMS[0.0])} {ROWS}")
def kl_forward(spark, d):
    return clean(diverged(spark, d, 0).select("vec_id", "divergence"), "divergence")


@B.add("kl_reverse", f"{divergence_sql(TERMS[1.0])} {ROWS}")
def kl_reverse(spark, d):
    return clean(diverged(spark, d, 1).select("vec_id", "divergence"), "divergence")


@B.add("jsd", f"{divergence_sql(mixture(0.3))} {ROWS}")
def jsd(spark, d):
    return clean(diverged(spark, d, 0.3).select("vec_id", "divergence"), "divergence")


TOP = f", {RANKED}, top AS (SELECT * FROM ranked WHERE rank <= {K})"


@B.add("jsd_topk", f"{divergence_sql(mixture(0.5), 'top', TOP)} {ROWS}")
def jsd_topk(spark, d):
    return clean(diverged(spark, d, 0.5, top_k=K).select("vec_id", "divergence"), "divergence")


@B.add(
    "jsd_long",
    f"""{divergence_sql(mixture(0.5), 'top', TOP)}
SELECT seq_id, pos, round(divergence, 6) + 0.0 AS divergence FROM div""",
)
def jsd_long(spark, d):
    """The same from the long form, one row per vocabulary entry."""
    cells = O.explode_vocabulary(paired(spark, d))
    return clean(O.divergence_long(cells, 0.5, T, K), "divergence")


@B.add("jsd_sharded", f"{divergence_sql(mixture(0.3))} SELECT seq_id, pos, round(divergence, 6) + 0.0 AS divergence FROM div")
def jsd_sharded(spark, d):
    """The whole vocabulary, in shards of 16 entries."""
    cells = O.explode_vocabulary(paired(spark, d))
    return clean(H.divergence_sharded(cells, 0.3, T, size=16), "divergence")


@B.add(
    "topk_select",
    f"""WITH {LONG}, {RANKED} SELECT vec_id, token_id, rank, round(t, 6) + 0.0 AS t
FROM ranked WHERE rank <= {K}""",
)
def topk_select(spark, d):
    """The k largest from the k largest of each shard."""
    kept = H.top_k_sharded(O.explode_vocabulary(paired(spark, d), ["vec_id"]), K, 16, ["vec_id"])
    each = kept.select("vec_id", F.posexplode("cells").alias("at", "c"))
    ranked = each.select("vec_id", F.col("c.token_id").cast("long").alias("token_id"), (F.col("at") + 1).cast("long").alias("rank"), F.col("c.t").alias("t"))
    return clean(ranked, "t")


@B.add(
    "topk_vocab",
    f"""WITH {LONG}, {RANKED} SELECT vec_id, token_id, rank, round(t, 6) + 0.0 AS t
FROM ranked WHERE rank <= {K}""",
)
def topk_vocab(spark, d):
    cells = O.explode_vocabulary(paired(spark, d), ["vec_id"])
    top = O.top_k_cells(cells, K, ["vec_id"]).select(
        "vec_id", F.col("token_id").cast("long"), F.col("rank").cast("long"), "t"
    )
    return clean(top, "t")


@B.add(
    "jsd_masked",
    f"""{divergence_sql(mixture(0.5))}
SELECT vec_id, label, round(divergence, 6) + 0.0 AS divergence FROM div WHERE label <> -100""",
)
def jsd_masked(spark, d):
    rows = diverged(spark, d, 0.5).select("vec_id", "label", "divergence")
    return clean(O.reduce_divergence(rows, "none"), "divergence")


@B.add(
    "mask_tokens",
    """SELECT vec_id // 8 AS seq_id, count(*) AS tokens, count(*) FILTER (WHERE label <> 0) AS unmasked,
  string_agg(CASE WHEN label = 0 THEN '-100' ELSE CAST(label AS VARCHAR) END, ' ' ORDER BY vec_id)
    AS labels
FROM embeddings GROUP BY vec_id // 8""",
)
def mask_tokens(spark, d):
    """Sequences of eight ids in which the pad id 0 is masked."""
    rows = table(spark, d, "embeddings").select(
        F.floor(F.col("vec_id") / 8).alias("seq_id"), F.struct("vec_id", "label").alias("cell")
    )
    cells = F.array_sort(F.collect_list("cell"))
    ids = rows.groupBy("seq_id").agg(F.transform(cells, lambda c: c["label"]).alias("ids"))
    made = ids.withColumn("made", mask_pads("ids"))
    return made.select(
        "seq_id",
        F.size("made").cast("long").alias("tokens"),
        F.size(F.filter("made", lambda x: x != IGNORE)).cast("long").alias("unmasked"),
        F.array_join(F.transform("made", lambda x: x.cast("string")), " ").alias("labels"),
    )


REDUCTIONS = """
SELECT 'batchmean' AS reduction, round(sum(divergence) / count(*), 6) AS loss FROM div WHERE label <> -100
UNION ALL SELECT 'sum', round(sum(divergence), 6) FROM div WHERE label <> -100
UNION ALL SELECT 'mean', round(sum(divergence) / (64 * count(*)), 6) FROM div WHERE label <> -100
UNION ALL SELECT 'batchmean, no labels', round(sum(divergence) / count(DISTINCT seq_id), 6) FROM div"""


@B.add("jsd_reductions", divergence_sql(mixture(0.5)) + REDUCTIONS)
def jsd_reductions(spark, d):
    rows = materialize(diverged(spark, d, 0.5).withColumn("cells", F.lit(64)), "divergence")
    losses = {
        "batchmean": O.reduce_divergence(rows),
        "sum": O.reduce_divergence(rows, "sum"),
        "mean": O.reduce_divergence(rows, "mean", vocabulary="cells"),
        "batchmean, no labels": O.reduce_divergence(rows, label=None),
    }
    named = [df.select(F.lit(n).alias("reduction"), "loss") for n, df in losses.items()]
    return reduce(DataFrame.unionByName, named).withColumns(rounded("loss"))


SAMPLED = f"""WITH {LONG}, {softmax_sql()}, sampled AS (
  SELECT vec_id, seq_id, pos, label, token_id, ls AS student_logprob, lt AS teacher_logprob,
         lt - ls AS advantage FROM logs WHERE token_id = token)"""


def advantages(spark: SparkSession, d: str) -> DataFrame:
    return O.token_advantage(paired(spark, d), temperature=T)


@B.add(
    "sampled_logprob",
    f"""{SAMPLED} SELECT vec_id, token_id, round(student_logprob, 6) AS student_logprob,
  round(teacher_logprob, 6) AS teacher_logprob FROM sampled""",
)
def sampled_logprob(spark, d):
    out = advantages(spark, d).select(
        "vec_id", F.col("token_id").cast("long"), "student_logprob", "teacher_logprob"
    )
    return clean(out, "student_logprob", "teacher_logprob")


@B.add(
    "token_advantage",
    f"{SAMPLED} SELECT seq_id, pos, round(advantage, 6) + 0.0 AS advantage FROM sampled",
)
def token_advantage(spark, d):
    return clean(advantages(spark, d).select(*KEYS, "advantage"), "advantage")


@B.add(
    "pg_objective",
    f"""{SAMPLED} SELECT round(-avg(advantage * student_logprob), 6) + 0.0 AS objective
FROM sampled WHERE label <> -100""",
)
def pg_objective(spark, d):
    return clean(O.pg_objective(advantages(spark, d)), "objective")


@B.add(
    "divergence_profile",
    f"""{divergence_sql(mixture(0.5))}
SELECT pos, count(*) AS tokens, round(avg(divergence), 6) AS mean_divergence,
       round(max(divergence), 6) AS max_divergence FROM div GROUP BY pos""",
)
def profile_by_position(spark, d):
    out = O.divergence_profile(diverged(spark, d, 0.5), ["pos"])
    return clean(out, "mean_divergence", "max_divergence")


@B.add(
    "advantage_profile",
    f"""{SAMPLED} SELECT seq_id, count(*) AS tokens, round(avg(advantage), 6) + 0.0 AS mean_advantage,
       round(max(advantage), 6) + 0.0 AS max_advantage FROM sampled GROUP BY seq_id""",
)
def profile_by_sequence(spark, d):
    out = O.divergence_profile(advantages(spark, d), ["seq_id"], "advantage")
    return clean(out, "mean_advantage", "max_advantage")


@B.add(
    "ema_table_update",
    f"""WITH {LONG} SELECT vec_id, token_id, round(s * 0.9 + t * 0.1, 6) + 0.0 AS value FROM cells""",
)
def ema_table_update(spark, d):
    """State: each vector; parameters: the teacher's vector of the same name."""
    rows = paired(spark, d)
    state = rows.select(F.col("vec_id").alias("name"), F.col("student").alias("values"))
    params = rows.select(F.col("vec_id").alias("name"), F.col("teacher").alias("values"))
    out = O.ema_update(state, params, 0.9)
    cells = out.select(
        F.col("name").alias("vec_id"), F.posexplode("values").alias("token_id", "value")
    )
    return clean(cells.withColumn("token_id", F.col("token_id").cast("long")), "value")
