"""Telemetry over events, in batch and as streams, and the streaming evaluation over lineitem."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bindings import Bindings
from bindings.evaluation import RUNNING, SUMMARY_SQL, VAL_N, WITH_TOTALS
from bindings.tables import CORPUS_SQL, EVALUATED, completions, corpus, problems, rounded, table, votes_sql
from sparkeval.operators import grading
from sparkeval.operators import telemetry as M
from sparkeval.plans.session import materialize, work_dir
from sparkeval.registry import apply_metrics, register_metric
from sparkeval.sources.tables import read_completions, stream_table
from sparkeval.streaming import curve
from sparkeval.streaming import operators as streams
from sparkeval.streaming import state
from sparkeval.streaming.tables import appended, latest, start

B = Bindings()
SERIES = ["user_id", "event_type"]
ORDER = ["ts", "event_id"]
DECAY = 0.9
TIE = 3e-10  # averages of values with two decimals often end in an exact 5: round those upwards
STAMP = "yyyy-MM-dd HH:mm:ss"


def as_telemetry(events: DataFrame) -> DataFrame:
    """Two micro-batches to a step, so that each weighs one half; errors stand for off-policy rows."""
    return events.select(
        "ts",
        "event_id",
        F.col("user_id"),
        F.col("event_type").alias("key"),
        (F.col("event_type") != "error").alias("on_policy"),
        F.when(F.col("event_type").isin("view", "error"), "eval").otherwise("train").alias("mode"),
        "value",
        F.lit(0.5).alias("weight"),
    )


def events(spark: SparkSession, d: str) -> DataFrame:
    return as_telemetry(table(spark, d, "events"))


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    return stream_table(spark, d, "events.parquet", table(spark, d, "events").schema)


def stamped(windows: DataFrame) -> DataFrame:
    """Window bounds as text: engines differ in their time types."""
    return windows.withColumns(
        {c: F.date_format(c, STAMP) for c in ("window_start", "window_end")}
    )


def window_sql(days: int, starts: str) -> str:
    return f"""SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start,
  strftime(w + INTERVAL {days} DAY, '%Y-%m-%d %H:%M:%S') AS window_end, event_type <> 'error' AS on_policy,
  round(sum(value) / (0.5 * count(*)), 4) AS loss, count(*) AS n
FROM (SELECT *, {starts} AS w FROM events) GROUP BY w, event_type <> 'error'"""


DAILY = window_sql(1, "date_trunc('day', ts)")


@B.add("loss_window", DAILY)
def loss_window(spark, d):
    return stamped(M.loss_windows(events(spark, d), "1 day", by=["on_policy"]))


@B.add(
    "loss_window_sliding",
    window_sql(2, "unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY])"),
)
def loss_window_sliding(spark, d):
    return stamped(M.loss_windows(events(spark, d), "2 days", "1 day", by=["on_policy"]))


@B.add(
    "loss_window_session",
    """WITH marked AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER u <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events
  WINDOW u AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM marked)
SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS window_start,
  strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, user_id,
  round(sum(value) / (0.5 * count(*)), 4) AS loss, count(*) AS n
FROM numbered GROUP BY user_id, s""",
)
def loss_window_session(spark, d):
    rows = events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return stamped(M.loss_windows(rows, session_gap="6 hours", by=["user_id"]))


@B.add(
    "metric_mean",
    """SELECT CASE WHEN event_type IN ('view', 'error') THEN 'eval' ELSE 'train' END AS mode,
  CASE WHEN event_type IN ('view', 'error') THEN 'eval_' ELSE '' END || event_type AS metric,
  round(avg(value), 6) AS mean_value FROM events GROUP BY event_type""",
)
def metric_mean(spark, d):
    return M.metric_means(events(spark, d)).withColumns(rounded("mean_value"))


EMA = f"""WITH numbered AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events)
SELECT a.event_id, a.user_id, a.event_type,
  round(sum(b.value * CASE WHEN b.i = 1 THEN {DECAY} ** (a.i - 1)
                           ELSE (1 - {DECAY}) * {DECAY} ** (a.i - b.i) END) + {TIE}, 6) AS ema
FROM numbered a JOIN numbered b
  ON b.user_id = a.user_id AND b.event_type = a.event_type AND b.i <= a.i
GROUP BY a.event_id, a.user_id, a.event_type"""


def ema_columns(df: DataFrame) -> DataFrame:
    return df.select("event_id", *SERIES, F.round(F.col("ema") + TIE, 6).alias("ema"))


@B.add("ema_series", EMA)
def ema_series(spark, d):
    return ema_columns(M.ema(table(spark, d, "events"), SERIES, ORDER, "value", DECAY))


@B.add(
    "ema_accumulated",
    EMA.replace("FROM events)", "FROM events WHERE event_id > 0 AND event_id % 4 = 0)"),
)
def ema_accumulated(spark, d):
    """Follows only the rows at which an accumulation cycle of four ends."""
    rows = M.optimizer_steps(table(spark, d, "events"), "event_id", 4)
    return ema_columns(M.ema(rows, SERIES, ORDER, "value", DECAY))


@B.add(
    "metric_registry",
    """SELECT event_type, round(max(value) - min(value), 6) AS spread, count(*) FILTER (WHERE value > 50) AS high
FROM events GROUP BY event_type""",
)
def metric_registry(spark, d):
    """Two metrics of a user's own."""
    register_metric("spread", lambda value, **_: F.round(F.max(value) - F.min(value), 6))
    register_metric("high", lambda value, **_: F.count_if(value > 50))
    return apply_metrics(table(spark, d, "events"), ["spread", "high"], ["event_type"])


@B.add(
    "step_filter",
    """SELECT event_id, event_id > 0 AND event_id % 5 = 0 AS flush, (event_id + 1) % 10 = 0 AS progress,
  event_id % 4 = 0 AS log FROM events""",
)
def step_filter(spark, d):
    return table(spark, d, "events").select(
        "event_id",
        M.every_step("event_id", 5).alias("flush"),
        M.every_step("event_id", 10, 1, False).alias("progress"),
        M.every_step("event_id", 4, 0, False).alias("log"),
    )


# Streams -------------------------------------------------------------------------------------------


@B.add("stream_metrics", f"{WITH_TOTALS} SELECT {SUMMARY_SQL} FROM totals")
def stream_metrics(spark, d):
    """Evaluates a stream of completions; they are stored first, a stream cannot number them."""
    path, arrivals = work_dir(spark, "stream-metrics"), work_dir(spark, "arrivals")
    rows = completions(spark, d)
    rows.write.parquet(arrivals)
    stream = read_completions(spark, arrivals, streaming=True, schema=rows.schema)
    streams.stream_metrics(stream, path).awaitTermination()
    asked = problems(spark, d)
    out = grading.summary(streams.stream_scores(spark, path, asked), asked, VAL_N)
    return out.withColumns(
        rounded("pass_at_n_pct", "average_at_n_pct", "majority_vote_at_n_pct", "format_rate")
    )


def in_waves(
    rows: DataFrame, wave: Column, waves: int, follow: Callable[[DataFrame], StreamingQuery]
) -> None:
    """Start ``follow`` again after each of the arrivals, which are rows with one value of ``wave``."""
    spark, path = rows.sparkSession, work_dir(rows.sparkSession, "waves")
    for n in range(waves):
        rows.filter(wave == n).write.mode("append").parquet(path)
        follow(spark.readStream.schema(rows.schema).parquet(path)).awaitTermination()


@B.add("stream_running_metrics", f"{RUNNING} SELECT * FROM running")
def stream_running_metrics(spark, d):
    """The curve of an evaluation whose samples come in three micro-batches, many of them late."""
    path = work_dir(spark, "stream-running")
    rows, asked = materialize(completions(spark, d), "completions"), problems(spark, d)
    wave = F.pmod(F.xxhash64("problem_id", "sample_idx"), F.lit(3))
    in_waves(rows, wave, 3, lambda s: curve.stream_running_metrics(s, path, asked, block_size=10_000))
    out = curve.read_running_metrics(spark, path, asked, VAL_N)
    return out.withColumns(rounded("pass_at_n_pct", "average_at_n_pct", "format_rate"))


KEPT = EVALUATED.replace("completions AS (", "sampled AS (", 1).replace(
    "last_box AS (",
    """completions AS (SELECT * FROM sampled WHERE (problem_id + sample_idx) % 5 <> 0),
last_box AS (""",
    1,
)


@B.add(
    "resume_incremental",
    f"""WITH {KEPT},
{votes_sql()}
SELECT problem_id, num_samples, num_correct, num_formatted, has_correct, majority_vote_correct FROM scored""",
)
def resume_incremental(spark, d):
    """Every third sample comes without an answer first and is replaced; every fifth is taken back."""
    path = work_dir(spark, "answers")
    rows = materialize(completions(spark, d), "completions").drop("run_id")
    third, fifth = F.col("sample_idx") % 3 == 1, (F.col("problem_id") + F.col("sample_idx")) % 5 == 0
    draft = rows.withColumn("text", F.when(~third, F.col("text")))
    waves = ((draft, 0, False), (rows.filter(third), 1, False), (rows.filter(fifth), 2, True))
    changes = [
        part.withColumns({"version": F.lit(n), "retracted": F.lit(gone), "text": F.lit(None) if gone else F.col("text")})
        for part, n, gone in waves
    ]
    in_waves(reduce(DataFrame.union, changes), F.col("version"), 3, lambda s: curve.stream_answers(s, path))
    return curve.read_scores(spark, path, problems(spark, d))


@B.add("stream_loss_window", DAILY)
def stream_loss_window(spark, d):
    path = work_dir(spark, "stream-loss")
    rows = as_telemetry(event_stream(spark, d))
    streams.stream_loss_windows(rows, path, "1 hour", "1 day", by=["on_policy"]).awaitTermination()
    return stamped(latest(spark, path, ["window_start", "window_end", "on_policy"]))


@B.add("stream_ema", EMA)
def stream_ema(spark, d):
    path = work_dir(spark, "stream-ema")
    rows = event_stream(spark, d)
    streams.stream_ema(rows, path, SERIES, ORDER, "value", DECAY).awaitTermination()
    return ema_columns(appended(spark, path))


NEWEST = """SELECT event_id, user_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
WHERE r <= 3"""


@B.add("stream_last_n", NEWEST)
def stream_last_n(spark, d):
    path = work_dir(spark, "stream-last")
    rows = event_stream(spark, d).drop("props")
    streams.stream_last_n(rows, path, ["user_id"], ORDER, 3).awaitTermination()
    newest = streams.read_last_n(spark, path)
    return newest.select("event_id", *SERIES, "value")


@B.add("stream_ema_state", EMA)
def stream_ema_state(spark, d):
    """The averages in a keyed state store."""
    path = work_dir(spark, "stream-ema-state")
    rows = event_stream(spark, d).drop("props")
    state.stream_ema_state(rows, path, SERIES, ORDER, "value", DECAY).awaitTermination()
    return ema_columns(appended(spark, path))


@B.add("stream_last_n_state", NEWEST)
def stream_last_n_state(spark, d):
    """Read from the state store itself, where a user's rows lie in shares."""
    path = work_dir(spark, "stream-last-state")
    rows = event_stream(spark, d).drop("props")
    state.stream_last_n_state(rows, path, ["user_id"], ORDER, 3).awaitTermination()
    newest = state.read_last_n_state(spark, path, ["user_id"], ORDER, 3)
    return newest.select("event_id", *SERIES, "value")


@B.add(
    "stream_sample",
    f"WITH {CORPUS_SQL} SELECT doc_id, problem FROM corpus ORDER BY md5('42:' || doc_id), doc_id LIMIT 50",
)
def stream_sample(spark, d):
    """The sample of a table that grows three times is that of the whole table."""
    path = work_dir(spark, "stream-sample")
    rows = corpus(spark, d).select("doc_id", "problem")
    wave = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    in_waves(rows, wave, 3, lambda s: streams.stream_sample(s, path, 50, 42, "doc_id"))
    return streams.read_sample(spark, path)


@B.add(
    "stream_callback",
    "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type",
)
def stream_callback(spark, d):
    """A user's function per micro-batch: it stores sums under the number of the batch."""
    path = work_dir(spark, "stream-callback")

    def sums(batch: DataFrame, batch_id: int) -> None:
        found = batch.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        found.write.mode("overwrite").parquet(f"{path}/changes/batch={batch_id}")

    start(event_stream(spark, d), path, sums, "append").awaitTermination()
    return appended(spark, path).groupBy("event_type").agg(
        F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total")
    )


@B.add("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, d):
    """First event of each user and type; which copy comes first depends on the arrival."""
    path = work_dir(spark, "stream-dedup")
    rows = event_stream(spark, d)
    streams.stream_dedup(rows, path, SERIES, "30 days", ["event_id"]).awaitTermination()
    return appended(spark, path).select(*SERIES)
