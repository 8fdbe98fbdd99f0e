"""Training telemetry: metric means, loss windows, moving averages, generation logs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkeval.plans.ordering import RANGE, ROWS_PER_RANGE, numbered, prefix_maps, with_ranges
from sparkeval.plans.session import materialize
from sparkeval.plans.skew import attach, same_group


def metric_means(telemetry: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean of each metric per mode; evaluation metrics get the prefix ``eval_``."""
    name = F.when(F.col("mode") == "eval", F.concat(F.lit("eval_"), "key")).otherwise(F.col("key"))
    return telemetry.groupBy(*(by or []), "mode", name.alias("metric")).agg(
        F.avg("value").alias("mean_value")
    )


def weighted_loss() -> Column:
    """Sum of losses over sum of step shares, to 4 places; null where no weight was seen."""
    weight = F.sum("weight")
    return F.round(F.when(weight > 0, F.sum("value") / weight), 4)


def loss_windows(
    telemetry: DataFrame,
    duration: str | None = None,
    slide: str | None = None,
    session_gap: str | None = None,
    by: list[str] | None = None,
    ts: str = "ts",
) -> DataFrame:
    """Weighted loss per event-time window: tumbling, sliding (``slide``) or session (``session_gap``).

    Works on batch tables and streams alike. Groups without weight are left out.
    """
    if session_gap:
        window = F.session_window(ts, session_gap)
    elif duration:
        window = F.window(ts, duration, slide) if slide else F.window(ts, duration)
    else:
        raise ValueError("give a duration or a session gap")
    out = telemetry.groupBy(window.alias("w"), *(by or [])).agg(
        weighted_loss().alias("loss"), F.count("*").alias("n")
    )
    return out.filter(F.col("loss").isNotNull()).select(
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        *(by or []),
        "loss",
        "n",
    )


def every_step(step: str, n: int, offset: int = 0, positive: bool = True) -> Column:
    """True on each ``n``-th step."""
    hit = F.pmod(F.col(step) + offset, F.lit(n)) == 0
    return hit & (F.col(step) > 0) if positive else hit


def optimizer_steps(df: DataFrame, microstep: str, accumulation: int) -> DataFrame:
    """Rows at which an accumulation cycle ends, the only ones a moving average follows. Microsteps
    count from 1."""
    return df.filter(every_step(microstep, accumulation))


def ema(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: str,
    decay: float = 0.999,
    start: DataFrame | None = None,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Add ``ema``: the first value of a key, then decay * ema + (1 - decay) * value in ``order``.

    The whole of ``order`` is unique within ``keys``; null is a key like any other. ``start`` (keys, ema)
    continues earlier averages.

    Series that are all shorter than a block take one window. A long one is cut into order ranges, and a range into blocks short enough for ``decay**-i`` to
    stay finite. Inside a block the average is a running sum of value / decay**i, scaled back, with
    values in units of the block's largest. A block maps what it inherits to its end; these maps are
    composed along the blocks of a range and along the ranges of a key, so nothing is cut off.
    """
    x = F.col(value).cast("double")
    if not 0 <= decay <= 1:
        raise ValueError("decay must lie between 0 and 1")
    if decay == 0:
        return df.withColumn("ema", x)
    block = max(1, math.ceil(100 / -math.log(decay))) if decay < 1 else 2**62
    ranged, was_cut = with_ranges(df, keys, order, rows_per_range)
    longest = 0 if was_cut else df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if not was_cut and longest <= block:
        return _short_series(df, keys, order, x, decay, start)
    here = Window.partitionBy(*keys, RANGE).orderBy(*order)
    units = [*keys, RANGE, "_block"]
    inside = Window.partitionBy(*units).orderBy("_i").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    placed = (
        ranged.withColumn("_x", x)
        .withColumn("_place", (F.row_number().over(here) - 1).cast("bigint"))
        .withColumn("_block", F.floor(F.col("_place") / block))
        .withColumn("_i", F.pmod(F.col("_place"), F.lit(block)) + 1)
        .withColumn("_m", F.max(F.abs("_x")).over(Window.partitionBy(*units)))
        .withColumn("_m", F.when(F.col("_m") > 0, F.col("_m")).otherwise(1.0))
    )
    power = F.pow(F.lit(float(decay)), F.col("_i"))
    scaled = F.sum(F.col("_x") / F.col("_m") / power).over(inside) * power
    local = placed.withColumn("_own", (1 - decay) * F.coalesce(scaled, F.lit(0.0)) * F.col("_m"))

    ends = local.groupBy(*units).agg(
        F.count("*").alias("_n"), F.max_by("_own", "_i").alias("_b"), F.min_by("_x", "_i").alias("_x0")
    ).withColumn("_a", F.pow(F.lit(float(decay)), F.col("_n")))
    if was_cut:
        ends = materialize(ends, "ends")
        most = ends.agg(F.max("_block")).first()[0] + 1
        ranges = ranged.agg(F.max(RANGE)).first()[0] + 1
    else:
        most, ranges = math.ceil(longest / block), 1
    within = prefix_maps(ends.withColumns({"_pa": F.col("_a"), "_pb": F.col("_b")}), [*keys, RANGE], "_block", "_pa", "_pb", most)
    last = F.struct(
        (F.col("_a") * F.col("_pa")).alias("a"), (F.col("_b") + F.col("_a") * F.col("_pb")).alias("b")
    )
    whole = within.groupBy(*keys, RANGE).agg(
        F.max_by(last, "_block").alias("_last"), F.min_by("_x0", "_block").alias("_x0")
    ).select(*keys, RANGE, "_x0", F.col("_last.a").alias("_ra"), F.col("_last.b").alias("_rb"))
    first = F.first("_x0").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(RANGE))
    across = prefix_maps(whole.withColumn("_start", first), keys, RANGE, "_ra", "_rb", ranges).drop("_x0")
    if start is not None:
        given = start.select(*keys, F.col("ema").alias("_given"))
        across = same_group(across, given, keys, "left").withColumn("_start", F.coalesce("_given", "_start"))
    across = across.select(*keys, RANGE, (F.col("_ra") * F.col("_start") + F.col("_rb")).alias("_into"))
    inherited = same_group(within.select(*units, "_pa", "_pb"), across, [*keys, RANGE], "inner").select(
        *units, (F.col("_pa") * F.col("_into") + F.col("_pb")).alias("_inherited")
    )
    joined = same_group(local, inherited, units, "inner")
    return joined.select(*df.columns, (F.col("_own") + power * F.col("_inherited")).alias("ema"))


def _short_series(
    df: DataFrame, keys: list[str], order: list[str], x: Column, decay: float, start: DataFrame | None
) -> DataFrame:
    """``ema`` where every series is one block."""
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    ordered = whole.orderBy(*order)
    unit = F.max(F.abs("_x")).over(whole)
    placed = df.withColumn("_x", x).withColumns(
        {
            "_i": F.row_number().over(ordered),
            "_start": F.first("_x").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
            "_m": F.when(unit > 0, unit).otherwise(1.0),
        }
    )
    if start is not None:
        given = start.select(*keys, F.col("ema").alias("_given"))
        placed = same_group(placed, given, keys, "left").withColumn("_start", F.coalesce("_given", "_start"))
    power = F.pow(F.lit(float(decay)), F.col("_i"))
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scaled = F.sum(F.col("_x") / F.col("_m") / power).over(upto) * power
    own = (1 - decay) * F.coalesce(scaled, F.lit(0.0)) * F.col("_m")
    return placed.select(*df.columns, (own + power * F.col("_start")).alias("ema"))


def flush_step(step: str, every: int = 5) -> Column:
    """Step at which a record is written: the next multiple of ``every``, not before the first."""
    return F.greatest(F.ceil(F.col(step) / every) * every, F.lit(every)).cast("long")


def generation_log(
    df: DataFrame, step: str = "step", order: str = "seq", every: int = 5, **ranges
) -> DataFrame:
    """Records (step, prompt, completion) with the flush they belong to and their place in it."""
    flushed = df.withColumn("flush_step", flush_step(step, every))
    return numbered(flushed, ["flush_step"], [order], "place", **ranges)


def generation_log_files(
    log: DataFrame, step: str = "step", part_size: int = 1000, rows_per_salt: int = 1_000_000
) -> DataFrame:
    """(flush_step, part, num_samples, generations[]): the records of a flush, nested.

    ``num_samples`` counts the flush; a flush of more than ``part_size`` records continues in parts.
    """
    record = F.struct("place", F.col(step).alias("step"), "prompt", "completion")
    parts = (
        log.withColumn("part", F.floor(F.col("place") / part_size).cast("long"))
        .groupBy("flush_step", "part")
        .agg(F.array_sort(F.collect_list(record)).alias("_records"))
    )
    counts = log.groupBy("flush_step").agg(F.count("*").alias("num_samples"))
    joined = attach(
        parts, counts, ["flush_step"], ["part"], "num_samples", rows_per_salt=rows_per_salt
    )
    generations = F.transform("_records", lambda r: r.dropFields("place"))
    return joined.select("flush_step", "part", "num_samples", generations.alias("generations"))
