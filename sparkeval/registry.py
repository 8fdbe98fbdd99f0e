"""User-supplied rewards, graders, metrics and batch functions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from sparkeval.functions.algebra import equivalent_algebra
from sparkeval.functions.answers import boxed_first, equivalent, exact_reward, fallback_equal

ColumnFunction = Callable[..., Column]

_rewards: dict[str, ColumnFunction] = {
    "correctness": lambda completion, answer, **_: exact_reward(boxed_first(completion), answer)
}
_metrics: dict[str, ColumnFunction] = {}
_graders: dict[str, ColumnFunction] = {
    "equivalent": equivalent,
    "fallback": fallback_equal,
    "algebra": equivalent_algebra,
}


def register_reward(name: str, function: ColumnFunction) -> None:
    """``function(completion, answer, **columns) -> Column``; a ``pandas_udf`` is such a function."""
    _rewards[name] = function


def register_grader(name: str, function: ColumnFunction) -> None:
    """``function(predicted, ground_truth) -> Column`` of booleans."""
    _graders[name] = function


def register_metric(name: str, function: ColumnFunction) -> None:
    """``function(**columns) -> Column``: an aggregate of the table's columns, built in or a grouped
    ``pandas_udf``."""
    _metrics[name] = function


def apply_metrics(df: DataFrame, names: list[str], by: list[str] | None = None) -> DataFrame:
    """One column per metric, over the whole table or per group."""
    columns = {c: df[c] for c in df.columns}
    wanted = [_lookup(_metrics, n)(**columns).alias(n) for n in names]
    return df.groupBy(*(by or [])).agg(*wanted)


def _lookup(table: dict[str, ColumnFunction], name: str) -> ColumnFunction:
    if name not in table:
        raise ValueError(f"unknown name {name!r}; registered: {sorted(table)}")
    return table[name]


def grader(name: str) -> ColumnFunction:
    return _lookup(_graders, name)


def apply_rewards(
    df: DataFrame, names: list[str], completion: str = "text", answer: str = "ground_truth"
) -> DataFrame:
    """One column per reward; each function also gets the other columns of the table by name."""
    others = {c: df[c] for c in df.columns if c not in (completion, answer)}
    return df.withColumns(
        {n: _lookup(_rewards, n)(df[completion], df[answer], **others) for n in names}
    )


def collate_with(
    df: DataFrame,
    function: Callable[[pd.DataFrame], pd.DataFrame],
    schema: T.StructType | str,
    batch: str = "batch_id",
) -> DataFrame:
    """A user's own collator, called once per batch. Batches come from ``assign_batch``, so they are
    small; the built-in collator needs no Python."""
    return df.groupBy(batch).applyInPandas(function, schema)
