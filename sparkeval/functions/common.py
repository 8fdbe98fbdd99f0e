"""Small helpers shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def as_column(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times inside ``body``.

    Inside higher-order functions Spark shares no common subexpressions, so a value used by a lambda
    would otherwise be recomputed for each array element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
