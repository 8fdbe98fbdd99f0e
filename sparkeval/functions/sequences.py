"""Token-id arrays: cut, pad, mask, join and label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkeval.functions.common import ColumnOrName, as_column

IGNORE = -100  # fixed value: label of a token that takes no part in the loss


def tokens(text: ColumnOrName) -> Column:
    """Words of a text: split at blanks, tabs and line ends, no empty words."""
    return F.array_remove(F.split(as_column(text), "[ \t\n\r]+"), "")


def truncate(ids: ColumnOrName, size: int = 2048) -> Column:
    return F.slice(as_column(ids), 1, size)


def pad_to(ids: ColumnOrName, size: ColumnOrName, pad: int = 0, side: str = "right") -> Column:
    """Pad up to ``size``; longer arrays stay as they are."""
    ids = as_column(ids)
    fill = F.array_repeat(F.lit(pad), F.greatest(as_column(size) - F.size(ids), F.lit(0)))
    if side not in ("left", "right"):
        raise ValueError(f"side must be 'left' or 'right', not {side!r}")
    return F.concat(ids, fill) if side == "right" else F.concat(fill, ids)


def fix_length(ids: ColumnOrName, size: int, pad: int = 0) -> Column:
    return F.slice(pad_to(ids, F.lit(size), pad), 1, size)


def attention_mask(ids: ColumnOrName, pad: int = 0) -> Column:
    """1 for every id but the pad id. The mask looks at ids, so an end token equal to the pad id is
    masked too."""
    return F.transform(as_column(ids), lambda x: F.when(x == pad, 0).otherwise(1))


def labels(ids: ColumnOrName, prompt_length: ColumnOrName, pad: int = 0) -> Column:
    """The ids themselves, ignored over the prompt and at the pad id."""
    size = as_column(prompt_length)
    return F.transform(
        as_column(ids),
        lambda x, i: F.when((i < size) | (x == pad), F.lit(IGNORE)).otherwise(x),
    )


def mask_pads(ids: ColumnOrName, pad: int = 0) -> Column:
    return labels(ids, F.lit(0), pad)


def concat_ids(*ids: ColumnOrName) -> Column:
    return F.concat(*[as_column(x) for x in ids])


def after_prompt(ids: ColumnOrName, prompt_length: ColumnOrName) -> Column:
    ids = as_column(ids)
    return F.slice(ids, as_column(prompt_length) + 1, F.greatest(F.size(ids), F.lit(1)))


def drop_ids(ids: ColumnOrName, special: list[int]) -> Column:
    return F.filter(as_column(ids), lambda x: ~x.isin(special))


def prompt_budget(max_length: ColumnOrName, max_completion: ColumnOrName) -> Column:
    """Ids left for the prompt, 1 at least; null where no maximum is set (null or 0)."""
    size = as_column(max_length)
    return F.when(
        size.isNotNull() & (size != 0), F.greatest(F.lit(1), size - as_column(max_completion))
    )
