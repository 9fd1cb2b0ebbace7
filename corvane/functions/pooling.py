"""Pooling of token states: array<struct<pos, mask, h>> to one vector."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import let, scaled


def _kept(tokens) -> Column:
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.filter(F.array_sort(t), lambda x: x["mask"] == 1)


def mean_pool(tokens) -> Column:
    """Sum of unmasked states over max(count, 1e-9)."""

    def mean(kept):
        zero = F.array_repeat(F.lit(0.0), F.size(kept[0]["h"]))
        total = F.aggregate(kept, zero, lambda s, x: F.zip_with(s, x["h"], lambda a, b: a + b.cast("double")))
        return scaled(total, F.greatest(F.size(kept).cast("double"), F.lit(1e-9)))

    return let(_kept(tokens), mean)


def last_pool(tokens) -> Column:
    return F.try_element_at(_kept(tokens), F.lit(-1))["h"].cast("array<double>")


def second_last_pool(tokens) -> Column:
    """The state before the last; the first where there is only one."""
    return let(_kept(tokens), lambda kept: F.coalesce(F.try_element_at(kept, F.lit(-2)), F.try_element_at(kept, F.lit(1)))["h"].cast("array<double>"))
