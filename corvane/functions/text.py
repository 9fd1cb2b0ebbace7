"""Text expressions: token sets, overlap, templates, clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prompt templates; fixed values.
TEMPLATES = {
    "Plain": "{sentence}",
    "PromptEOL_A": 'This sentence: "{sentence}" means in one word:"',
    "PromptEOL_B": 'This sentence: "{sentence}" means:"',
    "Echo": "{sentence} {sentence}",
}


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def strip(x) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def token_set(x) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(_c(x)), r"(?U)\s+"), lambda w: w != ""))


def jaccard_sets(a, b) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def jaccard(a, b) -> Column:
    """Share of common tokens; 0 where either side has none."""
    return jaccard_sets(token_set(a), token_set(b))


def templated(template: str, x) -> Column:
    return F.replace(F.lit(template), F.lit("{sentence}"), _c(x))


def title_body(title, body) -> Column:
    return strip(F.concat(F.coalesce(_c(title), F.lit("")), F.lit(" "), F.coalesce(_c(body), F.lit(""))))


def pair_key(a, b) -> Column:
    """The same for (a, b) and (b, a)."""
    return F.struct(F.least(_c(a), _c(b)).alias("lo"), F.greatest(_c(a), _c(b)).alias("hi"))
