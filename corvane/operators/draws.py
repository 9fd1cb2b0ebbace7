"""Seeded draws without replacement that need no number for every row: a keyed permutation of 0 to n - 1.

A number is written with two digits, to the bases a = ceil(sqrt(n)) and b = ceil(n / a), and the rounds of a Feistel network
add to each digit in turn a mixture of the other, modulo its base. That permutes the numbers below a b, of which fewer than
a are n or above; a number that falls on one of these is permuted again until it falls below n (cycle walking), so the whole
is a bijection of 0 to n - 1. The draw of size k is the set of ordinals whose place is below k: no list is made, and every row
is decided by itself. Mixtures are sums, products and shifts of numbers below 2^62, which any SQL engine repeats exactly.

It is another stream than that of a generator that shuffles a list; ``tables.seeded_rows`` is the draw that equals NumPy's.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import let

ROUNDS = 6
#: Factors of the mixtures; any odd numbers would do.
FACTORS = (668265263, 374761393, 1103515245)
#: Walks that are written out for all rows; the few that need more (fewer than one in sqrt(n) at each) go on by themselves.
WALKS = 2
#: More walks than a cycle can take up to 64^2 numbers, and than one does beyond with any likelihood.
MOST = 64


def bases(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def round_keys(seed: int) -> list[int]:
    return [(seed * 40503 + 7919 * (i + 1) ** 3) % (1 << 31) for i in range(ROUNDS)]


def permuted(x: int, n: int, seed: int) -> int:
    """The place of x, in plain Python."""
    a, b = bases(n)
    while True:
        hi, lo = divmod(x, b)
        for i, k in enumerate(round_keys(seed)):
            mix = lambda v: (v + k) % (1 << 31) * FACTORS[i % 3] >> 15  # noqa: B023, E731
            if i % 2:
                lo = (lo + mix(hi)) % b
            else:
                hi = (hi + mix(lo)) % a
        x = hi * b + lo
        if x < n:
            return x


def _mix(v: Column, i: int, seed: int) -> Column:
    return F.shiftright(F.pmod(v + F.lit(round_keys(seed)[i]), F.lit(1 << 31)) * F.lit(FACTORS[i % 3]), 15)


def _digits(x: Column, b: int) -> tuple[Column, Column]:
    lo = F.pmod(x, F.lit(b).cast("long"))
    return ((x - lo) / b).cast("long"), lo


def _again(x: Column, n: int, seed: int) -> Column:
    """One walk as one expression, for the rows that need more than are written out."""
    a, b = bases(n)

    def rounds(s, i=0):
        if i == ROUNDS:
            return s["hi"] * b + s["lo"]
        new = ("hi", F.pmod(s["hi"] + _mix(s["lo"], i, seed), F.lit(a).cast("long"))) if i % 2 == 0 else ("lo", F.pmod(s["lo"] + _mix(s["hi"], i, seed), F.lit(b).cast("long")))
        both = {"hi": s["hi"], "lo": s["lo"]} | dict([new])
        return let(F.struct(both["hi"].alias("hi"), both["lo"].alias("lo")), lambda t: rounds(t, i + 1))

    hi, lo = _digits(x, b)
    return rounds(F.struct(hi.alias("hi"), lo.alias("lo")))


def placed(df: DataFrame, ordinal: str, n: int, seed: int = 42, out: str = "draw") -> DataFrame:
    """df with out: the place (long) of its ordinal, a number from 0 to n - 1, in the permutation of the seed. n is at most 2^50."""
    if n > 1 << 50:
        raise ValueError("digits of more rows than 2^50 don't divide exactly")
    a, b = bases(n)
    names = [*df.columns, out] if out not in df.columns else df.columns
    now = df.withColumn("_x", F.col(ordinal).cast("long"))
    for walk in range(WALKS):
        hi, lo = _digits(F.col("_x"), b)
        now = now.withColumns({"_hi": hi, "_lo": lo})
        for i in range(ROUNDS):  # a projection each: one digit is read for the other
            own, other, base = ("_hi", "_lo", a) if i % 2 == 0 else ("_lo", "_hi", b)
            now = now.withColumn(own, F.pmod(F.col(own) + _mix(F.col(other), i, seed), F.lit(base).cast("long")))
        new = F.col("_hi") * b + F.col("_lo")
        now = now.withColumn("_x", new if not walk else F.when(F.col("_x") < n, F.col("_x")).otherwise(new))
    more = F.aggregate(F.sequence(F.lit(1), F.lit(MOST)), F.col("_x"), lambda x, _: F.when(x < n, x).otherwise(_again(x, n, seed)))
    return now.withColumn(out, F.when(F.col("_x") < n, F.col("_x")).otherwise(more)).select(*names)


def sample(df: DataFrame, ordinal: str, n: int, size: int, seed: int = 42) -> DataFrame:
    """The rows of df whose draw, a new column from 0 on, is below size; ordinal numbers its n rows from 0."""
    return placed(df, ordinal, n, seed).where(F.col("draw") < size)


def sql_placed(source: str, seed: int = 42) -> str:
    """The same as common table expressions over source, a query of (id, x): the last is draws, of (id, draw). Walks are done by recursion."""
    step = []
    for i, k in enumerate(round_keys(seed)):
        own, other, base = ("hi", "lo", "a") if i % 2 == 0 else ("lo", "hi", "b")
        fixed = "hi" if own == "lo" else "lo"
        step.append(f"(SELECT id, n, a, b, {fixed}, ({own} + (((({other} + {k}) % {1 << 31}) * {FACTORS[i % 3]}) >> 15)) % {base} AS {own} FROM {{}})")
    inner = "(SELECT id, n, a, b, x // b AS hi, x % b AS lo FROM w WHERE t = 0 OR x >= n)"
    for s in step:
        inner = s.format(inner)
    return f"""src AS ({source}), size AS (SELECT n, a, CAST((n + a - 1) // a AS BIGINT) AS b FROM (SELECT n, CAST(ceil(sqrt(n)) AS BIGINT) AS a FROM (SELECT count(*) AS n FROM src))),
w AS (SELECT id, n, a, b, CAST(x AS BIGINT) AS x, 0 AS t FROM src, size UNION ALL SELECT id, n, a, b, hi * b + lo, 1 FROM {inner}),
draws AS (SELECT id, x AS draw FROM w WHERE t = 1 AND x < n)"""
