"""Exact percentiles without holding the values of a column, or of a group, in one place.

Of a whole column the wanted value is closed in on: bounds at about even ranks (a sketch of bounded size) cut the values that are left in intervals,
exact counts say in which of them the rank lies, and only that one is left; at most MOST values come to the driver in the end. A value
that many rows share is soon a bound, and is found as such. Of groups all values are placed in two levels over ranges of (group, value), and the
wanted places are joined; a hot group lies in several ranges.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.selection import indexed

#: Bounds in each round, and values that are collected once so few are left.
BOUNDS, MOST = 63, 4096


def _interval(x: Column, bounds: list[float]) -> Column:
    """2 * (the number of bounds below x), plus 1 where x is the next bound; by a search tree."""

    def tree(a: int, b: int) -> Column:
        if a == b:
            return F.lit(2 * a)
        m = (a + b) // 2
        return F.when(x < bounds[m], tree(a, m)).when(x == bounds[m], 2 * m + 1).otherwise(tree(m + 1, b))

    return tree(0, len(bounds))


def value_at(real: DataFrame, rank: int, n: int, most: int = MOST) -> float:
    """The value of a rank from 0 among the n values x of `real`, none of them null or NaN."""
    left, below = real, 0
    while n > most:
        steps = F.array(*[F.lit(i / (BOUNDS + 1)) for i in range(1, BOUNDS + 1)])
        bounds = sorted(set(left.agg(F.percentile_approx("x", steps, 16 * BOUNDS)).first()[0]))
        counts = {r["i"]: r["count"] for r in left.groupBy(_interval(F.col("x"), bounds).alias("i")).count().collect()}  # 2 * BOUNDS + 1 rows at most
        for i in sorted(counts):
            if below + counts[i] > rank:
                break
            below += counts[i]
        if i % 2:
            return bounds[i // 2]
        low, high, n = bounds[i // 2 - 1] if i else None, bounds[i // 2] if i // 2 < len(bounds) else None, counts[i]
        left = left if low is None else left.where(F.col("x") > low)
        left = left if high is None else left.where(F.col("x") < high)
    return sorted(r["x"] for r in left.collect())[rank - below]


def percentile(df: DataFrame, value: str, p: float, most: int = MOST) -> float | None:
    """The percentile p (from 0 to 1) of a column, between ranks as they lie, nulls left out and NaN the greatest; null without values. The same as `percentile` of SQL."""
    x = df.select(F.col(value).cast("double").alias("x")).where("x IS NOT NULL")
    n, real_n = x.agg(F.count("*"), F.count(F.when(~F.isnan("x"), 1))).first()
    if n == 0:
        return None
    real, at = x.where(~F.isnan("x")), p * (n - 1)
    low, high = math.floor(at), math.ceil(at)
    if high >= real_n:
        return math.nan
    a = value_at(real, low, real_n, most)
    if low == high:
        return a
    upto, after = real.agg(F.count(F.when(F.col("x") <= a, 1)), F.min(F.when(F.col("x") > a, F.col("x")))).first()
    b = a if upto > high else after
    return a if a == b else (high - at) * a + (at - low) * b


def percentiles_by(df: DataFrame, by: list[str], value: str, p: float, name: str) -> DataFrame:
    """The groups with the percentile p of the values of each, as `percentile` has it; groups without values have null."""
    rows = df.select(*by, F.col(value).cast("double").alias("__x"))
    placed = indexed(rows.where("__x IS NOT NULL"), [*by, "__x"], "__at")
    groups = placed.groupBy(*by).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    at = F.lit(p) * (F.col("__n") - 1)
    ends = groups.withColumn("__p", at).withColumn("__end", F.explode(F.array(F.floor("__p"), F.ceil("__p")))).withColumn("__at", F.col("__first") + F.col("__end"))
    met = ends.join(placed.select("__at", "__x"), "__at")
    share = F.when(F.ceil("__p") == F.floor("__p"), 0.5).otherwise(1 - F.abs(F.col("__p") - F.col("__end")))
    found = met.groupBy(*by).agg(F.when(F.min("__x") == F.max("__x"), F.min("__x")).otherwise(F.sum(share * F.col("__x"))).alias(name))
    keys = rows.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(by)]).distinct()
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(f"__g{i}").eqNullSafe(F.col(c))
    return keys.join(found, same, "left").select(*[F.col(f"__g{i}").alias(c) for i, c in enumerate(by)], name)
