"""Column expressions: statistics whose edge cases are those of the data model (null in, null out; never NaN)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def clean(c: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(c), c)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf))


def clip(c: Column, low: float, high: float) -> Column:
    """Bounds a value; null stays null, which least() and greatest() alone would skip."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def steady_sum(c: Column) -> Column:
    """Sum that doesn't depend on the order of rows: multiples of 2^-10 and of 2^-50 are added as whole numbers, and only what is left of a value as a double."""
    big, small = F.lit(2.0**10), F.lit(2.0**50)
    inside = F.abs(c) < 2.0**30  # not NaN, which is the largest
    high = F.when(c.isNotNull(), F.when(inside, F.rint(c * big)).otherwise(0.0))
    left = F.when(inside, c - high / big).otherwise(0.0)
    low = F.rint(left * small)
    rest = F.when(inside, left - low / small).otherwise(c)
    return F.sum(high.cast("long")) / big + (F.sum(low.cast("long")) / small + F.sum(rest))


def sharpe(r: Column, ann: float) -> Column:
    """Mean over sample deviation, annualised; null where the deviation is 0 or undefined."""
    return ratio(F.avg(r), F.stddev_samp(r)) * F.lit(math.sqrt(ann))


def cagr(r: Column, ann: float) -> Column:
    """Annual growth of compounded returns: -1 once all is lost, null without returns."""
    total = F.product(1 + r)
    return F.when(F.count(r) > 0, F.when(total > 0, F.pow(total, F.lit(float(ann)) / F.count(r)) - 1).otherwise(F.lit(-1.0)))


def tstat(x: Column) -> Column:
    return ratio(F.avg(x), F.stddev_samp(x)) * F.sqrt(F.count(x))


def average_rank(value: str, keys: list[str]) -> Column:
    """Ranks from 1 within keys, ties at their mean."""
    return F.rank().over(W.partitionBy(*keys).orderBy(value)) + (F.count(F.lit(1)).over(W.partitionBy(*keys, value)) - 1) / 2


def pearson(a: str, b: str) -> Column:
    """Correlation as an aggregate; null for fewer than three pairs or a constant side."""
    both = F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.lit(1))
    return F.when(F.count(both) >= 3, ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


#: Edges of ten equal bins as linspace gives them: 0.3 and 0.6 are not the nearest doubles to those decimals.
DECILE_EDGES = [k / 10 for k in range(11)]
DECILE_EDGES[3], DECILE_EDGES[6] = 0.30000000000000004, 0.6000000000000001


def quantile_edges(n_q: int) -> list[float]:
    return DECILE_EDGES if n_q == 10 else [k / n_q for k in range(n_q + 1)]


def quantile_bucket(rank: Column, count: Column, n_q: int = 10) -> Column:
    """Bucket from 0 of a rank 1..count in n_q bins of equal quantiles, closed on the right, the lowest value included."""
    inside = F.lit(0)
    for f in quantile_edges(n_q)[:-1]:
        v = F.lit(f) * (count - 1)
        lo = F.floor(v)
        t = v - lo
        edge = F.when(t >= 0.5, (lo + 2) - (1 - t)).otherwise((lo + 1) + t)
        inside = inside + F.when(rank > edge, 1).otherwise(0)
    return (F.greatest(inside, F.lit(1)) - 1).cast("int")


def exact_bucket(rank: Column, count: Column, n_q: int = 10) -> Column:
    """quantile_bucket() in whole numbers, as the SQL's decimals have it: in doubles 0.7 of 90 falls short of 63, and rank 64 of 91, which is the edge, goes a bucket up."""
    inside = F.lit(0)
    for k in range(n_q):
        inside = inside + F.when(F.lit(n_q) * (rank.cast("long") - 1) > F.lit(k) * (count.cast("long") - 1), 1).otherwise(0)
    return (F.greatest(inside, F.lit(1)) - 1).cast("int")


def draw(*parts) -> Column:
    """The md5 of parts joined by bars: a draw that depends on keys alone, never on partitions."""
    return F.md5(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def draw_below(limit: Column | int, *parts) -> Column:
    """A whole number from 0 below limit, from the first 60 bits of draw()."""
    return F.conv(F.substring(draw(*parts), 1, 15), 16, 10).cast("bigint") % limit
