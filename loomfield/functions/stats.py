"""Probabilities and corrections. Tails are pandas UDFs over result rows, a few for each pattern or gene."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomfield.sources.tables import ship, written


#: ln n! less Stirling's formula, for small n.
_SMALL = [0.0] + [math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) for n in range(1, 16)]


def _stirling_error(n: int) -> float:
    """ln n! - ln(sqrt(2 pi n) (n/e)^n), without the cancellation of a difference of large logarithms."""
    if n < 16:
        return _SMALL[n]
    m = float(n) * n
    return (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 / m) / m) / m) / m) / n


def _deviance(x: float, mean: float) -> float:
    """x ln(x / mean) + mean - x, by a series where x is near the mean."""
    if abs(x - mean) >= 0.1 * (x + mean):
        return x * math.log(x / mean) + mean - x
    v = (x - mean) / (x + mean)
    total, term, i = (x - mean) * v, 2 * x * v, 1
    while True:
        term *= v * v
        more = total + term / (2 * i + 1)
        if more == total:
            return total
        total, i = more, i + 1


def _ln_binomial(x: int, n: int, p: float, q: float) -> float:
    if x == 0:
        return n * math.log1p(-p) if n else 0.0
    if x == n:
        return n * math.log(p)
    own = _stirling_error(n) - _stirling_error(x) - _stirling_error(n - x) - _deviance(x, n * p) - _deviance(n - x, n * q)
    return own + 0.5 * (math.log(n) - math.log(2 * math.pi) - math.log(x) - math.log(n - x))


def _ln_hyper(x: int, total: int, marked: int, drawn: int) -> float:
    """ln P(X = x), by the saddle point of three binomials: as exact for a billion cells as for ten."""
    if drawn in (0, total):
        return 0.0
    p, q = drawn / total, (total - drawn) / total
    return _ln_binomial(x, marked, p, q) + _ln_binomial(drawn - x, total - marked, p, q) - _ln_binomial(drawn, total, p, q)


def _outward(x: int, step: int, stop: int, total: int, marked: int, drawn: int) -> float:
    """The sum of P(X = i) from i = x on, in steps of 1 or -1 up to stop, as a multiple of the first. Terms follow from
    one another by their ratios, and the sum ends where they have vanished: after some standard deviations, however
    many counts are possible."""
    rest = total - marked - drawn
    out, last, size = 1.0, 1.0, 64
    while (stop - x) * step > 0 and last > out * 1e-18:
        i = np.arange(x, x + step * min(size, (stop - x) * step), step, dtype=np.float64)
        if step > 0:
            ratio = (marked - i) * (drawn - i) / ((i + 1) * (rest + i + 1))
        else:
            ratio = i * (rest + i) / ((marked - i + 1) * (drawn - i + 1))
        terms = last * np.cumprod(ratio)
        out, last = out + float(terms.sum()), float(terms[-1])
        x, size = x + step * len(i), min(size * 2, 65536)
    return out


def hypergeom_sf(x: int, total: int, marked: int, drawn: int) -> float:
    """P(X > x), X the marked ones among `drawn` of `total`. The tail away from the mode is summed."""
    low, high = max(0, drawn - (total - marked)), min(marked, drawn)
    if x < low:
        return 1.0
    if x >= high:
        return 0.0
    mode = (drawn + 1) * (marked + 1) // (total + 2)
    if x + 1 > mode:
        return min(1.0, math.exp(_ln_hyper(x + 1, total, marked, drawn)) * _outward(x + 1, 1, high, total, marked, drawn))
    return max(0.0, 1 - math.exp(_ln_hyper(x, total, marked, drawn)) * _outward(x, -1, low, total, marked, drawn))


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Sum over all tables with these margins that are at most as likely as [[a, b], [c, d]], up to 1e-7 relative: the
    own tail, and the other one from the first table that is no likelier on, which bisection finds."""
    total, marked, drawn = a + b + c + d, a + b, a + c
    low, high = max(0, drawn - (total - marked)), min(marked, drawn)
    if low == high:
        return 1.0
    mode = (drawn + 1) * (marked + 1) // (total + 2)
    own = _ln_hyper(a, total, marked, drawn)
    limit = own + math.log1p(1e-7)
    if _ln_hyper(mode, total, marked, drawn) <= limit:
        return 1.0
    step, stop, far = (1, high, low) if a > mode else (-1, low, high)
    out = math.exp(own) * _outward(a, step, stop, total, marked, drawn)
    if _ln_hyper(far, total, marked, drawn) <= limit:
        inner, outer = mode, far  # the other side: likelier at inner, not at outer
        while abs(outer - inner) > 1:
            middle = (inner + outer) // 2
            inner, outer = (inner, middle) if _ln_hyper(middle, total, marked, drawn) <= limit else (middle, outer)
        out += math.exp(_ln_hyper(outer, total, marked, drawn)) * _outward(outer, -step, far, total, marked, drawn)
    return min(1.0, out)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            c = 1 + top / c
            d, c = 1 / (d if abs(d) > tiny else tiny), (c if abs(c) > tiny else tiny)
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h


def beta_regularized(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return beta_regularized(df / 2, 0.5, df / (df + t * t))


def mann_whitney(first: list[float], second: list[float]) -> float:
    """Two-sided p of the U test: exact where a side has at most eight values and none tie, else the normal
    approximation with tie and continuity corrections. Nothing to tell apart: 1."""
    n1, n2 = len(first), len(second)
    if not n1 or not n2:
        return 1.0
    values = np.array([*first, *second], float)
    kinds, counts = np.unique(values, return_counts=True)
    upto = np.cumsum(counts)
    ranks = (upto - (counts - 1) / 2)[np.searchsorted(kinds, values)]
    u1 = float(ranks[:n1].sum()) - n1 * (n1 + 1) / 2
    u = max(u1, n1 * n2 - u1)
    ties = float((counts**3 - counts).sum())
    if min(n1, n2) <= 8 and not ties:
        ways = np.zeros((n1 + 1, n1 * n2 + 1))
        ways[0, 0] = 1
        for j in range(1, n1 + n2 + 1):  # the j-th smallest is of the first kind or not
            for i in range(min(j, n1), 0, -1):
                shift = j - i
                if shift <= n2:
                    ways[i, shift:] += ways[i - 1, : n1 * n2 + 1 - shift]
        tail = ways[n1, math.ceil(u) :].sum() / ways[n1].sum()
        return min(1.0, 2 * float(tail))
    n = n1 + n2
    spread = math.sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))) if n > 1 else 0.0
    if not spread:
        return 1.0
    return min(1.0, math.erfc((u - n1 * n2 / 2 - 0.5) / spread / math.sqrt(2)))


def _udf(f: Callable[..., float]) -> Callable[..., Column]:
    ship(SparkSession.active())

    @F.pandas_udf("double")
    def of(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None or v != v for v in row) else f(*row) for row in zip(*columns, strict=True)], dtype="float64")

    return of


def whole(f: Callable[..., float]) -> Callable[..., float]:
    return lambda *row: f(*(int(v) for v in row))


def p_enriched(x: Column, total: Column, marked: Column, drawn: Column) -> Column:
    return _udf(whole(hypergeom_sf))(x, total, marked, drawn)


def p_fisher(a: Column, b: Column, c: Column, d: Column) -> Column:
    return _udf(whole(fisher_two_sided))(a, b, c, d)


def p_normal(z: Column) -> Column:
    return _udf(normal_two_sided)(z)


def p_student(t: Column, df: Column) -> Column:
    return _udf(t_two_sided)(t, df)


def p_mann_whitney(first: Column, second: Column) -> Column:
    ship(SparkSession.active())

    @F.pandas_udf("double")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([mann_whitney(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="float64")

    return of(first, second)


#: Rows of a family that one ordering window takes; results with more distinct values are ordered in blocks.
WINDOW = 200_000


def _blocks(kinds: DataFrame, value: str) -> DataFrame:
    """kinds with `_block`, 0 for the least values: blocks of about WINDOW rows by approximate quantiles of the value.
    The bounds are one row, which each task gets: a number for each WINDOW rows. kinds itself if one block holds all."""
    n = math.ceil(kinds.count() / WINDOW)
    if n <= 1:
        return kinds
    shares = F.array(*[F.lit(i / n) for i in range(1, n)])
    bounds = kinds.agg(F.percentile_approx(value, shares, max(10_000, 20 * n)))
    return written(kinds.withColumn("_bounds", bounds.scalar()).withColumn("_block", F.size(F.filter("_bounds", lambda b: b <= F.col(value)))).drop("_bounds"), "kinds")


def ordered(df: DataFrame, value: str, family: list[str] | None = None) -> DataFrame:
    """(family, value, _n, _below, _upto) for each distinct value that isn't null: the family's rows, those below the
    value, and those at most it; `_block` too where there are several. Equal values are counted first; then blocks of
    values number their own and the sums of the blocks before are added, so no task orders a family of many values."""
    family = family or []
    kinds = written(df.where(F.col(value).isNotNull()).groupBy(*family, value).agg(F.count("*").alias("_c")), "kinds")
    kinds = _blocks(kinds, value)
    over, upto = Window.partitionBy(*family), F.col("_upto")
    if "_block" not in kinds.columns:
        out = kinds.withColumns({"_n": F.sum("_c").over(over), "_upto": F.sum("_c").over(over.orderBy(value))})
        return out.select(*family, value, "_n", (upto - F.col("_c")).alias("_below"), "_upto")
    sums = kinds.groupBy(*family, "_block").agg(F.sum("_c").alias("_s"))
    sums = sums.select(*family, "_block", (F.sum("_s").over(over.orderBy("_block")) - F.col("_s")).alias("_before"), F.sum("_s").over(over).alias("_n"))
    inside = F.sum("_c").over(Window.partitionBy(*family, "_block").orderBy(value))
    out = kinds.withColumn("_inside", inside).join(sums, [*family, "_block"]).withColumn("_upto", F.col("_before") + F.col("_inside"))
    return out.select(*family, value, "_n", (upto - F.col("_c")).alias("_below"), "_upto", "_block")


def _running(kinds: DataFrame, value: str, raw: str, family: list[str], down: bool) -> DataFrame:
    """kinds with `_best`: the least `raw` from the largest value down, or the largest from the least value up, within
    a block and then over the blocks' own extremes."""
    direction, best = (F.desc, F.min) if down else (F.asc, F.max)
    if "_block" not in kinds.columns:
        return kinds.withColumn("_best", best(raw).over(Window.partitionBy(*family).orderBy(direction(value))))
    inside = best(raw).over(Window.partitionBy(*family, "_block").orderBy(direction(value)))
    ends = kinds.groupBy(*family, "_block").agg(best(raw).alias("_e"))
    ahead = Window.partitionBy(*family).orderBy(direction("_block")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*family, "_block", best("_e").over(ahead).alias("_far"))
    return kinds.withColumn("_own", inside).join(ends, [*family, "_block"]).withColumn("_best", (F.least if down else F.greatest)("_own", "_far"))


def _adjusted(df: DataFrame, p: str, to: str, family: list[str], down: bool) -> DataFrame:
    df = written(df, "tested")
    kinds = ordered(df, p, family)
    raw = F.col(p) * F.col("_n") / F.col("_upto") if down else F.col(p) * (F.col("_n") - F.col("_below"))
    kinds = _running(kinds.withColumn("_raw", raw), p, "_raw", family, down)
    kinds = kinds.select(*[F.col(f).alias(f"_f{i}") for i, f in enumerate(family)], F.col(p).alias("_p"), F.least(F.lit(1.0), "_best").alias(to))
    on = F.col(p) == F.col("_p")
    for i, f in enumerate(family):
        on &= F.col(f).eqNullSafe(F.col(f"_f{i}"))
    return df.drop(to).join(kinds, on, "left").drop("_p", *[f"_f{i}" for i in range(len(family))])


def benjamini_hochberg(df: DataFrame, p: str = "p_value", to: str = "adj_p_value", family: list[str] | None = None) -> DataFrame:
    """df and p adjusted within each family: p * n / rank, then the least of those from the largest p down. Null p stays
    null and doesn't count."""
    return _adjusted(df, p, to, family or [], True)


def holm(df: DataFrame, p: str = "p_value", to: str = "adj_p_value", family: list[str] | None = None) -> DataFrame:
    """df and p adjusted by Holm's steps within each family: the largest of p * (n - those below) so far, at most 1. Of
    equal p the first in order has the largest such product, so all of them get it."""
    return _adjusted(df, p, to, family or [], False)


def percentile_ranks(df: DataFrame, value: str, to: str = "percentile") -> DataFrame:
    """df and the percentile of its value: (below + at most + 1) * 50 / n. Null values have none."""
    df = written(df, "scores")
    kinds = ordered(df, value).select(F.col(value).alias("_v"), ((F.col("_below") + F.col("_upto") + 1) * 50.0 / F.col("_n")).alias(to))
    return df.drop(to).join(kinds, F.col(value) == F.col("_v"), "left").drop("_v")


def fisher_z(r1: Column, n1: Column, r2: Column, n2: Column) -> Column:
    """z of the difference of two correlations, each clipped to 0.9999."""
    clip = lambda r: F.greatest(F.lit(-0.9999), F.least(F.lit(0.9999), r))
    z = lambda r: 0.5 * F.log((1 + clip(r)) / (1 - clip(r)))
    return F.when((n1 > 3) & (n2 > 3), (z(r1) - z(r2)) / F.sqrt(F.lit(1.0) / (n1 - 3) + F.lit(1.0) / (n2 - 3)))
