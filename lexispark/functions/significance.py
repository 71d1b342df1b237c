"""Tests of significance as column expressions, for any number of comparisons in one job."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps of the continued fraction; it settles long before at any number of topics.
STEPS = 300
#: Degrees of freedom above which the ratio of gamma functions follows from its series.
MANY = 200


def _number(x: float) -> Column:
    return F.lit(float(x))


def log_gamma_ratio(v: Column) -> Column:
    """ln of gamma((v + 1) / 2) / gamma(v / 2) for a whole number v of at least 1.

    The ratio at v + 2 is (v + 1) / v times that at v, so it is a product from
    1 / sqrt(pi) or sqrt(pi) / 2 on; for large v four terms of its series are exact to the last places.
    """
    odd = F.pmod(v, F.lit(2)) == 1
    first = F.when(odd, _number(-0.5 * math.log(math.pi))).otherwise(_number(0.5 * math.log(math.pi) - math.log(2)))
    low = F.when(odd, F.lit(1)).otherwise(F.lit(2)).cast("bigint")
    small = F.least(v, F.lit(MANY + 1)).cast("bigint")
    steps = F.when(small > low, F.sequence(low, F.greatest(small - 2, low), F.lit(2).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    product = F.aggregate(steps, first, lambda total, j: total + F.log((j + 1) / j))
    x = v / 2
    series = 0.5 * F.log(x) - 1 / (8 * x) + 1 / (192 * F.pow(x, F.lit(3.0))) - 1 / (640 * F.pow(x, F.lit(5.0)))
    return F.when(v > MANY, series).otherwise(product)


def t_test(t: Column, n: Column) -> Column:
    """Two-sided p of a paired t value over ``n`` topics; null without a value or for fewer than two topics.

    It is the regularised incomplete beta function of v / (v + t^2) at v / 2
    and 1 / 2, v = n - 1, by its continued fraction: of the two that there are,
    the one that converges fast at that point.
    """
    v = (n - 1).cast("double")
    x0, a0, half = v / (v + t * t), v / 2, _number(0.5)
    flip = x0 > (a0 + 1) / (a0 + half + 2)
    a, b = F.when(flip, half).otherwise(a0), F.when(flip, a0).otherwise(half)
    x = F.when(flip, t * t / (v + t * t)).otherwise(x0)
    floor = lambda c: F.when(F.abs(c) < 1e-300, _number(1e-300)).otherwise(c)

    def step(state: Column, i: Column) -> Column:
        m = F.floor(i / 2)
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        term = F.when(i == 0, _number(1)).when(F.pmod(i, F.lit(2)) == 0, even).otherwise(odd)
        d = 1 / floor(1 + term * state["d"])
        c = floor(1 + term / state["c"])
        return F.struct((state["f"] * c * d).alias("f"), c.alias("c"), d.alias("d"))

    start = F.struct(_number(1).alias("f"), _number(1).alias("c"), _number(0).alias("d"))
    fraction = F.aggregate(F.sequence(F.lit(0), F.lit(STEPS)), start, step)["f"] - 1
    log_beta = _number(0.5 * math.log(math.pi)) - log_gamma_ratio(n - 1)
    part = F.exp(a * F.log(x) + b * F.log(1 - x) - log_beta) / a * fraction
    p = F.when(flip, 1 - part).otherwise(part)
    return F.when(t.isNull() | (n < 2), F.lit(None).cast("double")).when(t == 0, _number(1)).otherwise(F.least(F.greatest(p, _number(0)), _number(1)))


def sign_test(better: Column, worse: Column) -> Column:
    """Exact two-sided p of the sign test: twice the lower tail of a fair coin, 1 at most; ties are not counted."""
    n, low = better + worse, F.least(better, worse)

    def step(state: Column, i: Column) -> Column:
        # The logarithm of the next binomial probability follows from the one before.
        here = F.when(i == 0, state["log"]).otherwise(state["log"] + F.log((n - i + 1) / i))
        return F.struct(here.alias("log"), (state["sum"] + F.exp(here)).alias("sum"))

    start = F.struct((-n * _number(math.log(2))).cast("double").alias("log"), _number(0).alias("sum"))
    return F.least(_number(1), 2 * F.aggregate(F.sequence(F.lit(0).cast("bigint"), low.cast("bigint")), start, step)["sum"])
