"""Tests and regressions as column expressions over aggregated counts and sums."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from rungauge.functions.text import let

LN2 = math.log(2.0)


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1: Stirling's series at x + 10, stepped back down."""
    y = x + F.lit(10.0)
    series = (
        (y - 0.5) * F.log(y)
        - y
        + 0.5 * math.log(2.0 * math.pi)
        + 1.0 / (12.0 * y)
        - 1.0 / (360.0 * y * y * y)
        + 1.0 / (1260.0 * y * y * y * y * y)
    )
    steps = F.aggregate(
        F.sequence(F.lit(0), F.lit(9)), F.lit(0.0), lambda a, i: a + F.log(x + i.cast("double"))
    )
    return series - steps


def mcnemar_p(b: Column, c: Column) -> Column:
    """Two-sided exact McNemar p of the discordant counts; 1 when there are none.

    The binomial tail is summed downwards from its largest term.  Terms fall off
    within a few standard deviations, so the number summed grows with the square
    root of n and not with n.
    """
    sides = F.struct((b + c).cast("double").alias("n"), F.least(b, c).cast("double").alias("k"))

    def tail_p(v: Column) -> Column:
        n, k = v["n"], v["k"]
        top = F.exp(log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0) - n * LN2)
        terms = F.least(k, F.ceil(F.sqrt(n) * 12.0).cast("double") + 60.0).cast("int")
        start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

        def add(acc: Column, j: Column) -> Column:
            term = acc["term"] * (k - j) / (n - k + j + 1.0)
            return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

        # The last index gives a factor of zero when every term is summed.
        tail = F.aggregate(F.sequence(F.lit(0), terms), start, add, lambda acc: acc["total"])
        return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2.0 * top * tail))

    return let(sides, tail_p)


def smallest_detectable(n: Column, alpha: float = 0.05) -> Column:
    """Smallest net difference of n discordant pairs with p < alpha; null if none.

    Net differences have the parity of n and p falls as they grow, so the answer
    is found by halving.
    """
    n = n.cast("long")
    parity = n % 2
    top = F.floor((n - parity) / 2)  # net = parity + 2 * step, step in 0 .. top

    def p_at(step: Column) -> Column:
        return let(
            parity + 2 * step,
            lambda net: mcnemar_p(F.floor((n - net) / 2).cast("long"), F.floor((n + net) / 2).cast("long")),
        )

    def halve(acc: Column, _: Column) -> Column:
        def narrow(middle: Column) -> Column:
            return let(
                p_at(middle) < alpha,
                lambda found: F.struct(
                    F.when(found, acc["lo"]).otherwise(middle + 1).alias("lo"),
                    F.when(found, middle).otherwise(acc["hi"]).alias("hi"),
                ),
            )

        return F.when(acc["lo"] >= acc["hi"], acc).otherwise(let(F.floor((acc["lo"] + acc["hi"]) / 2), narrow))

    start = F.struct(F.lit(0).cast("long").alias("lo"), top.cast("long").alias("hi"))
    rounds = (F.ceil(F.log2(top + 2.0)) + 1).cast("int")
    step = F.aggregate(F.sequence(F.lit(1), rounds), start, halve, lambda acc: acc["lo"])
    reachable = (n > 0) & (p_at(top) < alpha)
    return F.when(reachable, F.greatest(F.lit(1).cast("long"), parity + 2 * step))


def t_two_sided_p(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t for whole degrees of freedom (finite series in cos theta)."""
    theta = F.atan(F.abs(t) / F.sqrt(df.cast("double")))
    cos2 = F.pow(F.cos(theta), 2)
    odd = (df % 2) == 1
    terms = F.when(odd, F.floor((df - 1) / 2)).otherwise(F.floor(df / 2)).cast("int")
    first = F.when(odd, F.cos(theta)).otherwise(F.lit(1.0))
    start = F.struct(first.alias("term"), F.lit(0.0).alias("total"))

    def add(acc: Column, i: Column) -> Column:
        j = i.cast("double")
        # term i + 1 over term i: 2j / (2j + 1) for odd, (2j - 1) / 2j for even degrees
        factor = F.when(odd, 2.0 * j / (2.0 * j + 1.0)).otherwise((2.0 * j - 1.0) / (2.0 * j))
        return F.struct(
            (acc["term"] * factor * cos2).alias("term"), (acc["total"] + acc["term"]).alias("total")
        )

    total = F.when(terms < 1, F.lit(0.0)).otherwise(
        F.aggregate(F.sequence(F.lit(1), F.greatest(terms, F.lit(1))), start, add, lambda acc: acc["total"])
    )
    inside = F.when(odd, (theta + F.sin(theta) * total) * (2.0 / math.pi)).otherwise(F.sin(theta) * total)
    return F.when(df < 1, F.lit(None)).otherwise(F.greatest(F.lit(0.0), 1.0 - inside))


def proportion_se(p: Column, n: Column) -> Column:
    """Binomial standard error of a share; null when n is 0."""
    return F.sqrt(F.try_divide(F.greatest(p * (1.0 - p), F.lit(0.0)), n.cast("double")))


def two_proportion_z(p1: Column, n1: Column, p2: Column, n2: Column, pooled: bool = False) -> Column:
    """z of p1 - p2 with the separate or the pooled standard error; 0 when that error is 0."""
    if pooled:
        p = F.try_divide(p1 * n1 + p2 * n2, (n1 + n2).cast("double"))
        se = F.sqrt(p * (1.0 - p) * (1.0 / n1 + 1.0 / n2))
    else:
        se = F.sqrt(F.pow(proportion_se(p1, n1), 2) + F.pow(proportion_se(p2, n2), 2))
    return F.when(se > 0, (p1 - p2) / se).otherwise(F.lit(0.0))
