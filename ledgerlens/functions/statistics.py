"""Tail probabilities as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.operators.metrics import log_choose

#: Terms of the series for the incomplete gamma function.
TERMS = 400


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """P(X >= k) for X binomial: 1 for k of 0 or less, 0 beyond n; the terms of the tail are added up."""
    term = lambda i: F.exp(log_choose(n, i) + i * F.ln(p) + (n - i) * F.ln(1 - p))
    tail = F.aggregate(F.sequence(k.cast("int"), n.cast("int")), F.lit(0.0), lambda t, i: t + term(i))
    return F.when(k <= 0, 1.0).when(k > n, 0.0).when(p <= 0, 0.0).when(p >= 1, 1.0).otherwise(F.least(tail, F.lit(1.0)))


def chi2_tail(x: Column, dof: Column) -> Column:
    """P(X >= x) for X chi-squared, by the series of the lower incomplete gamma function (for x up to some hundreds)."""
    a, h = dof / 2.0, x / 2.0
    even = dof % 2 == 0
    steps = F.sequence(F.lit(1), F.greatest(F.ceil(a).cast("int"), F.lit(1)))
    factor = lambda i: F.when(even, i.cast("double")).otherwise(i - 0.5)  # noqa: E731  gamma(a + 1) is the product of these, for odd dof times the root of pi
    log_gamma = F.aggregate(steps, F.when(even, 0.0).otherwise(F.lit(math.log(math.pi) / 2)), lambda t, i: t + F.ln(factor(i)))
    first = F.exp(a * F.ln(h) - h - log_gamma)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")), lambda s, i: F.struct((s["term"] * h / (a + i)).alias("term"), (s["sum"] + s["term"] * h / (a + i)).alias("sum")), lambda s: s["sum"])
    return F.when(x <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - first * series))


def t_two_sided(t: Column, dof: Column) -> Column:
    """P(|T| >= |t|) for Student's t of whole degrees of freedom, by its finite sums."""
    theta = F.atan(F.abs(t) / F.sqrt(dof))
    c2 = F.cos(theta) ** 2
    odd = dof % 2 == 1
    n = F.floor((dof - F.when(odd, 3).otherwise(2)) / 2).cast("int")  # terms after the first
    steps = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    factor = lambda i: F.when(odd, 2.0 * i / (2 * i + 1)).otherwise((2.0 * i - 1) / (2 * i))
    series = F.aggregate(steps, F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")), lambda s, i: F.struct((s["term"] * factor(i) * c2).alias("term"), (s["sum"] + s["term"] * factor(i) * c2).alias("sum")), lambda s: s["sum"])
    inside = F.when(odd, 2 / math.pi * (theta + F.when(dof > 1, F.sin(theta) * F.cos(theta) * series).otherwise(0.0))).otherwise(F.sin(theta) * series)
    return F.when(dof >= 1, F.greatest(F.lit(0.0), 1 - inside))
