"""Tail probabilities as columns, without a Python function in the plan.

Student's t goes through the regularised incomplete beta function, as a
continued fraction of ``STEPS`` terms kept in logarithms, the same for all
degrees of freedom; so tails far below the smallest double still have a
logarithm.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

STEPS = 300


def _fold(n: Column, term: Column, grow) -> Column:
    """Sum of ``n`` terms, each made from the last by ``grow(term, k)``."""
    start = F.struct(term.alias("t"), F.when(n > 0, term).otherwise(F.lit(0.0)).alias("s"))

    def step(acc: Column, k: Column) -> Column:
        nxt = grow(acc["t"], k.cast("double"))
        return F.struct(nxt.alias("t"), (acc["s"] + nxt).alias("s"))

    steps = F.when(n > 1, F.sequence(F.lit(1), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, step, lambda acc: acc["s"])


def normal_two_sided(z: Column) -> Column:
    """P(|Z| > |z|): power series below 3, continued fraction from there on."""
    a = F.abs(z.cast("double"))
    phi = F.exp(-a * a / 2.0) / math.sqrt(2 * math.pi)
    inner = 1.0 - 2.0 * phi * _fold(F.lit(60), a, lambda t, k: t * a * a / (2.0 * k + 1.0))
    steps = F.sequence(F.lit(80), F.lit(1), F.lit(-1))
    outer = 2.0 * phi / F.aggregate(steps, a, lambda acc, k: a + k.cast("double") / acc)
    return F.when(a < 3.0, inner).otherwise(outer)


def _log_gamma(z: Column) -> Column:
    """ln of the gamma function for z > 0: Stirling's series eight steps up."""
    up = z + 8.0
    below = z
    for k in range(1, 8):
        below = below * (z + float(k))
    inv = 1.0 / up
    tail = inv * (1.0 / 12 - inv * inv * (1.0 / 360 - inv * inv * (1.0 / 1260 - inv * inv / 1680)))
    return (up - 0.5) * F.log(up) - up + 0.5 * math.log(2 * math.pi) + tail - F.log(below)


def _log_beta_part(a: Column, b: Column, log_x: Column, log_rest: Column) -> Column:
    """ln of the regularised incomplete beta at x = exp(log_x), where 1 - x = exp(log_rest); for x below (a + 1) / (a + b + 2)."""
    x = F.exp(log_x)

    def term(k: Column) -> Column:
        m = F.floor(k / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.when(k % 2 == 0, even).otherwise(odd)

    steps = F.sequence(F.lit(STEPS), F.lit(1), F.lit(-1))
    fraction = F.aggregate(steps, F.lit(1.0), lambda acc, k: 1.0 + term(k) / acc)
    return a * log_x + b * log_rest - F.log(a) - (_log_gamma(a) + _log_gamma(b) - _log_gamma(a + b)) - F.log(fraction)


def t_log_pvalue(t: Column, df: Column) -> Column:
    """ln of the two-sided p of Student's t; NULL when ``df`` < 1 or ``t`` is NULL."""
    t, n = F.abs(t.cast("double")), df.cast("double")
    ratio = t * t / n
    log_x = -F.log1p(ratio)
    log_rest = F.log(ratio) + log_x
    half, a = F.lit(0.5), n / 2.0
    far = _log_beta_part(a, half, log_x, log_rest)
    near = F.log1p(-F.exp(_log_beta_part(half, a, log_rest, log_x)))
    in_tail = F.exp(log_x) < (a + 1.0) / (a + 2.5)
    sure = F.when(t == 0, 0.0).when(t == float("inf"), float("-inf"))  # groups without any spread give an infinite t
    return F.when(df >= 1, F.when(sure.isNotNull(), sure).otherwise(F.when(in_tail, far).otherwise(near)))


def t_pvalue(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t; NULL when ``df`` < 1 or ``t`` is NULL."""
    return F.exp(t_log_pvalue(t, df))
