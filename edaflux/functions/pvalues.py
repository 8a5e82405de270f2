"""Two-sided p-values of the t distribution as Column expressions, relative accuracy kept far into the tail.

With ``m = df - 1`` and ``c = t / sqrt(df)`` the tail is ``(1 + c^2)^(-m/2) * J(c) / J(0)`` where ``J(c)`` integrates
``(cos d - c sin d)^m`` from 0 to the angle whose cotangent is c. The integrand is smooth, starts at 1 and falls on the
scale ``1 / (m c + sqrt(m))``, so one fixed Gauss-Legendre rule on that scale serves every df and t; nothing is
subtracted from one, and the cost per row does not depend on the number of rows behind it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

PANELS, NODES, REACH = 8, 16, 45.0


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _rule() -> Column:
    """Nodes and weights on [0, 1]: panels of Gauss-Legendre points."""
    x, w = np.polynomial.legendre.leggauss(NODES)
    points = [((k + (a + 1) / 2) / PANELS, b / (2 * PANELS)) for k in range(PANELS) for a, b in zip(x, w, strict=True)]
    return F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("w")) for a, b in points])


def _integral(c: Column, m: Column) -> Column:
    """J(c); beyond ``REACH`` scales nothing is left of the integrand."""
    end = F.atan2(F.lit(1.0), c)
    reach = F.least(end, F.lit(REACH) / (m * c + F.sqrt(m) + F.lit(1.0)))

    def over(length: Column) -> Column:
        def add(total: Column, p: Column) -> Column:
            d = length * p["x"]
            half = F.sin(d / 2)
            return total + p["w"] * F.exp(m * F.log1p(F.lit(-2.0) * half * half - c * F.sin(d)))

        return length * F.aggregate(_rule(), F.lit(0.0), add)

    return _let(reach, over)


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| > |t|) for one or more degrees of freedom; null where either is null or df < 1."""
    v = df.cast("double")
    m = v - 1

    def tail(size: Column) -> Column:
        c = size / F.sqrt(v)
        scale = F.exp(-m / 2 * F.log1p(c * c))
        p = scale * _integral(c, m) / _integral(F.lit(0.0), m)
        return F.when(size < float("inf"), F.least(F.lit(1.0), p)).otherwise(F.lit(0.0))

    return F.when((v >= 1) & t.isNotNull(), _let(F.abs(t), tail))


def f_one_upper(f: Column, df: Column) -> Column:
    """P(F(1, df) > f), through t = sqrt(F)."""
    return t_two_sided(F.sqrt(f), df)
