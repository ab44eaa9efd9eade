"""Student t p-values for whole degrees of freedom, as Column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


TAIL_TERMS = 60


def student_t_tail(t: Column, df: int) -> Column:
    """P(|T| > |t|) for t^2 >= df without cancellation.

    The incomplete beta function of df/2 and 1/2 at x = df / (df + t^2) <= 1/2, by
    its power series; the last term is below 2^-60 of the sum.
    """
    a, square = df / 2.0, t * t
    x = df / (df + square)
    series = F.lit(1.0)
    for k in reversed(range(TAIL_TERMS)):
        series = 1.0 + series * x * ((a + 0.5 + k) / (a + 1.0 + k))
    log_beta = math.lgamma(a) + math.lgamma(0.5) - math.lgamma(a + 0.5)
    return F.pow(x, F.lit(a)) * F.sqrt(square / (df + square)) * series / (a * math.exp(log_beta))


def student_t_two_sided_p(t: Column, df: int) -> Column:
    """P(|T| > |t|) by the finite trigonometric series (Abramowitz-Stegun 26.7).

    The series terms are built for the given df; no numeric integration. Large t
    take the power series of the tail, which keeps all digits of small p.
    """
    theta = F.atan(F.abs(t) / math.sqrt(df))
    c, s = F.cos(theta), F.sin(theta)
    if df % 2 == 0:
        coef, series = 1.0, F.lit(1.0)
        for k in range(1, df // 2):
            coef *= (2 * k - 1) / (2 * k)
            series = series + coef * F.pow(c, F.lit(2.0 * k))
        inside = s * series
    elif df == 1:
        inside = theta * (2.0 / math.pi)
    else:
        coef, series = 1.0, c
        for k in range(1, (df - 1) // 2):
            coef *= (2 * k) / (2 * k + 1)
            series = series + coef * F.pow(c, F.lit(2.0 * k + 1))
        inside = (theta + s * series) * (2.0 / math.pi)
    return F.when(t * t >= df, student_t_tail(t, df)).otherwise(1.0 - inside)
