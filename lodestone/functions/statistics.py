"""Distribution functions in column code, as Spark has none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos' coefficients for g = 7.
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]
#: A denominator that would be 0.
TINY = 1e-300


def log_gamma(x: Column) -> Column:
    """Of a positive number."""
    z = x - 1.0
    series = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:], 1):
        series = series + F.lit(c) / (z + float(k))
    t = z + 7.5
    return F.lit(0.9189385332046727) + (z + 0.5) * F.log(t) - t + F.log(series)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, by Lentz's steps; it takes about as many as the root of
    the larger parameter, and the fold has four times as many and sixty more."""
    steps = F.sequence(F.lit(1), (F.lit(60) + F.ceil(4 * F.sqrt(F.greatest(a, b)))).cast("int"))
    safe = lambda v: F.when(F.abs(v) < TINY, F.lit(TINY)).otherwise(v)
    d0 = 1.0 / safe(1.0 - (a + b) * x / (a + 1.0))
    start = F.struct(d0.alias("d"), F.lit(1.0).alias("c"), d0.alias("h"))

    def half(at: Column, term: Column) -> Column:
        d, c = 1.0 / safe(1.0 + term * at["d"]), safe(1.0 + term / at["c"])
        return F.struct(d.alias("d"), c.alias("c"), (at["h"] * d * c).alias("h"))

    def step(at: Column, k: Column) -> Column:
        m = k.cast("double")
        even = m * (b - m) * x / ((a + 2.0 * m - 1.0) * (a + 2.0 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2.0 * m) * (a + 2.0 * m + 1.0))
        # bound to a one-element array, as the first half is asked for in six places of the second
        return F.element_at(F.transform(F.array(half(at, even)), lambda s: half(s, odd)), 1)

    return F.aggregate(steps, start, step, lambda s: s["h"])


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b)."""
    a, b, x = (c.cast("double") for c in (a, b, x))
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1.0 - x))
    low = front * _fraction(a, b, x) / a
    high = 1.0 - front * _fraction(b, a, 1.0 - x) / b
    return F.when(x <= 0.0, 0.0).when(x >= 1.0, 1.0).when(x < (a + 1.0) / (a + b + 2.0), low).otherwise(high)


def t_test_p_value(t: Column, df: Column) -> Column:
    """The two-sided p-value of a t statistic; null if either is null."""
    return incomplete_beta(df / 2.0, F.lit(0.5), df / (df + t * t))
