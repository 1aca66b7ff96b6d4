"""Tail probabilities of Student's t and of F as column expressions, through the regularised incomplete beta function."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of Stirling's series for the log of the gamma function: B(2k) / (2k (2k - 1)).
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
_SHIFT = 8
_TINY = 1e-300


def bound(value: Column, body) -> Column:
    """``body`` of a variable that holds ``value``, so that a value used often is written, and worked out, once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _stirling(x: Column) -> Column:
    z = x + _SHIFT
    series, below = F.lit(0.0), F.lit(1.0)
    for k, c in enumerate(_STIRLING):
        series = series + F.lit(c) * F.pow(z, F.lit(-1.0 - 2 * k))
    for k in range(_SHIFT):
        below = below * (1 + F.lit(float(k)) / x) if k else below
    # The product of x + k is x to the eighth times that of 1 + k / x, which cannot overflow.
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + series - F.log(below) - _SHIFT * F.log(x)


def log_gamma(x: Column) -> Column:
    """Log of gamma(x) for x > 0: Stirling's series at x + 8, less the logs of the eight factors between."""
    return bound(x, _stirling)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function by Lentz's rule; it settles in some multiple of sqrt(max(a, b)) steps."""
    whole = lambda v: F.when(F.abs(v) < _TINY, F.lit(_TINY)).otherwise(v)
    first = 1 / whole(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"), a.alias("a"), b.alias("b"), x.alias("x"))

    def half(s: Column, term: Column) -> Column:
        d, c = 1 / whole(1 + term * s["d"]), whole(1 + term / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"), s["a"].alias("a"), s["b"].alias("b"), s["x"].alias("x"))

    even = lambda s, m: m * (s["b"] - m) * s["x"] / ((s["a"] + 2 * m - 1) * (s["a"] + 2 * m))
    odd = lambda s, m: -(s["a"] + m) * (s["a"] + s["b"] + m) * s["x"] / ((s["a"] + 2 * m) * (s["a"] + 2 * m + 1))
    steps = (F.ceil(F.sqrt(F.greatest(a, b)) * 6) + 40).cast("int")
    terms = F.flatten(F.transform(F.sequence(F.lit(1), steps), lambda m: F.array(m.cast("double"), -m.cast("double"))))
    return F.aggregate(terms, start, lambda s, m: half(s, F.when(m > 0, even(s, m)).otherwise(odd(s, -m))))["h"]


def _beta_of(s: Column) -> Column:
    p, q, y = s["p"], s["q"], s["y"]
    front = F.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * F.log(y) + q * F.log1p(-y))
    inner = F.when((y > 0) & (y < 1), front * _fraction(p, q, y) / p).otherwise(F.when(y >= 1, F.lit(1.0)).otherwise(0.0))
    return bound(inner, lambda v: F.greatest(F.least(F.when(s["turned"], 1 - v).otherwise(v), F.lit(1.0)), F.lit(0.0)))


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """I(x; a, b), the regularised incomplete beta function, for a, b > 0 and x in [0, 1]; null in, or out of range, null out."""
    given = F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"), x.cast("double").alias("x"))

    def sided(g: Column) -> Column:
        turned = g["x"] > (g["a"] + 1) / (g["a"] + g["b"] + 2)  # the fraction is quick on the other side
        parts = F.struct(turned.alias("turned"), F.when(turned, g["b"]).otherwise(g["a"]).alias("p"), F.when(turned, g["a"]).otherwise(g["b"]).alias("q"), F.when(turned, 1 - g["x"]).otherwise(g["x"]).alias("y"))
        return F.when((g["a"] > 0) & (g["b"] > 0) & (g["x"] >= 0) & (g["x"] <= 1), bound(parts, _beta_of))

    return bound(given, sided)


def student_p(t: Column, df: Column) -> Column:
    """Two-sided probability of a t at least as far from 0, with ``df`` > 0 degrees of freedom."""
    df = df.cast("double")
    return incomplete_beta(df / 2, F.lit(0.5), df / (df + t * t))


def f_p(f: Column, df1: Column, df2: Column) -> Column:
    """Probability of an F at least as large, with ``df1`` and ``df2`` > 0 degrees of freedom."""
    df1, df2 = df1.cast("double"), df2.cast("double")
    return incomplete_beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * F.greatest(f, F.lit(0.0))))
