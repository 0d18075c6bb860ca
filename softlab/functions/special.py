"""Special functions as column expressions.

The regularised incomplete beta function by its continued fraction (modified
Lentz), a fixed number of steps in a higher-order function: no Python worker,
and any engine can repeat it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = 300       # of the continued fraction: enough for parameters of up to about 10^5
TINY = 1e-300
SHIFT = 10        # the series for log gamma begins there
#: Coefficients of Stirling's series, B_2k / (2k (2k - 1)).
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)


def _let(body, **values: Column) -> Column:
    """``body`` of the values, each of which is one variable however often it is used."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body)[0]


def log_gamma(x: Column) -> Column:
    """ln of the gamma function, for x > 0."""
    def body(v: Column) -> Column:
        x, y = v["x"], v["y"]
        series = F.lit(0.0)
        for k, c in enumerate(STIRLING):
            series = series + F.lit(c) / F.pow(y, F.lit(2 * k + 1))
        product = F.lit(1.0)
        for i in range(SHIFT):
            product = product * (x + i)
        return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(product)
    return _let(body, x=x, y=x + SHIFT)


def _not_tiny(x: Column) -> Column:
    return F.when(F.abs(x) > TINY, x).otherwise(F.lit(TINY))


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function."""
    start = 1 / _not_tiny(1 - (a + b) * x / (a + 1))
    init = F.struct(F.lit(1.0).alias("c"), start.alias("d"), start.alias("h"), a.alias("a"), b.alias("b"), x.alias("x"))

    def step(s: Column, i: Column) -> Column:
        m = i.cast("double")

        def half(s: Column, term: Column) -> Column:
            d = 1 / _not_tiny(1 + term * s["d"])
            c = _not_tiny(1 + term / s["c"])
            return F.struct(c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"), s["a"].alias("a"), s["b"].alias("b"), s["x"].alias("x"))
        even = m * (s["b"] - m) * s["x"] / ((s["a"] + 2 * m - 1) * (s["a"] + 2 * m))
        odd = -(s["a"] + m) * (s["a"] + s["b"] + m) * s["x"] / ((s["a"] + 2 * m) * (s["a"] + 2 * m + 1))
        # a step of its own for each half, so that no term is written twice
        return F.aggregate(F.array(even, odd), s, half)

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), init, step, lambda s: s["h"])


def beta_inc(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b)."""
    def sides(v: Column) -> Column:
        low = v["x"] < (v["a"] + 1) / (v["a"] + v["b"] + 2)
        return _let(value, low=low, one=F.when(low, v["a"]).otherwise(v["b"]), two=F.when(low, v["b"]).otherwise(v["a"]),
                    at=F.when(low, v["x"]).otherwise(1 - v["x"]))

    def value(v: Column) -> Column:
        front = F.exp(log_gamma(v["one"] + v["two"]) - log_gamma(v["one"]) - log_gamma(v["two"])
                      + v["one"] * F.log(v["at"]) + v["two"] * F.log1p(-v["at"]))
        part = front * _fraction(v["one"], v["two"], v["at"]) / v["one"]
        return F.when(v["at"] <= 0, F.lit(0.0)).when(v["at"] >= 1, F.lit(1.0)).when(v["low"], part).otherwise(1 - part)

    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(_let(sides, a=a, b=b, x=x))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation r over n pairs (t with n - 2 degrees of
    freedom); NaN for fewer than three pairs or no r."""
    def p(v: Column) -> Column:
        square = v["r"] * v["r"]      # x = df / (df + t^2) = 1 - r^2
        return F.when(v["r"].isNull() | v["n"].isNull() | (v["n"] < 3) | F.isnan(v["r"]), F.lit(float("nan"))) \
            .when(F.abs(v["r"]) >= 1, F.lit(0.0)).otherwise(beta_inc((v["n"] - 2) / 2, F.lit(0.5), 1 - square))
    return _let(p, r=r, n=n.cast("double"))
