"""Special functions as column expressions: log gamma, the regularised incomplete gamma function and the normal quantile."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lanczos' approximation of the gamma function for g = 7 and nine terms.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
#: Wichura's algorithm AS 241, numerators and denominators of its three ranges, highest power first.
CENTRE = (
    (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608),
    (5226.495278852545925, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0),
)
TAIL = (
    (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0),
)
FAR = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772),
    (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0),
)


def _polynomial(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def log_gamma(a: Column) -> Column:
    """ln of the gamma function of a positive number."""
    terms = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:]):
        terms = terms + F.lit(c) / (a + i)
    t = a + 6.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (a - 0.5) * F.log(t) - t + F.log(terms)


def gamma_cdf(x: Column, shape: Column) -> Column:
    """P(shape, x) for x > 0: a series below shape + 1, a continued fraction above.

    The number of terms follows the square root of the shape, which is how fast both settle.
    """
    # Both operands are held by a lambda, so that they are computed once however often they are named.
    held = F.array(F.struct(x.cast("double").alias("x"), shape.cast("double").alias("a")))
    return F.transform(held, lambda s: _cdf(s["x"], s["a"]))[0]


def _cdf(x: Column, a: Column) -> Column:
    steps = F.sequence(F.lit(1), F.least(F.lit(20_000), F.lit(60) + 12 * F.sqrt(a)).cast("int"))
    scale = F.exp(-x + a * F.log(x) - log_gamma(a))
    start = F.struct((1 / a).alias("term"), (1 / a).alias("total"))

    def series(s: Column, n: Column) -> Column:
        term = s["term"] * x / (a + n)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    below = F.aggregate(steps, start, series, lambda s: s["total"]) * scale
    d0 = 1 / (x + 1 - a)
    first = F.struct((x + 1 - a).alias("b"), F.lit(1e300).alias("c"), d0.alias("d"), d0.alias("h"))

    def fraction(s: Column, n: Column) -> Column:
        """One step of Lentz's method, with b, c and d of the last one."""
        k = -n * (n - a)
        low = lambda v: F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)
        b = s["b"] + 2
        c, d = low(b + k / s["c"]), 1 / low(k * s["d"] + b)
        return F.struct(b.alias("b"), c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    above = 1 - F.aggregate(steps, first, fraction, lambda s: s["h"]) * scale
    return F.when(x <= 0, F.lit(0.0)).when(x < a + 1, below).otherwise(above)


def normal_quantile(p: Column) -> Column:
    """The standard normal value below which a share p lies, 0 < p < 1."""
    q = p - 0.5
    r = F.lit(0.180625) - q * q
    s = F.sqrt(-F.log(F.least(p, 1 - p)))
    ratio = lambda pair, v: _polynomial(pair[0], v) / _polynomial(pair[1], v)
    tail = F.when(s <= 5, ratio(TAIL, s - 1.6)).otherwise(ratio(FAR, s - 5))
    return F.when(F.abs(q) <= 0.425, q * ratio(CENTRE, r)).otherwise(F.signum(q) * tail)
