"""Special functions as column expressions, for the few final rows of a test: no Python, any size of input.

Each is a fixed number of terms of a published series or continued fraction; accuracy is about
1e-12 but where stated.
"""

from math import log, pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from .prims import col

# Lanczos coefficients for g = 7.
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]
TINY = 1e-300


def log_gamma(z) -> Column:
    """log of the gamma function, z > 0.5."""
    z = col(z) - 1
    s = F.lit(LANCZOS[0]) + sum(F.lit(c) / (z + i) for i, c in enumerate(LANCZOS[1:], 1))
    return 0.5 * log(2 * pi) + (z + 0.5) * F.log(z + 7.5) - (z + 7.5) + F.log(s)


def bound(v: Column, f) -> Column:
    """f of v, which is worked out once however often f names it."""
    return F.transform(F.array(v), f)[0]


def _fraction(a: Column, b: Column, x: Column, terms: Column) -> Column:
    """The continued fraction of the incomplete beta function, evaluated from the front; good for x < (a + 1) / (a + b + 2)."""
    away = lambda v: F.when(F.abs(v) < TINY, F.lit(TINY)).otherwise(v)
    first = 1 / away(1 - (a + b) * x / (a + 1))
    state = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))

    def step(s: Column, i: Column) -> Column:
        m = F.floor(i / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        by = F.when(i % 2 == 0, even).otherwise(odd)
        new = lambda y: F.struct(away(1 + y / s["c"]).alias("c"), (1 / away(1 + y * s["d"])).alias("d"))
        return bound(by, lambda y: bound(new(y), lambda n: F.struct(n["c"].alias("c"), n["d"].alias("d"), (s["h"] * n["c"] * n["d"]).alias("h"))))

    # Terms 2, 3, 4, ...: even and odd ones of m = 1, 1, 2, 2, ... (the odd one of m = 0 is in ``first``).
    return F.aggregate(F.sequence(F.lit(2), terms), state, step)["h"]


def incomplete_beta(a, b, x, terms: int = 400) -> Column:
    """Regularised incomplete beta function I_x(a, b); ``terms`` suffice for a and b up to some ten thousand.

    The fraction settles in a number of terms that goes with the root of a and b: small ones take few.
    """
    a, b, x = (col(v).cast("double") for v in (a, b, x))
    settled = F.least(F.lit(terms), F.ceil(24 + 12 * F.sqrt(F.greatest(a, b))).cast("int"))

    def value(v: Column) -> Column:
        a, b, x = v["a"], v["b"], v["x"]
        front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
        low, high = front * _fraction(a, b, x, v["terms"]) / a, 1 - front * _fraction(b, a, 1 - x, v["terms"]) / b
        return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x < (a + 1) / (a + b + 2), low).otherwise(high)

    once = F.struct(a.alias("a"), b.alias("b"), x.alias("x"), settled.alias("terms"))
    return bound(once, value)


def normal_p(z, terms: int = 80) -> Column:
    """Two-sided p value of a standard normal: series near 0, continued fraction in the tail."""
    x = F.abs(col(z).cast("double")) / 2**0.5
    sums = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.struct(x.alias("t"), x.alias("s")), lambda a, n: F.struct((a["t"] * 2 * x * x / (2 * n + 1)).alias("t"), (a["s"] + a["t"] * 2 * x * x / (2 * n + 1)).alias("s")))["s"]
    near = 1 - 2 / pi**0.5 * F.exp(-x * x) * sums
    tail = F.aggregate(F.sequence(F.lit(terms), F.lit(1)), x, lambda a, n: x + n / 2 / a)
    return F.when(x < 2.5, near).otherwise(F.exp(-x * x) / (pi**0.5 * tail))


def t_p(t, df) -> Column:
    """Two-sided p value of Student's t; beyond 20,000 degrees of freedom that of Hill's normal deviate (1970)."""
    t, df = col(t).cast("double"), col(df).cast("double")
    a, b = df - 0.5, 48 * (df - 0.5) * (df - 0.5)
    y = a * F.log1p(t * t / df)
    z = (((((-0.4 * y - 3.3) * y - 24) * y - 85.5) / (0.8 * y * y + 100 + b) + y + 3) / b + 1) * F.sqrt(y)
    return F.when(df <= 0, None).when(df > 20_000, normal_p(z)).otherwise(incomplete_beta(df / 2, F.lit(0.5), df / (df + t * t)))


def correlation_p(r, n) -> Column:
    """Two-sided p value of a correlation of n pairs; null under three, 0 where it is exact."""
    r, df = col(r), col(n) - 2
    return F.when(df <= 0, None).when(F.abs(r) >= 1, 0.0).otherwise(t_p(r * F.sqrt(df / (1 - r * r)), df))
