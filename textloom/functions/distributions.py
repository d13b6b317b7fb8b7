"""Tail probabilities as column expressions, so that a test's p is computed where its statistic is."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of the series and of the continued fraction: enough for 15 digits where each is used.
SERIES, FRACTION = 300, 120
#: Untied differences up to which the signed-rank sum's distribution is counted out.
MOST_EXACT = 50
#: Degrees of freedom from which Student's t is taken as normal; the sum below has half as many terms.
NORMAL_FROM = 100_000


def _steps(n: Column | int) -> Column:
    """1 to n; no step if n is below 1 (a sequence would count down)."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n >= 1, F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int"))).otherwise(F.array().cast("array<int>"))


def _summed(over: Column, start: Column, step, last=lambda a: a) -> Column:
    return F.aggregate(over, start, step, last)


def log_gamma_half(df: Column) -> Column:
    """ln gamma(df / 2) of a whole df: the product of df/2 - 1, df/2 - 2, ... down to 1 or 1/2, times the root of pi if df is odd."""
    product = _summed(_steps(F.floor((df - 1) / 2)), F.lit(0.0), lambda a, j: a + F.log(df / 2 - j))
    return product + F.when(df % 2 == 1, F.lit(math.log(math.pi) / 2)).otherwise(0.0)


def chi2_tail(x: Column, df: Column) -> Column:
    """P(chi-squared with df degrees > x): 1 minus the series of the incomplete gamma function below its mean, above it the
    continued fraction, from its end."""
    a, h = df / 2, x / 2
    factor = F.exp(a * F.log(h) - h - log_gamma_half(df))
    terms = F.struct((1 / a).cast("double").alias("t"), (1 / a).cast("double").alias("s"))
    more = lambda s, k: (s["t"] * h / (a + k)).cast("double")
    series = _summed(_steps(SERIES), terms, lambda s, k: F.struct(more(s, k).alias("t"), (s["s"] + more(s, k)).alias("s")), lambda s: s["s"])
    k_of = lambda i: F.lit(FRACTION + 1) - i
    rest = _summed(_steps(FRACTION), F.lit(0.0), lambda s, i: (-k_of(i) * (k_of(i) - a) / (h + 2 * k_of(i) + 1 - a + s)).cast("double"))
    tail = F.when(h < a + 1, 1 - factor * series).otherwise(factor / (h + 1 - a + rest))
    return F.when(df < 1, F.lit(None).cast("double")).when(x <= 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), tail)))


def normal_both(z: Column) -> Column:
    """P(|standard normal| > |z|)."""
    return chi2_tail(z * z, F.lit(1))


def t_both(t: Column, df: Column) -> Column:
    """P(|Student's t with df degrees| > |t|), by the finite sums for whole degrees of freedom."""
    angle = F.atan(F.abs(t) / F.sqrt(df))
    sine, square = F.sin(angle), F.cos(angle) * F.cos(angle)
    odd = df % 2 == 1
    # Term j follows from the one before by 2j/(2j+1) or (2j-1)/(2j), and the square of the cosine.
    start = F.struct(F.when(odd, F.cos(angle)).otherwise(1.0).alias("t"), F.when(odd, F.cos(angle)).otherwise(1.0).alias("s"))
    next_ = lambda s, j: s["t"] * square * F.when(odd, 2 * j / (2 * j + 1)).otherwise((2 * j - 1) / (2 * j))
    count = F.when(odd, (df - 3) / 2).otherwise((df - 2) / 2)
    total = _summed(_steps(F.least(count, F.lit(NORMAL_FROM / 2))), start, lambda s, j: F.struct(next_(s, j).alias("t"), (s["s"] + next_(s, j)).alias("s")), lambda s: s["s"])
    inside = F.when(df == 1, angle * (2 / math.pi)).when(odd, (angle + sine * total) * (2 / math.pi)).otherwise(sine * total)
    return F.when(df < 1, F.lit(None).cast("double")).when(df >= NORMAL_FROM, normal_both(t)).otherwise(F.greatest(F.lit(0.0), 1 - inside))


def signed_rank_exact(w: Column, n: Column) -> Column:
    """Two-sided p of the smaller sum w of n untied signed ranks, by counting the sets of ranks with each sum: a rank joins the
    sets that are there, which shifts their counts. n is at most MOST_EXACT."""
    zeros = lambda r: F.array_repeat(F.lit(0.0), r)
    ways = _summed(_steps(F.least(n, F.lit(MOST_EXACT))), F.array(F.lit(1.0)), lambda c, r: F.zip_with(F.concat(c, zeros(r)), F.concat(zeros(r), c), lambda x, y: x + y))
    low = _summed(F.slice(ways, 1, F.floor(w).cast("int") + 1), F.lit(0.0), lambda a, c: a + c)
    return F.least(F.lit(1.0), 2 * low / F.pow(F.lit(2.0), n))
