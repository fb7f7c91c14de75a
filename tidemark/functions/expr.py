"""Column expressions with the semantics the panel and its evaluation rely on."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The standard normal quantile and density at level 0.95.
Z95 = 1.6448536269514722
PHI95 = 0.10313564037537128


def finite(x: Column) -> Column:
    """Null for NaN and infinities, which count as missing."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def positive(x: Column) -> Column:
    return F.when(finite(x) > 0, finite(x))


def log_return(first: Column, last: Column) -> Column:
    """ln(last) - ln(first); null unless both are positive."""
    return F.log(positive(last)) - F.log(positive(first))


def quantile_loss(loss: Column, var: Column, level: float) -> Column:
    alpha = 1.0 - level
    return (F.when(loss > var, 1.0).otherwise(0.0) - F.lit(alpha)) * (loss - var)


def valid_forecast(var: Column, es: Column) -> Column:
    """Both finite, es positive and not below var."""
    return F.coalesce(finite(var).isNotNull() & finite(es).isNotNull() & (es > 0) & (es >= var), F.lit(False))


def validity_reason(var: Column, es: Column) -> Column:
    return (
        F.when(finite(var).isNull() | finite(es).isNull(), "invalid_nonfinite")
        .when(es <= 0, "invalid_nonpositive_es")
        .when(es < var, "invalid_es_below_var")
        .otherwise("ok")
    )


def fz_loss(loss: Column, var: Column, es: Column, level: float) -> Column:
    """The FZ0 score on the return scale: x = -loss, v = -var, e = -es."""
    alpha = F.lit(1.0 - level)
    x, v, e = -loss, -var, -es
    value = F.when(x <= v, (x - v) / (alpha * e)).otherwise(0.0) + v / e + F.log(-e) - 1
    return F.when(valid_forecast(var, es), value)


def xlogy(k: Column, p: Column) -> Column:
    """k ln p with 0 ln 0 = 0."""
    return F.when(k > 0, k * F.log(p)).otherwise(0.0)


def bernoulli_log_likelihood(hits: Column, misses: Column) -> Column:
    n = hits + misses
    return xlogy(hits, hits / n) + xlogy(misses, misses / n)


def kupiec_lr(hits: Column, n: Column, probability: float) -> Column:
    null = hits * F.log(F.lit(probability)) + (n - hits) * F.log(F.lit(1.0 - probability))
    return -2.0 * (null - bernoulli_log_likelihood(hits, n - hits))


def christoffersen_lr(n00: Column, n01: Column, n10: Column, n11: Column) -> Column:
    free = bernoulli_log_likelihood(n01, n00) + bernoulli_log_likelihood(n11, n10)
    tied = bernoulli_log_likelihood(n01 + n11, n00 + n10)
    return -2.0 * (F.coalesce(tied, F.lit(0.0)) - F.coalesce(free, F.lit(0.0)))


def parkinson(high: Column, low: Column) -> Column:
    """(ln high - ln low)^2 / (4 ln 2)."""
    return F.pow(log_return(low, high), 2) / F.lit(4 * 0.6931471805599453)


def safe_name(s: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(s), "[^a-z0-9]", "_"), F.lit("_"))


def second_friday(month: Column) -> Column:
    """Of the month that the date lies in."""
    first = F.trunc(month, "MM")
    return F.date_add(F.next_day(F.date_sub(first, 1), "Fri"), 7)


def last_friday_before(day: Column) -> Column:
    """The most recent completed Friday."""
    return F.date_sub(day, (F.dayofweek(day) % 7 + 1).cast("int"))


def deterioration(x: Column, base: Column) -> Column:
    return (x - base) / F.greatest(F.abs(base), F.lit(1e-12))


def sample_skew(x: Column, n: Column) -> Column:
    """mean(((x - mean) / s)^3) with s by ddof = 1, from aggregates of x and its count."""
    return F.skewness(x) * F.pow((n - 1) / n, F.lit(1.5))


def sample_excess_kurtosis(x: Column, n: Column) -> Column:
    return (F.kurtosis(x) + 3) * F.pow((n - 1) / n, F.lit(2.0)) - 3


def empirical_es(losses: Column, var: Column) -> Column:
    """Mean of the losses above var, at least var; var itself when there are none."""
    above = F.filter(losses, lambda x: x > var)
    mean = F.aggregate(above, F.lit(0.0), lambda a, x: a + x) / F.size(above)
    return F.when(F.size(above) == 0, var).otherwise(F.greatest(var, mean))


#: ln Gamma(n + 3/2) for the terms of erf.
ERF_TERMS = tuple(math.lgamma(n + 1.5) for n in range(120))


def chi2_1_sf(x: Column) -> Column:
    """Upper tail of chi-square with one degree of freedom, for x up to 70: 1 - erf(z), erf(z) = exp(-z^2) sum of z^(2n+1) / Gamma(n + 3/2)."""
    z2 = x / 2
    terms = F.transform(F.array(*[F.lit(v) for v in ERF_TERMS]), lambda g, n: F.exp((n + 0.5) * F.log(z2) - z2 - g))
    return F.when(x > 0, F.greatest(1 - F.aggregate(terms, F.lit(0.0), lambda a, t: a + t), F.lit(0.0))).when(x.isNotNull(), 1.0)


def trimmed_mean(values: Column, share: float = 0.2) -> Column:
    """Mean without int(share * n) values at each end; nulls are left out first."""
    kept = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    cut = F.floor(F.size(kept) * share).cast("int")
    inner = F.slice(kept, cut + 1, F.size(kept) - 2 * cut)
    return F.when(F.size(kept) > 0, F.aggregate(inner, F.lit(0.0), lambda a, x: a + x) / F.size(inner))
