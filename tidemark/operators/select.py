"""Exact order statistics of groups of any size, from counts.

Equal values are counted before they are shuffled.  Counts by bins of a monotone scale tell in which bins the
ranks that are asked for lie; only the values of those bins are put in order, bin by bin.
No group's values meet in one row or one task's memory, and the result is the exact one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins for each unit of the inverse hyperbolic sine of value / SCALE: a bin spans 1.6 % of the value.
BINS, SCALE = 64, 1e-6


def _match(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    right = right.withColumnsRenamed({c: f"__r_{c}" for c in on})
    same: Column = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    return left.join(right, same).drop(*[f"__r_{c}" for c in on])


def order_statistics(df: DataFrame, keys: Sequence[str], x: str, quantiles: Mapping[str, float], trims: Mapping[str, float] | None = None, weight: str | None = None) -> DataFrame:
    """keys, n, an interpolated quantile of x for each name in `quantiles`, and for each in `trims` the mean without the int(share * n) lowest
    and highest values.  Nulls and NaN are left out; a group without values has no row.  `weight` says how many times a row counts (once)."""
    trims = dict(trims or {})
    value = F.col(x).cast("double")
    counts = df.filter(F.col(x).isNotNull() & ~F.isnan(value)).groupBy(*keys, value.alias("__v")).agg((F.sum(weight) if weight else F.count("*")).alias("__n"))
    counts = counts.withColumn("__bin", F.floor(F.asinh(F.col("__v") / SCALE) * BINS))
    bins = counts.groupBy(*keys, "__bin").agg(F.sum("__n").alias("__n"), F.sum(F.col("__n") * F.col("__v")).alias("__s"))
    group = Window.partitionBy(*keys)
    upto = F.sum("__n").over(group.orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0))
    bins = bins.withColumns({"__upto": upto, "__total": F.sum("__n").over(group)}).withColumn("__start", F.col("__upto") - F.col("__n"))
    total, start, stop = F.col("__total"), F.col("__start"), F.col("__upto")
    place = {name: (total - 1) * F.lit(p) for name, p in quantiles.items()}
    ends = {name: (F.floor(total * F.lit(t)), total - F.floor(total * F.lit(t))) for name, t in trims.items()}
    cut = F.lit(False)
    for h in place.values():
        cut = cut | ((F.floor(h) >= start) & (F.floor(h) < stop)) | ((F.ceil(h) >= start) & (F.ceil(h) < stop))
    for low, high in ends.values():
        cut = cut | ((low > start) & (low < stop)) | ((high > start) & (high < stop))
    bins = bins.withColumn("__cut", cut)
    whole = {f"__k_{name}": F.sum(F.when(~F.col("__cut") & (start >= low) & (stop <= high), F.col("__s")).otherwise(0.0)) for name, (low, high) in ends.items()}
    known = bins.groupBy(*keys, "__total").agg(F.count("*").alias("__bins"), *[c.alias(name) for name, c in whole.items()])
    inside = _match(counts.select(*keys, "__bin", "__v", F.col("__n").alias("__m")), bins.filter("__cut").select(*keys, "__bin", "__start", "__total"), [*keys, "__bin"])
    last = F.col("__start") + F.sum("__m").over(Window.partitionBy(*keys, "__bin").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    inside = inside.withColumn("__q", last).withColumn("__p", F.col("__q") - F.col("__m"))
    at = lambda rank: F.max(F.when((rank >= F.col("__p")) & (rank < F.col("__q")), F.col("__v")))
    found = []
    for name, h in place.items():
        found += [at(F.floor(h)).alias(f"__lo_{name}"), at(F.ceil(h)).alias(f"__hi_{name}")]
    for name, (low, high) in ends.items():
        kept = F.greatest(F.least(F.col("__q"), high) - F.greatest(F.col("__p"), low), F.lit(0))
        found.append(F.sum(kept * F.col("__v")).alias(f"__c_{name}"))
    out = _match(known, inside.groupBy(*keys).agg(*found), keys)
    between = lambda name, h: F.col(f"__lo_{name}") + (h - F.floor(h)) * (F.col(f"__hi_{name}") - F.col(f"__lo_{name}"))
    return out.select(*keys, total.alias("n"), *[between(n, h).alias(n) for n, h in place.items()], *[((F.col(f"__k_{n}") + F.col(f"__c_{n}")) / (hi - lo)).alias(n) for n, (lo, hi) in ends.items()])


def exceedances(df: DataFrame, keys: Sequence[str], x: str, grid: Mapping[str, float]) -> DataFrame:
    """keys, q, n, u, below, x: the values above the quantile u of each level in the grid, with the number of the key's values and
    the greatest value that is not above u.  The grid is short; each value meets its key's thresholds once."""
    cuts = order_statistics(df, keys, x, grid)
    cells = F.array(*[F.struct(F.lit(q).alias("q"), F.col(name).alias("u")) for name, q in grid.items()])
    cuts = cuts.select(*keys, "n", F.explode(cells).alias("__c")).select(*keys, "n", "__c.*")
    met = _match(df.select(*keys, x), cuts, keys)
    inner = met.filter(F.col(x) <= F.col("u")).groupBy(*keys, "q").agg(F.max(x).alias("below"))
    return _match(met.filter(F.col(x) > F.col("u")), inner, [*keys, "q"])
