"""Running statistics of long series, cut into blocks of time so that one key's rows spread over tasks.

Rows get their position in the series from a sort by ranges.  Sums, decayed sums and
quantiles of all rows before each one are then put together from what earlier blocks have in total and
what the row's own block has before it; only totals, one row for each block (and value bin), are
accumulated along the series.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .store import materialise

#: Rows of a series that one task handles at once.
BLOCK = 4096
#: Value bins for each unit of the inverse hyperbolic sine of standardised values.
BINS = 64
#: Decay below which double precision has nothing left.
VANISHED = 745.0


def _meet(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on columns that may be null; those of the right side go."""
    right = right.withColumnsRenamed({c: f"__r_{c}" for c in on})
    match = [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in on]
    return left.join(right, match, how).drop(*[f"__r_{c}" for c in on])


def positions(df: DataFrame, keys: Sequence[str], time: str, name: str = "pos") -> DataFrame:
    """`df` with the position of each row in its key's series, from 0; written once to the shared folder.

    Times are distinct within a key.  A series may lie in many parts of the sort by ranges.
    """
    order = [*keys, time]
    dealt = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()), "series")
    part = F.shiftright("__id", 33)
    sizes = dealt.groupBy(*keys, part.alias("__part")).agg(F.count("*").alias("__n"), F.min("__id").alias("__least"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__least")).alias("__shift"))
    placed = _meet(dealt.withColumn("__part", part), starts, [*keys, "__part"])
    return placed.withColumn(name, F.col("__id") + F.col("__shift")).drop("__id", "__part", "__shift")


def running_sums(df: DataFrame, keys: Sequence[str], sums: Mapping[str, Column], pos: str = "pos", size: int = BLOCK) -> DataFrame:
    """Add the sum of each expression over all rows before a row (0 for the first)."""
    block = F.floor(F.col(pos) / size)
    rows = df.withColumns({"__b": block, **{f"__x_{k}": v for k, v in sums.items()}})
    totals = rows.groupBy(*keys, "__b").agg(*[F.sum(f"__x_{k}").alias(f"__t_{k}") for k in sums])
    along = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, "__b", *[F.coalesce(F.sum(f"__t_{k}").over(along), F.lit(0.0)).alias(f"__c_{k}") for k in sums])
    inside = Window.partitionBy(*keys, "__b").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumns({f"__l_{k}": F.coalesce(F.sum(f"__x_{k}").over(inside), F.lit(0.0)) for k in sums})
    out = _meet(local, carried, [*keys, "__b"]).withColumns({k: F.col(f"__c_{k}") + F.col(f"__l_{k}") for k in sums})
    return out.drop("__b", *[f"__{p}_{k}" for p in "xlc" for k in sums])


def linear_filter(df: DataFrame, keys: Sequence[str], pushes: Mapping[str, Column], decay: float, start: Column | float = 0.0, pos: str = "pos", size: int = BLOCK) -> DataFrame:
    """Add y, where y = start for a key's first row and y' = decay * y + push for each next one.

    Inside a block y is in closed form from running sums; the blocks are short enough for its weights.  A block starts from the
    sums of earlier blocks, as far back as their weights do not vanish.
    """
    if not 0 < abs(decay) < 1:
        raise ValueError("the decay must lie between 0 and 1")
    rate = -math.log(abs(decay))
    size = max(1, min(size, int(600 / rate)))
    back = math.ceil(VANISHED / (rate * size)) + 1
    power = lambda e: F.pow(F.lit(float(decay)), e.cast("double"))
    start = start if isinstance(start, Column) else F.lit(float(start))
    rows = df.withColumns({"__b": F.floor(F.col(pos) / size), "__j": F.col(pos) % size, **{f"__x_{k}": v for k, v in pushes.items()}})
    ends = rows.groupBy(*keys, "__b").agg(*[F.sum(F.col(f"__x_{k}") * power(size - 1 - F.col("__j"))).alias(f"__e_{k}") for k in pushes])
    recent = Window.partitionBy(*keys).orderBy("__b").rowsBetween(-back, -1)
    step = float(decay) ** size
    fold = lambda c: F.aggregate(F.collect_list(c).over(recent), F.lit(0.0), lambda a, x: a * step + x)
    carried = ends.select(*keys, "__b", *[fold(f"__e_{k}").alias(f"__c_{k}") for k in pushes])
    inside = Window.partitionBy(*keys, "__b").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumns({f"__l_{k}": F.coalesce(F.sum(F.col(f"__x_{k}") * power(-1 - F.col("__j"))).over(inside), F.lit(0.0)) for k in pushes})
    y = lambda k: start * power(F.col(pos)) + power(F.col("__j")) * (F.col(f"__c_{k}") + F.col(f"__l_{k}"))
    out = _meet(local, carried, [*keys, "__b"]).withColumns({k: y(k) for k in pushes})
    return out.drop("__b", "__j", *[f"__{p}_{k}" for p in "xlc" for k in pushes])


def sliding_sums(df: DataFrame, keys: Sequence[str], sums: Mapping[str, Column], window: int, pos: str = "pos") -> DataFrame:
    """Add the sum of each expression over the last `window` rows, the current one among them; fewer at the start.

    Blocks of `window` rows: what a window has is the end of one block and the start of the next, each a running sum inside its block,
    once forwards and once backwards.  At most 2 x window values are ever added up, so the rounding error of a sum stays below
    2 x window x 2^-53 times the sum of absolute values, however long the series.
    """
    rows = df.withColumns({"__b": F.floor(F.col(pos) / window), **{f"__x_{k}": v for k, v in sums.items()}})
    ahead = Window.partitionBy(*keys, "__b").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*keys, "__b").orderBy(F.col(pos).desc()).rowsBetween(Window.unboundedPreceding, 0)
    both = rows.withColumns({f"__{name}_{k}": F.coalesce(F.sum(f"__x_{k}").over(frame), F.lit(0.0)) for k in sums for name, frame in (("a", ahead), ("z", back))})
    # the window of row i starts at row i - window + 1, in the block before unless row i ends its own
    ends = both.filter((F.col(pos) % window) > 0).select(*keys, (F.col(pos) + window - 1).alias("__at"), *[F.col(f"__z_{k}").alias(f"__e_{k}") for k in sums])
    out = _meet(both.withColumn("__at", F.col(pos)), ends, [*keys, "__at"], "left")
    out = out.withColumns({k: F.col(f"__a_{k}") + F.coalesce(F.col(f"__e_{k}"), F.lit(0.0)) for k in sums})
    return out.drop("__b", "__at", *[f"__{p}_{k}" for p in "xaze" for k in sums])


def sliding_moments(df: DataFrame, keys: Sequence[str], x: str, window: int, pos: str = "pos") -> DataFrame:
    """Add n, mean, sd (ddof 1), skew and kurt of the last `window` values of x: mean(((x - mean) / sd)^k), less 3 for k = 4; sd 0 gives nulls.

    Powers are taken of values less the key's mean.
    """
    centre = df.groupBy(*keys).agg(F.avg(x).alias("__m"))
    z = F.col(x) - F.col("__m")
    rows = sliding_sums(_meet(df, centre, keys) if keys else df.crossJoin(centre), keys, {"__s0": F.when(F.col(x).isNotNull(), 1.0), **{f"__s{k}": F.pow(z, F.lit(float(k))) for k in range(1, 5)}}, window, pos)
    n = F.when(F.col("__s0") > 0, F.col("__s0"))
    m, r2, r3, r4 = (F.col(f"__s{k}") / n for k in range(1, 5))
    m2, m3, m4 = r2 - m * m, r3 - 3 * m * r2 + 2 * m * m * m, r4 - 4 * m * r3 + 6 * m * m * r2 - 3 * m * m * m * m
    variance = F.when(n > 1, F.greatest(m2, F.lit(0.0)) * n / (n - 1))
    sd = F.when(variance > 1e-24, F.sqrt(variance))
    out = rows.withColumns({"n": F.col("__s0").cast("long"), "mean": m + F.col("__m"), "sd": F.sqrt(variance), "skew": m3 / (sd * sd * sd), "kurt": m4 / (sd * sd * sd * sd) - 3})
    return out.drop("__m", *[f"__s{k}" for k in range(5)])


def moments(df: DataFrame, keys: Sequence[str], x: str, decay: float, pos: str = "pos", size: int = BLOCK) -> DataFrame:
    """Add mean and ewma: of the rows before each one the mean, and the EWMA variance centred on it that starts from the sample variance
    (both null where they have no rows, or one)."""
    centre = df.groupBy(*keys).agg(F.avg(x).alias("__m"))
    rows = _meet(df, centre, keys) if keys else df.crossJoin(centre)
    z = F.col(x) - F.col("__m")
    rows = running_sums(rows, keys, {"__s1": z, "__s2": z * z}, pos, size)
    rows = linear_filter(rows, keys, {"__d0": F.lit(1.0), "__d1": z, "__d2": z * z}, decay, 0.0, pos, size)
    n, mean = F.col(pos), F.col("__s1") / F.when(F.col(pos) > 0, F.col(pos))
    variance = (F.col("__s2") - n * mean * mean) / F.when(n > 1, n - 1)
    recent = (1 - decay) * (F.col("__d2") - 2 * mean * F.col("__d1") + mean * mean * F.col("__d0"))
    out = rows.withColumns({"mean": mean + F.col("__m"), "ewma": F.pow(F.lit(decay), n.cast("double")) * F.greatest(variance, F.lit(0.0)) + recent})
    return out.drop("__m", "__s1", "__s2", "__d0", "__d1", "__d2")


class RankTree:
    """A wavelet matrix over a sequence of numbers with weights: order statistics of any stretch of it, many at once."""

    def __init__(self, values: np.ndarray, weights: np.ndarray):
        self.values, codes = np.unique(values, return_inverse=True)
        self.levels = []
        for b in reversed(range(max(1, (len(self.values) - 1).bit_length()))):
            bit = codes >> b & 1
            upto = lambda x: np.append(0, np.cumsum(x))
            self.levels.append((b, upto(bit), upto(weights * (1 - bit)), upto(weights * bit), upto(weights * bit * values)))
            order = np.argsort(bit, kind="stable")
            codes, values, weights = codes[order], values[order], weights[order]

    def select(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k-th smallest (from 0) of the items from lo to before hi, and the weight and the sum of all that are larger."""
        lo, hi, k = (np.asarray(v, np.int64) for v in (lo, hi, k))
        code, more, total = np.zeros(len(k), np.int64), np.zeros(len(k)), np.zeros(len(k))
        for b, ones, small, large, sums in self.levels:
            zeros = len(ones) - 1 - ones[-1]
            under = small[hi] - small[lo]
            right = k >= under
            more += np.where(right, 0, large[hi] - large[lo])
            total += np.where(right, 0.0, sums[hi] - sums[lo])
            code |= right.astype(np.int64) << b
            k = np.where(right, k - under, k).astype(np.int64)
            lo, hi = (np.where(right, zeros + ones[v], v - ones[v]) for v in (lo, hi))
        return self.values[np.minimum(code, len(self.values) - 1)], more, total


def _interpolated(tree: RankTree, lo: np.ndarray, hi: np.ndarray, n: np.ndarray, below: np.ndarray, level: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantile of n values of which `below` lie under the tree's, with weight and sum of larger ones in the tree."""
    h = (n - 1) * level
    k = np.floor(h).astype(np.int64)
    low, more, total = tree.select(lo, hi, k - below)
    high, _, _ = tree.select(lo, hi, np.minimum(k + 1, n - 1) - below)
    return low + (h - k) * (high - low), more, total


def quantiles(df: DataFrame, keys: Sequence[str], x: str, level: float, window: int, pos: str = "pos", size: int = BLOCK, bins: int = BINS) -> DataFrame:
    """Add q_all, es_all, q_recent, es_recent: the interpolated quantile of x over all rows before each one and over the last `window` of
    them, each with the mean of the values above it (the quantile where there are none); and above_all, above_recent, how many these are.

    A block needs those earlier values only whose ranks its rows can ask for: counts by block and value bin tell which bins hold them, and
    these values come to the block as (value, count); the rest is known by its count and sum.  Rows without x are not allowed.
    """
    names, kinds = df.columns, {f.name: f.dataType.simpleString() for f in df.schema}
    added = ["q_all", "es_all", "q_recent", "es_recent", "above_all", "above_recent"]
    spread = df.groupBy(*keys).agg(F.avg(x).alias("__m"), F.stddev_pop(x).alias("__sd"))
    rows = _meet(df, spread, keys) if keys else df.crossJoin(spread)
    scaled = F.coalesce((F.col(x) - F.col("__m")) / F.when(F.col("__sd") > 0, F.col("__sd")), F.lit(0.0))
    rows = rows.withColumns({"__b": F.floor(F.col(pos) / size), "__bin": F.floor(F.asinh(scaled) * bins)}).drop("__m", "__sd")
    counts = rows.groupBy(*keys, "__b", "__bin").agg(F.count("*").alias("__n"), F.sum(x).alias("__s"))
    blocks = rows.groupBy(*keys, "__b").agg(F.count("*").alias("__own"))
    grid = _meet(blocks, counts.select(*keys, "__bin").distinct(), keys) if keys else blocks.crossJoin(counts.select("__bin").distinct())
    along = Window.partitionBy(*keys, "__bin").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    grid = _meet(grid, counts, [*keys, "__b", "__bin"], "left").withColumns({"__p": F.coalesce(F.sum("__n").over(along), F.lit(0)), "__ps": F.coalesce(F.sum("__s").over(along), F.lit(0.0))})
    upto = F.sum("__p").over(Window.partitionBy(*keys, "__b").orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0))
    prefix = F.col("__b") * size
    first, last = F.floor((prefix - 1) * level) - F.col("__own"), F.ceil((prefix + F.col("__own") - 2) * level) + 1
    asked = (F.col("__upto") > first) & (F.col("__upto") - F.col("__p") <= last)
    grid = grid.filter("__b > 0").withColumn("__upto", upto).withColumn("__asked", asked)
    rest = lambda c, cond: F.sum(F.when(cond, F.col(c)).otherwise(0))
    under, over = ~F.col("__asked") & (F.col("__upto") <= first), ~F.col("__asked") & (F.col("__upto") > first)
    known = grid.groupBy(*keys, F.col("__b").alias("__t")).agg(rest("__p", under).alias("__w"), rest("__p", over).alias("__j"), rest("__ps", over).alias("__v"))
    wanted = grid.filter("__asked and __p > 0").select(*keys, "__bin", F.col("__b").alias("__t"))
    earlier = _meet(rows, wanted, [*keys, "__bin"]).filter("__b < __t").groupBy(*keys, "__t", F.col(x).alias("__v")).agg(F.count("*").alias("__w"))
    halo = rows.withColumn("__t", F.explode(F.sequence(F.col("__b") + 1, F.floor((F.col(pos) + window) / size)))).filter(F.floor((F.col(pos) + window) / size) > F.col("__b"))
    own = F.struct(*names)
    parts = [  # kind 0: counts of what is known, 1: earlier values, 2: values of the window, 3: the block's own rows
        known.select(*keys, "__t", F.lit(0).alias("__kind"), F.col("__v").cast("double").alias("__v"), F.col("__w").cast("long").alias("__w"), F.col("__j").cast("long").alias("__j")),
        earlier.select(*keys, "__t", F.lit(1).alias("__kind"), F.col("__v").cast("double").alias("__v"), "__w", F.lit(0).cast("long").alias("__j")),
        halo.filter("__t > __b").select(*keys, "__t", F.lit(2).alias("__kind"), F.col(x).cast("double").alias("__v"), F.lit(1).cast("long").alias("__w"), F.col(pos).cast("long").alias("__j")),
        rows.select(*keys, F.col("__b").alias("__t"), F.lit(3).alias("__kind"), F.col(x).cast("double").alias("__v"), F.lit(1).cast("long").alias("__w"), F.col(pos).cast("long").alias("__j"), own.alias("__row")),
    ]
    together = parts[3]
    for part in parts[:3]:
        together = together.unionByName(part, allowMissingColumns=True)

    def run(table: pa.Table) -> pa.Table:
        kind, value, weight, place = (table.column(c).to_numpy() for c in ("__kind", "__v", "__w", "__j"))
        mine = np.flatnonzero(kind == 3)
        mine = mine[np.argsort(place[mine])]
        v, at = value[mine], place[mine]
        known = np.flatnonzero(kind == 0)
        below, above, above_sum = (int(weight[known[0]]), int(place[known[0]]), float(value[known[0]])) if len(known) else (0, 0, 0.0)
        old = np.flatnonzero(kind == 1)
        ones = np.ones(len(v), np.int64)
        tree = RankTree(np.append(value[old], v), np.append(weight[old], ones))
        j = np.arange(len(v))
        some = at > 0
        out, higher = np.full((4, len(v)), np.nan), np.zeros((2, len(v)), np.int64)

        def put(k: int, q: np.ndarray, more: np.ndarray, total: np.ndarray) -> None:
            out[k, some], higher[k // 2, some] = q, more
            out[k + 1, some] = np.where(more > 0, np.maximum(q, total / np.maximum(more, 1)), q)

        if some.any():
            q, more, total = _interpolated(tree, np.zeros(int(some.sum()), np.int64), len(old) + j[some], at[some], np.full(int(some.sum()), below), level)
            put(0, q, more + above, total + above_sum)
            near = np.flatnonzero(kind == 2)
            near = near[np.argsort(place[near])]
            recent = RankTree(np.append(value[near], v), np.ones(len(near) + len(v), np.int64))
            hi = len(near) + j[some]
            lo = np.maximum(hi - window, 0)
            put(2, *_interpolated(recent, lo, hi, hi - lo, np.zeros(len(hi), np.int64), level))
        fields = table.column("__row").combine_chunks().take(pa.array(mine))
        return pa.Table.from_arrays([*fields.flatten(), *[pa.array(o, from_pandas=True) for o in out], *map(pa.array, higher)], [*names, *added])

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in names], *[f"{c} double" for c in added[:4]], *[f"{c} long" for c in added[4:]]])
    return together.groupBy(*keys, "__t").applyInArrow(run, schema)


def _block_sizes(n: int) -> np.ndarray:
    from .numerics import block_grid

    return block_grid(n)


def block_maxima(df: DataFrame, keys: Sequence[str], x: str, sizes: Callable[[int], Sequence[int]] = _block_sizes, pos: str = "pos", size: int = BLOCK) -> DataFrame:
    """keys, block, v, m: how often v is the maximum of `block` consecutive rows, for each size that `sizes` gives for the key's number of rows.

    The series is cut into parts at least as long as the longest block; a part also holds the rows before it that its blocks reach, so
    a row goes to two parts and no task has a whole series.  Equal maxima are counted where they arise.
    """
    n = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    longest = F.udf(lambda n: int(max(sizes(n), default=1)), "long")  # once for each key
    n = n.withColumn("__reach", longest("__n")).withColumn("__size", F.greatest(F.lit(size), F.col("__reach")))
    rows = _meet(df.select(*keys, pos, F.col(x).cast("double").alias("__x")), n, keys)
    last = F.least(F.floor((F.col(pos) + F.col("__reach") - 1) / F.col("__size")), F.floor((F.col("__n") - 1) / F.col("__size")))
    rows = rows.withColumn("__part", F.explode(F.sequence(F.floor(F.col(pos) / F.col("__size")), last)))
    schema = StructType([*[df.schema[k] for k in keys], StructField("block", LongType()), StructField("v", DoubleType()), StructField("m", LongType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos)
        values, places = pdf["__x"].to_numpy(), pdf[pos].to_numpy()
        start = int(pdf["__part"].iloc[0]) * int(pdf["__size"].iloc[0])
        own = int((places < start).sum())
        found = []
        for b in map(int, sizes(int(pdf["__n"].iloc[0]))):
            part = values[max(0, own - b + 1) :]
            if len(part) >= b:
                v, m = np.unique(np.lib.stride_tricks.sliding_window_view(part, b).max(1), return_counts=True)
                found.append(pd.DataFrame({"block": b, "v": v, "m": m}))
        out = pd.concat(found) if found else pd.DataFrame({"block": [], "v": [], "m": []})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[schema.names]

    return rows.groupBy(*keys, "__part").applyInPandas(run, schema)
