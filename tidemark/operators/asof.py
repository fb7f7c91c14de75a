"""Timestamp-safe as-of joins.

All of them are linear: left and right rows are put on one time line and a running
maximum carries the newest usable right row forward.  A right row is usable from the
later of its event time and its knowledge time, so rows that become known out of order
are handled.  With `bucket`, time is cut into buckets that are scanned in parallel, and
only the newest row of each bucket is carried over to later ones, so that one key may
hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialise


def asof_join(
    left: DataFrame,
    right: DataFrame,
    left_time: str,
    right_time: str,
    by: Sequence[str] = (),
    columns: Sequence[str] | None = None,
    available: str | None = None,
    cutoff: str | None = None,
    strict: bool = False,
    tolerance_days: int | None = None,
    bucket: str | None = None,
    suffix: str = "",
) -> DataFrame:
    """`left` with `columns` of the newest usable right row; one output row for each left row.

    A right row is usable if right_time <= left_time (< with `strict`) and, with `available`,
    if available <= cutoff (the left column; left_time by default).  Knowledge time is not before
    event time and a cutoff not after left_time.  Older rows than `tolerance_days` (inclusive) give nulls.
    """
    columns = list(columns or [c for c in right.columns if c not in by])
    usable = F.greatest(F.col(right_time).cast("timestamp"), F.col(available).cast("timestamp")) if available else F.col(right_time).cast("timestamp")
    at = F.col(cutoff or left_time).cast("timestamp")
    payload = F.struct(F.col(right_time).alias("__time"), *[F.col(c).alias(f"p_{c}") for c in columns])
    keys = [F.col(k).alias(f"__{k}") for k in by]
    r = right.filter(F.col(right_time).isNotNull()).select(*keys, usable.alias("__t"), F.lit(1 if strict else 0).alias("__side"), payload.alias("__right"), F.lit(None).cast(left.schema).alias("__left"))
    line = left.select(*keys, at.alias("__t"), F.lit(0 if strict else 1).alias("__side"), F.lit(None).cast(r.schema["__right"].dataType).alias("__right"), F.struct(*[F.col(c) for c in left.columns]).alias("__left")).unionByName(r)
    parts = [f"__{k}" for k in by]
    if bucket:
        line = line.withColumn("__bucket", F.date_trunc(bucket, "__t"))
    w = Window.partitionBy(*parts, *(["__bucket"] if bucket else [])).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = line.withColumn("__best", F.max("__right").over(w))
    if bucket:
        before = Window.partitionBy(*parts).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
        newest = line.groupBy(*parts, "__bucket").agg(F.max("__right").alias("__newest"))
        carried = newest.select(*[F.col(p).alias(f"c{p}") for p in parts], F.col("__bucket").alias("c__bucket"), F.max("__newest").over(before).alias("__carried"))
        match: Column = F.col("__bucket").eqNullSafe(F.col("c__bucket"))
        for p in parts:
            match = match & F.col(p).eqNullSafe(F.col(f"c{p}"))
        found = found.join(carried, match, "left").withColumn("__best", F.greatest("__best", "__carried"))
    found = found.filter("__left is not null")
    fresh = F.lit(True)
    if tolerance_days is not None:
        fresh = F.date_diff(F.to_date(F.col(f"__left.{left_time}")), F.to_date(F.col("__best.__time"))) <= tolerance_days
    return found.select("__left.*", *[F.when(fresh, F.col(f"__best.p_{c}")).alias(f"{c}{suffix}") for c in columns])


def interval_join(points: DataFrame, intervals: DataFrame, point: str, low: str, high: str, by: Sequence[str] = (), bucket_days: int = 32, how: str = "inner") -> DataFrame:
    """Each interval with the points (dates) of its key from `low` to `high`, both included; with how="left" intervals without points stay.

    An interval goes to every bucket of days that it touches, a point to its own; both meet in an equi-join on key and bucket, so
    that neither side is broadcast and no pair of far apart rows is formed.  The columns of both sides have distinct names but for the keys.
    """
    number = lambda c: F.floor(F.unix_date(F.col(c)) / bucket_days)
    cut = intervals
    if how == "left":  # numbers that are the same in both uses
        cut = materialise(intervals.withColumn("__id", F.monotonically_increasing_id()), "intervals")
    spread = cut.withColumn("__bucket", F.explode(F.when(F.col(low) <= F.col(high), F.sequence(number(low), number(high))).otherwise(F.array())))
    right = points.withColumn("__b", number(point)).withColumnsRenamed({k: f"__p_{k}" for k in by})
    met = spread.join(right, [F.col("__bucket") == F.col("__b"), *[F.col(k).eqNullSafe(F.col(f"__p_{k}")) for k in by]]).filter(F.col(point).between(F.col(low), F.col(high)))
    met = met.drop("__bucket", "__b", *[f"__p_{k}" for k in by])
    if how == "inner":
        return met
    extra = [c for c in points.columns if c not in by]
    found = met.select("__id", *extra)
    return cut.join(found, "__id", "left").drop("__id")


def asof_long(left: DataFrame, features: DataFrame, left_time: str, cutoff: str | None = None, available: str | None = None, tolerance_days: int | None = None) -> DataFrame:
    """Every feature picks its own newest non-null usable row: (left columns, feature, value, source_time).

    `features` has rows (feature, source_time, value[, available]).
    """
    names = features.select("feature").distinct()
    grid = left.crossJoin(F.broadcast(names))  # names of features: a fixed, small list
    return asof_join(grid, features.filter("value is not null"), left_time, "source_time", ["feature"], ["value", "source_time"], available, cutoff, tolerance_days=tolerance_days)


def previous_of(df: DataFrame, key: Sequence[str], time: str, columns: Sequence[str]) -> DataFrame:
    """`df` with prev_<column> of the row before in the same key."""
    w = Window.partitionBy(*key).orderBy(time)
    return df.withColumns({f"prev_{c}": F.lag(c).over(w) for c in columns})
