"""Rolling, expanding and gap-and-island operators on ordered series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def series(keys: Sequence[str], order: str) -> WindowSpec:
    """Without keys there is one series, whose rows meet in one task: only for calendar-sized data."""
    return Window.partitionBy(*keys).orderBy(order)


def prior(w: WindowSpec, rows: int | None = None) -> WindowSpec:
    """The rows before the current one: all, or the last so many."""
    return w.rowsBetween(Window.unboundedPreceding if rows is None else -rows, -1)


def latest(w: WindowSpec, rows: int) -> WindowSpec:
    """The last so many rows, the current one among them."""
    return w.rowsBetween(-(rows - 1), 0)


def with_minimum(x: Column, value: Column, frame: WindowSpec, least: int) -> Column:
    """`value` if the frame has at least so many non-null x."""
    return F.when(F.count(x).over(frame) >= least, value)


def last_known(x: str, w: WindowSpec) -> Column:
    """The newest non-null value before the current row."""
    return F.last(x, ignorenulls=True).over(prior(w))


def z_score(x: Column, frame: WindowSpec) -> Column:
    spread = F.stddev_samp(x).over(frame)
    return (x - F.avg(x).over(frame)) / F.when(spread > 0, spread)


def percent_rank_of(x: Column, values: Column) -> Column:
    """Share of `values` (an array) that are not above x."""
    return F.size(F.filter(values, lambda v: v <= x)) / F.size(values)


def semivariance(x: Column, positive: bool, frame: WindowSpec) -> Column:
    """Mean of the squares of the values of one sign; 0 if there are none."""
    chosen = F.when(x > 0 if positive else x < 0, x * x)
    return F.coalesce(F.avg(chosen).over(frame), F.lit(0.0))


def islands(df: DataFrame, keys: Sequence[str], time: str, gap_days: int, name: str = "cluster") -> DataFrame:
    """Number the clusters of each key: a gap of more than `gap_days` starts a new one."""
    w = series(keys, time)
    new = F.coalesce(F.date_diff(F.col(time), F.lag(time).over(w)) > gap_days, F.lit(True))
    return df.withColumn(name, F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))


def spaced_top(df: DataFrame, keys: Sequence[str], time: str, value: str, k: int, spacing_days: int) -> DataFrame:
    """Greedy choice of the k largest values of each key, no two within `spacing_days`.

    The choice is made over an array of the key's (value, day) pairs, largest first; give it the
    extremes of a series, not an unbounded one.
    """
    pairs = F.array_sort(F.collect_list(F.struct((-F.col(value)).alias("v"), F.col(time).alias("t"))))
    empty = F.array().cast(f"array<struct<v:double,t:{dict(df.dtypes)[time]}>>")
    take = lambda acc, p: F.when(
        (F.size(acc) < k) & ~F.exists(acc, lambda q: F.abs(F.date_diff(q["t"], p["t"])) < spacing_days), F.concat(acc, F.array(p))
    ).otherwise(acc)
    chosen = df.groupBy(*keys).agg(F.aggregate(pairs, empty, take).alias("picks"))
    return chosen.select(*keys, F.posexplode("picks").alias("rank", "p")).select(*keys, (F.col("rank") + 1).alias("rank"), F.col("p.t").alias(time), (-F.col("p.v")).alias(value))
