"""Binding of a leakage audit to the panel that it saw.

An audit's result holds for one content of the panel and one calendar.  The binding keeps, for
each part of the panel (a month), its rows, bounds and failures, and for each column of each part a
hash of its cells as a multiset of (key, cell); before the panel is used again the same
numbers are worked out anew, and what differs names the part and the column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class StaleBinding(ValueError):
    """The panel or the calendar is not the one that was audited."""


def text_hash(cells: Sequence[Column]) -> Column:
    """60 bits of the md5 of the cells' texts; null is told from text, and the cells from each other."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in cells]
    return F.conv(F.substring(F.md5(F.concat_ws("\u001f", *parts)), 1, 15), 16, 10).cast("decimal(38,0)")


def bind(panel: DataFrame, keys: Sequence[str], columns: Sequence[str], part: Column, day: str, available: str, cutoff: str) -> DataFrame:
    """part, rows, first_day, last_day, failures, and h_<column> for each column: one aggregation, added up in any order.

    Values known after the cutoff fail, and so do those without a time.
    """
    late = F.coalesce(F.col(available).cast("timestamp") > F.col(cutoff).cast("timestamp"), F.lit(True))
    return panel.groupBy(part.alias("part")).agg(
        F.count("*").alias("rows"), F.min(day).cast("string").alias("first_day"), F.max(day).cast("string").alias("last_day"), F.count_if(late).alias("failures"),
        *[F.sum(text_hash([*[F.col(k) for k in keys], F.col(c)])).cast("string").alias(f"h_{c}") for c in columns],
    )


def calendar_hash(calendar: DataFrame, columns: Sequence[str]) -> str:
    return calendar.agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), F.sum(text_hash([F.col(c) for c in columns])).cast("string")), 256)).first()[0]


def differences(bound: DataFrame, now: DataFrame) -> DataFrame:
    """part, field: where two bindings differ, a part that one of them lacks as field `part`."""
    fields = [c for c in bound.columns if c != "part"]
    met = _long(bound, fields, "was").join(_long(now, fields, "is"), (F.col("part").eqNullSafe(F.col("__part"))) & (F.col("field") == F.col("__field")), "full_outer")
    lost = F.col("field").isNull() | F.col("__field").isNull()
    changed = lost | ~F.col("was").eqNullSafe(F.col("is"))
    return met.filter(changed).select(F.coalesce("part", "__part").alias("part"), F.when(lost, "part").otherwise(F.col("field")).alias("field")).distinct()


def _long(df: DataFrame, fields: Sequence[str], name: str) -> DataFrame:
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in fields])).alias("c")
    prefix = "" if name == "was" else "__"
    return df.select(F.col("part").alias(f"{prefix}part"), cells).select(f"{prefix}part", F.col("c.field").alias(f"{prefix}field"), F.col("c.value").alias(name))


def require_bound(bound: DataFrame, now: DataFrame, calendar_was: str, calendar_is: str) -> None:
    """Raise unless panel and calendar are the audited ones and the audit found no failure."""
    if calendar_was != calendar_is:
        raise StaleBinding("the calendar is not the one of the audit")
    if rows := differences(bound, now).orderBy("part", "field").limit(5).collect():
        raise StaleBinding(f"the panel is not the one of the audit: {[(r.part, r.field) for r in rows]}")
    if (failed := bound.agg(F.sum("failures")).first()[0] or 0) > 0:
        raise StaleBinding(f"the audit has {failed} failures")


def row_invariant(panel: DataFrame, available: str, cutoff: str, values: Sequence[str]) -> DataFrame:
    """Rows that break the row-level rule, which holds for panels without times for each feature: a row with any value has a time, and
    that is not after the cutoff."""
    some = F.coalesce(*[F.when(F.col(v).isNotNull(), F.lit(True)) for v in values], F.lit(False))
    late = F.coalesce(F.col(available).cast("timestamp") > F.col(cutoff).cast("timestamp"), F.lit(True))
    return panel.filter(some & late)
