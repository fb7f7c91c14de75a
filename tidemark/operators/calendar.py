"""Session calendars, business days and contract tables from a table of session dates.

Calendars have a row for each day and do not grow with the data they describe; windows
over a whole calendar therefore run in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X


def dense(days: DataFrame, name: str = "d") -> DataFrame:
    """Every day from the first to the last."""
    return days.agg(F.min(name).alias("lo"), F.max(name).alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias(name))


def utc_offset_minutes(day: F.Column, zone: str) -> F.Column:
    """Offset of the zone at local noon of the day."""
    noon = F.to_timestamp(F.concat(day.cast("string"), F.lit(" 12:00:00")))
    return ((noon.cast("long") - F.to_utc_timestamp(noon, zone).cast("long")) / 60).cast("int")


def session_calendar(sessions: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """d, is_session, holiday_adjacent, is_dst, regime, month_start, last_friday for every day."""
    w = Window.orderBy("d")
    c = dense(sessions).join(sessions.withColumn("s", F.lit(True)), "d", "left").withColumn("is_session", F.coalesce("s", F.lit(False)))
    summer = utc_offset_minutes(F.col("d"), zone) == -240
    near = ~F.coalesce(F.lag("is_session").over(w), F.lit(True)) | ~F.coalesce(F.lead("is_session").over(w), F.lit(True))
    return c.select("d", "is_session", near.alias("holiday_adjacent"), summer.alias("is_dst"), F.when(summer, "EDT").otherwise("EST").alias("regime"), F.trunc("d", "MM").alias("month_start"), X.last_friday_before(F.col("d")).alias("last_friday"))


def business_days(days: DataFrame, n: int) -> DataFrame:
    """`days` with plus_<n>: the n-th session on a weekday after each day."""
    w = Window.orderBy("d")
    index = days.filter(F.dayofweek("d").between(2, 6)).select("d", F.row_number().over(w).alias("k"))
    at = days.join(index, "d", "left").select("d", F.coalesce(F.max("k").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).alias("k"))
    return at.join(index.select(F.col("d").alias(f"plus_{n}"), (F.col("k") - n).alias("k")), "k", "left").drop("k")


def h10_release(days: DataFrame, name: str) -> DataFrame:
    """`days` with release_utc: 16:15 New York on the next Monday, or on the first weekday session after it."""
    w = Window.orderBy("d").rowsBetween(0, Window.unboundedFollowing)
    sessions = days.filter(F.dayofweek(name).between(2, 6)).select(F.col(name).alias("d"), F.lit(1).alias("s"))
    mondays = days.select(F.next_day(name, "Mon").alias("d")).distinct().withColumn("s", F.lit(0))
    line = mondays.unionByName(sessions).groupBy("d").agg(F.max("s").alias("s"))
    first = line.withColumn("r", F.min(F.when(F.col("s") == 1, F.col("d"))).over(w)).select(F.col("d").alias("__monday"), "r")
    joined = days.withColumn("__monday", F.next_day(name, "Mon")).join(first, "__monday", "left")
    r = F.when(F.date_diff("r", "__monday") <= 10, F.col("r"))
    at = F.to_timestamp(F.concat(r.cast("string"), F.lit(" 16:15:00")))
    return joined.withColumn("release_utc", F.to_utc_timestamp(at, "America/New_York")).drop("__monday", "r")


def contract_table(sessions: DataFrame, roll_sessions: int) -> DataFrame:
    """month, sq (second Friday), last_trade (last session before it), roll_start (so many sessions earlier)."""
    w = Window.orderBy("d")
    index = sessions.select("d", F.row_number().over(w).alias("k"))
    months = sessions.agg(F.trunc(F.min("d"), "MM").alias("lo"), F.trunc(F.max("d"), "MM").alias("hi")).select(F.explode(F.expr("sequence(lo, hi, interval 1 month)")).alias("month"))
    sq = months.withColumn("sq", X.second_friday(F.col("month")))
    last = sq.join(index, (F.col("d") < F.col("sq")) & (F.col("d") >= F.date_sub("sq", 20)), "left").groupBy("month", "sq").agg(F.max("d").alias("last_trade"), F.max("k").alias("k"))
    back = index.select(F.col("d").alias("roll_start"), (F.col("k") + roll_sessions).alias("k"))
    return last.join(back, "k", "left").drop("k")
