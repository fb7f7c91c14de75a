"""Partitioned tables: reading with pruning, writing by month or by job key, and completeness checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_months(df: DataFrame, path: str, day: str, mode: str = "overwrite") -> None:
    """Write below year=/month= folders; rows of a month meet in few files, without a hot month in one task."""
    out = df.withColumns({"year": F.year(day), "month": F.month(day)})
    out.write.mode(mode).option("compression", "zstd").partitionBy("year", "month").parquet(path)


def write_jobs(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Overwrite only the partitions (job keys) that are in `df`."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def pending(jobs: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Jobs without a finished row: what a resumed run has to do."""
    return jobs.join(done, list(keys), "left_anti")


def scan(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def scan_optional(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The table, or no rows if there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def in_range(day: Sequence[Column], start: str, end: str) -> Column:
    """The first non-null of the columns, as an ISO date, lies between both ends."""
    return F.substring(F.coalesce(*[c.cast("string") for c in day]), 1, 10).between(start, end)


def month_range(start: str, end: str) -> Column:
    """A predicate on year and month, so that only the folders of the range are listed and read."""
    lo, hi = (int(s[:4]) * 12 + int(s[5:7]) for s in (start, end))
    return (F.col("year") * 12 + F.col("month")).between(lo, hi)


def covers(have: DataFrame, need: DataFrame, day: str) -> bool:
    """Whether every needed day is there."""
    return need.select(day).distinct().join(have.select(day).distinct(), day, "left_anti").isEmpty()


def read_series_csv(spark: SparkSession, path: str, columns: Sequence[str], missing: str = ".") -> DataFrame:
    """CSV with a header; `missing` marks nulls; all values as text, in files of any column order."""
    df = spark.read.option("header", True).option("nullValue", missing).csv(path)
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not columns or c in columns])
