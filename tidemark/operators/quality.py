"""Flags, key checks, coverage and leakage audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ohlc_flags(bars: DataFrame) -> DataFrame:
    """invalid_price: any price null or not above 0; ohlc_violation: high or low inside the other prices."""
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    bad = F.lit(False)
    for p in prices:
        bad = bad | p.isNull() | (p <= 0)
    o, h, lo, c = prices
    return bars.withColumns({"invalid_price": bad, "ohlc_violation": (h < F.greatest(o, c, lo)) | (lo > F.least(o, c, h))})


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).count().filter("count > 1")


def require_unique(df: DataFrame, keys: Sequence[str]) -> None:
    """Raise if a key occurs more than once."""
    row = duplicate_keys(df, keys).limit(1).first()
    if row:
        raise ValueError(f"repeated key: {row.asDict()}")


def unpivot_features(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.unpivot(list(ids), list(columns), "feature", "value")


def coverage(long: DataFrame, feature: str, day: str, value: str, days: int) -> DataFrame:
    """Per feature: non-missing values, share missing of `days`, first and last day with a value."""
    valid = F.when(F.col(value).isNotNull(), F.col(day))
    return long.groupBy(feature).agg(
        F.count(value).alias("non_missing"),
        (1 - F.count(value) / F.lit(float(days))).alias("missing_rate"),
        F.min(valid).alias("first_valid"),
        F.max(valid).alias("last_valid"),
    )


def leakage_audit(long: DataFrame, value: str, available: str, cutoff: str) -> DataFrame:
    """status and lag_minutes of each value: missing ones warn, values known after the cutoff or at an unknown time fail."""
    known, limit = F.col(available).cast("timestamp"), F.col(cutoff).cast("timestamp")
    status = F.when(F.col(value).isNull(), "warn").when(known.isNull() | (known > limit), "fail").otherwise("pass")
    return long.withColumns({"status": status, "lag_minutes": F.floor((limit.cast("long") - known.cast("long")) / 60)})


def table_signature(df: DataFrame) -> DataFrame:
    """One row: the number of rows and an order-free hash of their contents; nulls are told from text."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("<NULL>")) for c in sorted(df.columns)]
    h = F.xxhash64(*parts)
    return df.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws(":", F.bit_xor(h).cast("string"), F.sum(F.shiftright(h, 20)).cast("string")), 256).alias("signature"))
