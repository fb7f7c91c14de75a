"""Normalisers from vendor-shaped rows to typed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X


def parse_option_ticker(df: DataFrame, ticker: str, underlyings: Sequence[str]) -> DataFrame:
    """underlying, expiry, kind, strike of tickers like O:SPY260116C00100000; nulls where the shape differs.

    The longest underlying that fits is taken.
    """
    names = "|".join(sorted(underlyings, key=lambda u: (-len(u), u)))
    pattern = f"^O:({names})([0-9]{{6}})([CP])([0-9]{{8}})$"
    part = lambda k: F.nullif(F.regexp_extract(ticker, pattern, k), F.lit(""))
    return df.withColumns({
        "underlying": part(1),
        "expiry": F.try_to_date(F.concat(F.lit("20"), part(2)), "yyyyMMdd"),
        "kind": F.when(part(3) == "C", "call").when(part(3) == "P", "put"),
        "strike": part(4).cast("double") / 1000,
    })


def timestamp_utc(value: Column) -> Column:
    """ISO text, with Z, an offset or nothing, as a UTC timestamp; null if it is none."""
    return F.try_to_timestamp(value)


def bar_end(start: Column, start_local_day: Column, multiplier: int, timespan: str, zone: str) -> Column:
    """End of a bar: minutes or hours after its start, or 16:00 local time of its day."""
    if timespan in ("minute", "hour"):
        return start + F.expr(f"INTERVAL {int(multiplier)} {timespan}")
    return F.to_utc_timestamp(F.to_timestamp(F.concat(start_local_day.cast("string"), F.lit(" 16:00:00"))), zone)


def normalize_bars(rows: DataFrame, multiplier: int, timespan: str, zone: str = "America/New_York", opens: str = "09:30", closes: str = "16:00") -> DataFrame:
    """Rows (ticker, t in epoch ms, o, h, l, c, v) as typed bars with local day, end and regular-session flag."""
    start = F.timestamp_millis(F.col("t"))
    local = F.from_utc_timestamp(start, zone)
    end = bar_end(start, F.to_date(local), multiplier, timespan, zone)
    end_local = F.date_format(F.from_utc_timestamp(end, zone), "HH:mm")
    prices = {name: X.positive(F.col(c)) for name, c in (("open", "o"), ("high", "h"), ("low", "l"), ("close", "c"))}
    return rows.select("ticker", start.alias("start_utc"), F.to_date(local).alias("bar_date"), end.alias("end_utc"), *[c.alias(k) for k, c in prices.items()], X.finite(F.col("v")).alias("volume"), ((F.date_format(local, "HH:mm") >= opens) & (end_local <= closes)).alias("is_regular"))


def first_present(df: DataFrame, names: Sequence[str]) -> Column:
    """The first of the alias columns that the frame has and that is not null; headers drift between files."""
    have = {c.lower(): c for c in df.columns}
    found = [F.col(f"`{have[n.lower()]}`") for n in names if n.lower() in have]
    return F.coalesce(*found) if found else F.lit(None)


def percent_to_fraction(x: Column) -> Column:
    return F.when(x > 1, x / 100).otherwise(x)


def classify_vendor_error(status: Column, message: Column, rows: Column) -> Column:
    """The kind of a vendor reply, from its HTTP status, message and number of rows."""
    low = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(status.isin(401, 403), F.when(low.contains("plan"), "entitlement").otherwise("auth"))
        .when(status == 404, "not_found")
        .when(status == 429, "rate_limited")
        .when(status >= 500, "server_error")
        .when(status >= 400, "client_error")
        .when(rows == 0, "empty")
        .otherwise("ok")
    )
