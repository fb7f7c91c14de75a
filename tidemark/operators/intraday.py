"""Features of the last minutes of a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X


def late_session(bars: DataFrame, minutes: int, least_returns: int = 2) -> DataFrame:
    """Per ticker and day, over bars (ticker, d, ts, id, close) within `minutes` of the day's last one, inclusive:
    first-to-last return, realised variance, semivariances as sums, range and count."""
    day = Window.partitionBy("ticker", "d")
    order = day.orderBy("ts", "id")
    late = bars.withColumn("close_ts", F.max("ts").over(day)).filter(F.col("ts") >= F.col("close_ts") - F.expr(f"INTERVAL {int(minutes)} MINUTES"))
    ret = X.log_return(F.lag("close").over(order), F.col("close"))
    r = late.withColumn("ret", ret)
    n = F.count("ret")
    square = lambda keep: F.coalesce(F.sum(F.when(keep, F.col("ret") * F.col("ret"))), F.lit(0.0))
    pos = X.positive(F.col("close"))
    key = F.struct("ts", "id")
    return r.groupBy("ticker", "d").agg(
        F.count("*").alias("bars"),
        X.log_return(F.min_by("close", key), F.max_by("close", key)).alias("ret"),
        F.when(n >= least_returns, F.sum(F.col("ret") * F.col("ret"))).alias("rv"),
        F.when(n >= least_returns, square(F.col("ret") < 0)).alias("semi_down"),
        F.when(n >= least_returns, square(F.col("ret") > 0)).alias("semi_up"),
        (F.log(F.max(pos)) - F.log(F.min(pos))).alias("log_range"),
    )


def closing_windows(bars: DataFrame, windows: dict[str, int], whole: str, least_returns: int = 3) -> DataFrame:
    """Per ticker and day one row: the return of each window (minutes before the day's last bar, inclusive) and, for the window `whole`, bars,
    realised variance, semivariances, skewness and excess kurtosis of its bar-to-bar returns, log range and share of the day's volume.

    All windows come from one sort of the day's bars; a moment needs `least_returns` returns, a return two bars.
    """
    day = Window.partitionBy("ticker", "d")
    order = day.orderBy("ts", "id")
    longest = max(windows.values())
    b = bars.withColumns({"__last": F.max("ts").over(day), "__ret": X.log_return(F.lag("close").over(order), F.col("close")), "__before": F.lag("ts").over(order), "__day_volume": F.sum("volume").over(day)})
    since = lambda t, m: F.col(t) >= F.col("__last") - F.expr(f"INTERVAL {int(m)} MINUTES")
    b = b.filter(since("ts", longest))
    key = F.struct("ts", "id")
    inside = since("ts", windows[whole])
    x = F.when(inside & since("__before", windows[whole]), F.col("__ret"))
    n = F.count(x)
    first = lambda w: F.min_by(F.when(w, F.col("close")), F.when(w, key))
    returns = {name: (F.count_if(since("ts", m)), X.log_return(first(since("ts", m)), F.max_by("close", key))) for name, m in windows.items()}
    enough = lambda c: F.when(n >= least_returns, c)
    square = lambda keep: F.coalesce(F.sum(F.when(keep, x * x)), F.lit(0.0))
    price = F.when(inside, X.positive(F.col("close")))
    return b.groupBy("ticker", "d").agg(
        F.count_if(inside).alias("bars"), *[F.when(k >= 2, c).alias(f"return_{name}") for name, (k, c) in returns.items()],
        enough(F.sum(x * x)).alias("rv"), enough(square(x < 0)).alias("semi_down"), enough(square(x > 0)).alias("semi_up"),
        enough(X.sample_skew(x, n)).alias("skew"), enough(X.sample_excess_kurtosis(x, n)).alias("kurtosis"),
        (F.log(F.max(price)) - F.log(F.min(price))).alias("log_range"), (F.sum(F.when(inside, F.col("volume"))) / F.max("__day_volume")).alias("volume_share"),
    )
