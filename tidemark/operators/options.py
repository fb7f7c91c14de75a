"""Daily summaries of an option surface."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .select import order_statistics


def weighted_mean(value: Column, weight: Column) -> Column:
    """Over positive weights and non-null values."""
    ok = value.isNotNull() & (weight > 0)
    return F.sum(F.when(ok, value * weight)) / F.sum(F.when(ok, weight))


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of largest `order` for each key; rows with a null in the key are all kept."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    ranked = df.filter(whole).withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")
    return ranked.unionByName(df.filter(~whole))


def at_the_money(chain: DataFrame, day: str, strike: str, spot: str) -> DataFrame:
    """Rows at the least distance of strike and spot of their day, ties included."""
    w = Window.partitionBy(day)
    return chain.withColumn("__gap", F.abs(F.col(strike) - F.col(spot))).withColumn("__least", F.min("__gap").over(w)).filter("__gap = __least").drop("__gap", "__least")


def nearest(chain: DataFrame, keys: list[str], strike: str, spot: str, dte: str, tie: list[str]) -> DataFrame:
    """The row of each key with the least absolute log-moneyness, then the shortest expiry."""
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.round(F.abs(F.log(F.col(strike) / F.col(spot))), 9), dte, *tie))
    return chain.filter((F.col(strike) > 0) & (F.col(spot) > 0)).withColumn("__k", best).filter("__k = 1").drop("__k")


def dte_bucket(dte: Column) -> Column:
    return F.when(dte.between(7, 30), "short").when(dte.between(31, 90), "medium").otherwise("long")


def moneyness_band(strike: Column, spot: Column) -> Column:
    m = strike / spot
    return F.when(m < 0.9, "otm_put").when(m > 1.1, "otm_call").otherwise("near")


def daily_summary(chain: DataFrame) -> DataFrame:
    """Of columns d, contract, strike, iv, oi, pc, dte, spot: at-the-money and bucket IVs, ratios and weighted means by day.

    One pass over the chain; the at-the-money distance of the day is the only window.
    """
    w = Window.partitionBy("d")
    marked = chain.withColumn("gap", F.abs(F.col("strike") - F.col("spot"))).withColumn("atm", F.col("gap") == F.min("gap").over(w))
    bucket, band = dte_bucket(F.col("dte")), moneyness_band(F.col("strike"), F.col("spot"))
    med = lambda keep: F.percentile(F.when(keep, F.col("iv")), F.lit(0.5))
    puts, calls = F.count_if(F.col("pc") == "put"), F.count_if(F.col("pc") == "call")
    return marked.groupBy("d").agg(
        F.count("*").alias("rows"),
        F.avg(F.when(F.col("atm"), F.col("iv"))).alias("atm_iv"),
        F.count_if("atm").alias("atm_rows"),
        med(bucket == "short").alias("iv_short"),
        med(bucket == "medium").alias("iv_medium"),
        med(band == "otm_put").alias("iv_otm_put"),
        F.when(calls > 0, puts / calls).alias("put_call_ratio"),
        weighted_mean(F.col("iv"), F.col("oi")).alias("iv_weighted"),
    )


def cross_section(chain: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median, 20 % trimmed mean, maximum, count and population spread of the values of each key; a key without values has n = 0."""
    ranked = order_statistics(chain, keys, value, {"median": 0.5}, {"trimmed": 0.2}).drop("n").withColumnsRenamed({k: f"__{k}" for k in keys})
    n = F.count(value)
    plain = chain.groupBy(*keys).agg(F.max(value).alias("max"), n.alias("n"), F.when(n >= 2, F.stddev_pop(value)).alias("dispersion"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return plain.join(ranked, same, "left").drop(*[f"__{k}" for k in keys])
