"""Base views over the stored tables, as DataFrames and as SQL for the comparison runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import blocks as B
from ..operators.store import materialise

MIN_TRAIN = 250
ROLLING = 250
LEVEL = 0.95
DECAY = 0.94


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(c: str) -> Column:
    return F.to_date(F.col(c))


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """d, lv, n: total order price and count by day."""
    return table(spark, sf, "orders").groupBy(day("o_orderdate").alias("d")).agg(F.round(F.sum("o_totalprice"), 2).alias("lv"), F.count("*").alias("n"))


def gaps(spark: SparkSession, sf: str) -> DataFrame:
    """d, lv, n, gap: one row for each day; the series is as long as the calendar, whatever the data's size."""
    w = Window.orderBy("d")
    return daily(spark, sf).withColumn("gap", X.log_return(F.lag("lv").over(w), F.col("lv")))


def losses(spark: SparkSession, sf: str) -> DataFrame:
    """d, side, loss: both tails of the gap series."""
    return gaps(spark, sf).filter("gap is not null").selectExpr("d", "stack(2, 'left', -gap, 'right', gap) as (side, loss)")


def bars(spark: SparkSession, sf: str) -> DataFrame:
    """ticker, d, open, high, low, close, volume: daily bars of orders by priority."""
    o = table(spark, sf, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("ticker"), day("o_orderdate").alias("d")).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"),
        F.max("o_totalprice").alias("high"),
        F.min("o_totalprice").alias("low"),
        F.max_by("o_totalprice", "o_orderkey").alias("close"),
        F.count("*").alias("volume"),
    )


def macro(spark: SparkSession, sf: str) -> DataFrame:
    """week, level, available: a weekly series known eight days after its week begins."""
    return daily(spark, sf).groupBy(F.to_date(F.date_trunc("week", "d")).alias("week")).agg(F.min("lv").alias("level")).withColumn("available", F.date_add("week", 8))


def chain(spark: SparkSession, sf: str) -> DataFrame:
    """d, contract, strike, iv, oi, pc, dte, okey: an option chain from line items."""
    return table(spark, sf, "lineitem").select(
        day("l_shipdate").alias("d"), F.col("l_partkey").alias("contract"), F.col("l_quantity").alias("strike"), F.col("l_discount").alias("iv"),
        F.col("l_extendedprice").alias("oi"), F.when(F.col("l_returnflag") == "R", "put").when(F.col("l_returnflag") == "A", "call").alias("pc"),
        (F.col("l_linenumber") * 15).alias("dte"), F.col("l_orderkey").alias("okey"),
    )


def surface(spark: SparkSession, sf: str) -> DataFrame:
    """The chain with the day's spot."""
    li = chain(spark, sf)
    spot = li.groupBy("d").agg(F.avg("strike").alias("spot"))
    return li.join(spot, "d")


def minute_bars(spark: SparkSession, sf: str) -> DataFrame:
    """ticker, d, ts, close, id: intraday bars of events by type."""
    return table(spark, sf, "events").select(F.col("event_type").alias("ticker"), day("ts").alias("d"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("close"), F.col("event_id").alias("id"))


def forecasts(spark: SparkSession, sf: str) -> DataFrame:
    """d, side, loss, model, var, es: one-step forecasts of three models for both tails, worked out once and kept in the shared folder."""
    series = materialise(B.moments(B.positions(losses(spark, sf), ["side"], "d"), ["side"], "loss", DECAY), "moments")
    base = B.quantiles(series, ["side"], "loss", LEVEL, ROLLING).filter(F.col("pos") >= MIN_TRAIN)
    sd = F.sqrt(F.greatest(F.col("ewma"), F.lit(1e-12)))
    var3, es3 = F.col("mean") + sd * X.Z95, F.col("mean") + sd * (X.PHI95 / (1 - LEVEL))
    row = lambda model, var, es: F.struct(F.lit(model).alias("model"), var.alias("var"), es.alias("es"))
    rows = F.array(row("historical", F.col("q_all"), F.col("es_all")), row("rolling", F.col("q_recent"), F.col("es_recent")), row("ewma", var3, F.greatest(es3, var3)))
    out = base.select("d", "side", "loss", F.explode(rows).alias("r")).select("d", "side", "loss", "r.model", "r.var", "r.es")
    return materialise(out, "forecasts")


DAILY = "daily AS (SELECT CAST(o_orderdate AS DATE) AS d, round(sum(o_totalprice), 2) AS lv, count(*) AS n FROM orders GROUP BY 1)"
GAPS = DAILY + ", gaps AS (SELECT *, ln(lv) - ln(lag(lv) OVER (ORDER BY d)) AS gap FROM daily)"
LOSSES = GAPS + ", losses AS (SELECT d, 'left' AS side, -gap AS loss FROM gaps WHERE gap IS NOT NULL UNION ALL SELECT d, 'right', gap FROM gaps WHERE gap IS NOT NULL)"
BARS = """bars AS (SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS d, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
  min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*) AS volume FROM orders GROUP BY 1, 2)"""
MACRO = DAILY + ", macro AS (SELECT week, level, week + 8 AS available FROM (SELECT CAST(date_trunc('week', d) AS DATE) AS week, min(lv) AS level FROM daily GROUP BY 1))"
SURFACE = """li AS (SELECT CAST(l_shipdate AS DATE) AS d, l_partkey AS contract, l_quantity AS strike, l_discount AS iv, l_extendedprice AS oi,
  CASE l_returnflag WHEN 'R' THEN 'put' WHEN 'A' THEN 'call' END AS pc, l_linenumber * 15 AS dte, l_orderkey AS okey FROM lineitem),
surface AS (SELECT li.*, spot FROM li JOIN (SELECT d, avg(strike) AS spot FROM li GROUP BY d) USING (d))"""
MINUTES = "minutes AS (SELECT event_type AS ticker, CAST(ts AS DATE) AS d, ts, value AS close, event_id AS id FROM events)"
FORECASTS = LOSSES + f""", hist AS (
  SELECT *, count(*) OVER a AS k, quantile_cont(loss, {LEVEL}) OVER a AS v1, list(loss) OVER a AS h1, quantile_cont(loss, {LEVEL}) OVER b AS v2, list(loss) OVER b AS h2,
    avg(loss) OVER a AS mean, var_samp(loss) OVER a AS v0
  FROM losses WINDOW a AS (PARTITION BY side ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), b AS (PARTITION BY side ORDER BY d ROWS BETWEEN {ROLLING} PRECEDING AND 1 PRECEDING)),
state AS (SELECT *, sqrt(greatest(list_reduce(list_prepend(v0, list_transform(h1, lambda x: (x - mean) * (x - mean))), lambda v, e: {DECAY} * v + {1 - DECAY} * e), 1e-12)) AS sd FROM hist WHERE k >= {MIN_TRAIN}),
forecasts AS (
  SELECT d, side, loss, 'historical' AS model, v1 AS var, greatest(v1, coalesce(list_avg(list_filter(h1, lambda x: x > v1)), v1)) AS es FROM state
  UNION ALL SELECT d, side, loss, 'rolling', v2, greatest(v2, coalesce(list_avg(list_filter(h2, lambda x: x > v2)), v2)) FROM state
  UNION ALL SELECT d, side, loss, 'ewma', mean + sd * {X.Z95}, mean + sd * {X.PHI95 / (1 - LEVEL)} FROM state)"""
SCORED = FORECASTS + f""", scored AS (
  SELECT *, (CASE WHEN loss > var THEN 1.0 ELSE 0.0 END - {1 - LEVEL}) * (loss - var) AS q_loss, loss > var AS hit,
    CASE WHEN es > 0 AND es >= var THEN (CASE WHEN -loss <= -var THEN (var - loss) / ({1 - LEVEL} * -es) ELSE 0.0 END) + var / es + ln(es) - 1 END AS fz_loss
  FROM forecasts)"""
