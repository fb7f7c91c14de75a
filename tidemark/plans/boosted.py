"""Boosted forecasts on the panel's features, by information set, and boosting over the rows of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import boosting
from ..operators import evaluate as E
from ..operators import origins as O
from ..operators import rolling as R
from . import views as V
from .panel import S, r, text

#: Each set holds the one before.
BLOCKS = {
    "A": ["lag_1", "lag_2", "lag_5", "mean_20", "sd_20", "sd_60", "max_abs_10"],
    "B": ["bar_return", "bar_range", "bar_volume"],
    "C": ["macro_level", "macro_diff"],
    "D": ["option_iv", "option_oi", "event_count"],
}
SETS = {name: sum(list(BLOCKS.values())[: k + 1], []) for k, name in enumerate(BLOCKS)}


def matrix(spark: SparkSession, sf: str) -> DataFrame:
    """d, gap and a column for each feature, null where it is not known before the day: a day's own bars, options and events enter on the
    next day of the series, macro values on the day on which they become known."""
    w = R.series([], "d")
    before = lambda c: F.lag(c).over(w)
    bars = V.bars(spark, sf).groupBy("d").agg(F.avg(F.log(S("close") / S("open"))).alias("ret"), F.avg(X.parkinson(S("high"), S("low"))).alias("rng"), F.sum("volume").alias("vol"))
    options = V.table(spark, sf, "lineitem").groupBy(V.day("l_shipdate").alias("d")).agg(F.avg("l_discount").alias("iv"), F.sum("l_extendedprice").alias("oi"))
    events = V.table(spark, sf, "events").groupBy(V.day("ts").alias("d")).agg(F.count("*").alias("events"))
    macro = V.macro(spark, sf).withColumn("diff", S("level") - F.lag("level").over(R.series([], "week")))
    known = macro.groupBy(S("available").alias("d")).agg(F.max_by("level", "week").alias("level"), F.max_by("diff", "week").alias("diff"))
    days = V.gaps(spark, sf).select("d", "gap")
    for part in (bars, options, events):
        days = days.join(part, "d", "left")
    # a release between two days of the series is there on the later one
    line = days.withColumn("own", F.lit(True)).join(known, "d", "full_outer")
    upto = w.rowsBetween(R.Window.unboundedPreceding, 0)
    line = line.withColumns({"level": F.last("level", ignorenulls=True).over(upto), "diff": F.last("diff", ignorenulls=True).over(upto)}).filter("own")
    p10, p20, p60 = (R.prior(w, k) for k in (10, 20, 60))
    full = lambda c, frame, n: F.when(F.count("gap").over(frame) == n, c)
    return line.select(
        "d", "gap", *[F.lag("gap", k).over(w).alias(f"lag_{k}") for k in (1, 2, 5)],
        full(F.avg("gap").over(p20), p20, 20).alias("mean_20"), full(F.stddev_samp("gap").over(p20), p20, 20).alias("sd_20"), full(F.stddev_samp("gap").over(p60), p60, 60).alias("sd_60"),
        full(F.max(F.abs("gap")).over(p10), p10, 10).alias("max_abs_10"), before("ret").alias("bar_return"), before("rng").alias("bar_range"), F.log(before("vol")).alias("bar_volume"),
        S("level").alias("macro_level"), S("diff").alias("macro_diff"), before("iv").alias("option_iv"), before("oi").alias("option_oi"), before("events").cast("double").alias("event_count"),
    )


def feature_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return matrix(spark, sf).select(text("d").alias("d"), *[r(c, 8).alias(c) for c in SETS["D"]])


def series(spark: SparkSession, sf: str) -> DataFrame:
    m = matrix(spark, sf).filter("gap is not null")
    return m.select("d", *SETS["D"], F.explode(F.array(F.struct(F.lit("left").alias("side"), (-S("gap")).alias("loss")), F.struct(F.lit("right").alias("side"), S("gap").alias("loss")))).alias("s")).select("d", "s.*", *SETS["D"])


def _out(df: DataFrame) -> DataFrame:
    return df.select(text("d").alias("d"), "side", "infoset", "model", "refit", "loss", "var", "es", "status")


def gbm_quantile_tail(spark: SparkSession, sf: str) -> DataFrame:
    """Direct quantile boosting on the widest set, 160 trees of 20 leaves at rate 0.025, refitted each month on all days before."""
    return _out(O.boosted(series(spark, sf), ["side"], "d", "loss", {"D": SETS["D"]}, level=V.LEVEL))


def gbm_location_scale(spark: SparkSession, sf: str) -> DataFrame:
    """Boosted mean and log absolute residual, refitted each month, on the widest set."""
    return _out(O.boosted(series(spark, sf), ["side"], "d", "loss", {"D": SETS["D"]}, "location_scale", V.LEVEL))


def gbm_robust(spark: SparkSession, sf: str) -> DataFrame:
    """Boosted quartiles; scales by the median absolute residual and by the quartiles' distance."""
    return _out(O.boosted(series(spark, sf), ["side"], "d", "loss", {"D": SETS["D"]}, "robust", V.LEVEL))


def gbm_information_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Coverage and losses of direct quantile boosting by information set, on the days that all sets have; a set's gain is the fall
    of the mean quantile loss against the set before it."""
    from ..operators.store import materialise

    f = O.boosted(series(spark, sf), ["side"], "d", "loss", SETS, level=V.LEVEL).filter("var is not null")
    s = E.on_common_days(materialise(E.scored(f, V.LEVEL), "sets"), ["side"], "infoset", "d", "q_loss")
    m = E.metrics(s, ["side", "infoset"], "d", V.LEVEL)
    before = F.lag("mean_q").over(R.Window.partitionBy("side").orderBy("infoset"))
    return m.select("side", "infoset", "rows", "hits", r("breach_rate", 5).alias("breach_rate"), r("mean_q").alias("mean_q"), r("mean_fz", 5).alias("mean_fz"), r(before - S("mean_q")).alias("gain"))


def gbm_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Boosting over rows that stay where they are: a tail quantile of the price of line items, and how often each month exceeds it."""
    li = V.table(spark, sf, "lineitem").select("l_orderkey", S("l_extendedprice").alias("price"), S("l_quantity").alias("quantity"), S("l_discount").alias("discount"), S("l_tax").alias("tax"), S("l_linenumber").cast("double").alias("line"), F.month("l_shipdate").cast("double").alias("month"))
    features = ["quantity", "discount", "tax", "line", "month"]
    model = boosting.fit_rows(li, features, "price", V.LEVEL, trees=6, rate=0.3)
    out = boosting.predict_rows(li, features, model)
    return out.groupBy(S("month").cast("int").alias("month")).agg(F.count("*").alias("rows"), F.count_if(S("price") > S("predicted")).alias("above"), r(F.avg("predicted"), 3).alias("mean_forecast"))


Q = {f.__name__: f for f in (feature_matrix, gbm_quantile_tail, gbm_location_scale, gbm_robust, gbm_information_sets, gbm_rows)}

SQL = {
    "feature_matrix": f"""WITH {V.GAPS}, {V.BARS}{V.MACRO.removeprefix(V.DAILY)},
      b AS (SELECT d, avg(ln(close / open)) AS ret, avg(pow(ln(high) - ln(low), 2) / (4 * ln(2))) AS rng, sum(volume) AS vol FROM bars GROUP BY d),
      o AS (SELECT CAST(l_shipdate AS DATE) AS d, avg(l_discount) AS iv, sum(l_extendedprice) AS oi FROM lineitem GROUP BY 1),
      e AS (SELECT CAST(ts AS DATE) AS d, count(*) AS events FROM events GROUP BY 1),
      m AS (SELECT available AS d, level, level - lag(level) OVER (ORDER BY week) AS diff FROM macro),
      x AS (SELECT gaps.d, gap, ret, rng, vol, iv, oi, events FROM gaps LEFT JOIN b USING (d) LEFT JOIN o USING (d) LEFT JOIN e USING (d)),
      y AS (SELECT x.*, m.level, m.diff FROM x ASOF LEFT JOIN m ON x.d >= m.d)
      SELECT CAST(d AS VARCHAR) AS d, round(lag(gap, 1) OVER w, 8) AS lag_1, round(lag(gap, 2) OVER w, 8) AS lag_2, round(lag(gap, 5) OVER w, 8) AS lag_5,
        CASE WHEN count(gap) OVER p20 = 20 THEN round(avg(gap) OVER p20, 8) END AS mean_20, CASE WHEN count(gap) OVER p20 = 20 THEN round(stddev_samp(gap) OVER p20, 8) END AS sd_20,
        CASE WHEN count(gap) OVER p60 = 60 THEN round(stddev_samp(gap) OVER p60, 8) END AS sd_60, CASE WHEN count(gap) OVER p10 = 10 THEN round(max(abs(gap)) OVER p10, 8) END AS max_abs_10,
        round(lag(ret) OVER w, 8) AS bar_return, round(lag(rng) OVER w, 8) AS bar_range, round(ln(lag(vol) OVER w), 8) AS bar_volume, round(level, 8) AS macro_level, round(diff, 8) AS macro_diff,
        round(lag(iv) OVER w, 8) AS option_iv, round(lag(oi) OVER w, 8) AS option_oi, round(CAST(lag(events) OVER w AS DOUBLE), 8) AS event_count
      FROM y WINDOW w AS (ORDER BY d), p10 AS (ORDER BY d ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), p20 AS (ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), p60 AS (ORDER BY d ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)""",
}
