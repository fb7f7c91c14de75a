"""Queries over rolling history, options, intraday and event features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import blocks as B
from ..operators import intraday, options
from ..operators import rolling as R
from ..operators.asof import asof_join, interval_join
from ..operators.store import materialise
from . import views as V
from .panel import S, r, text


def rolling_history_stats(spark: SparkSession, sf: str) -> DataFrame:
    w = R.series([], "d")
    p20, all_ = R.prior(w, 20), R.prior(w)
    x = S("gap")
    out = V.gaps(spark, sf).select(text("d").alias("d"), r(F.lag("gap", 1).over(w)).alias("lag_1"), r(F.lag("gap", 5).over(w)).alias("lag_5"), r(F.avg(x).over(p20)).alias("mean_20"), r(F.stddev_samp(x).over(p20)).alias("sd_20"), r(F.percentile(x, F.lit(0.95)).over(p20)).alias("q95_20"), (r(F.avg(x).over(all_)) + 0.0).alias("mean_all"), r(F.when(F.count(x).over(p20) >= 20, F.max(x).over(p20))).alias("max_20"))
    return out


def session_interleaved_moments(spark: SparkSession, sf: str) -> DataFrame:
    """Two values a day, open-to-high then close-to-low, in one series without nulls."""
    b = V.bars(spark, sf).filter("volume > 1").select("ticker", "d", F.posexplode(F.array(X.log_return(S("open"), S("high")), X.log_return(S("close"), S("low")))).alias("slot", "x")).filter("x is not null")
    p = B.positions(b.withColumn("at", F.unix_date("d") * 2 + S("slot")), ["ticker"], "at")
    x = S("x")
    p = B.sliding_sums(p, ["ticker"], {"s": x, "dn": F.when(x < 0, x * x), "up": F.when(x > 0, x * x), "n_dn": F.when(x < 0, 1.0), "n_up": F.when(x > 0, 1.0)}, 20)
    m = B.sliding_moments(materialise(p, "sums"), ["ticker"], "x", 120)
    full, long = S("pos") >= 19, S("pos") >= 119
    share = lambda a, n: F.when(full, F.coalesce(S(a) / F.when(S(n) > 0.5, S(n)), F.lit(0.0)))
    return m.select("ticker", text("d").alias("d"), S("slot").cast("long").alias("slot"), r("x").alias("x"), r(F.when(full, S("s") / 20)).alias("mean_20"), r(share("dn", "n_dn")).alias("semi_down_20"),
                    r(share("up", "n_up")).alias("semi_up_20"), r(F.when(long, S("skew")), 5).alias("skew_120"), r(F.when(long, S("kurt")), 5).alias("kurt_120"))


def parkinson_rolling(spark: SparkSession, sf: str) -> DataFrame:
    w = R.series(["ticker"], "d")
    b = V.bars(spark, sf).withColumn("pk", X.parkinson(S("high"), S("low")))
    return b.select("ticker", text("d").alias("d"), r("pk").alias("pk"), *[r(R.with_minimum(S("pk"), F.avg("pk").over(R.latest(w, n)), R.latest(w, n), min(n, 20))).alias(f"pk_{n}") for n in (5, 20, 60)])


def volume_zscores(spark: SparkSession, sf: str) -> DataFrame:
    w = R.series(["ticker"], "d")
    f = R.latest(w, 60)
    b = V.bars(spark, sf).withColumn("lnv", F.log(S("volume")))
    return b.select("ticker", text("d").alias("d"), r(S("lnv") - F.lag("lnv").over(w)).alias("dlog"), r(F.when(F.count("lnv").over(f) >= 20, R.z_score(S("lnv"), f))).alias("z_60"))


def volume_surge(spark: SparkSession, sf: str) -> DataFrame:
    w = R.series(["ticker"], "d")
    p = R.prior(w, 20)
    b = V.bars(spark, sf).withColumn("past", F.collect_list("volume").over(p))
    mean, sd = F.avg("volume").over(p), F.stddev_samp("volume").over(p)
    return b.select("ticker", text("d").alias("d"), r(S("volume") / mean).alias("ratio"), r((S("volume") - mean) / F.when(sd > 0, sd)).alias("z"), r(F.when(F.size("past") > 0, R.percent_rank_of(S("volume"), S("past")))).alias("pct"))


def tail_hit_counts(spark: SparkSession, sf: str) -> DataFrame:
    w = R.series(["side"], "d")
    f252, f20, f60 = R.latest(w, 252), R.latest(w, 20), R.latest(w, 60)
    b = V.losses(spark, sf).withColumn("thr", F.when(F.count("loss").over(f252) == 252, F.percentile("loss", F.lit(0.95)).over(f252)))
    b = b.withColumns({"h20": F.collect_list("loss").over(f20), "h60": F.collect_list("loss").over(f60)})
    hits = lambda c: F.when(S("thr").isNotNull(), F.size(F.filter(c, lambda x: x > S("thr")))).cast("double")
    return b.select("side", text("d").alias("d"), r("thr").alias("threshold"), hits("h20").alias("hits_20"), hits("h60").alias("hits_60"))


def contract_calendar_features(spark: SparkSession, sf: str) -> DataFrame:
    d = V.daily(spark, sf).select("d", X.second_friday(S("d")).alias("sq"))
    angle = F.month("d") * F.lit(2 * 3.141592653589793 / 12)
    return d.select(text("d").alias("d"), F.date_diff("sq", "d").cast("long").alias("days_to_sq"), (r(F.sin(angle)) + 0.0).alias("month_sin"), (r(F.cos(angle)) + 0.0).alias("month_cos"))


def option_surface_daily(spark: SparkSession, sf: str) -> DataFrame:
    out = options.daily_summary(V.surface(spark, sf))
    return out.select(text("d").alias("d"), S("rows").cast("long").alias("rows"), r("atm_iv", 5).alias("atm_iv"), S("atm_rows").cast("long").alias("atm_rows"), r("iv_short", 4).alias("iv_short"), r("iv_medium", 4).alias("iv_medium"), r("iv_otm_put", 4).alias("iv_otm_put"), r("put_call_ratio").alias("put_call_ratio"), r("iv_weighted").alias("iv_weighted"))


def option_state_rolling(spark: SparkSession, sf: str) -> DataFrame:
    s = V.surface(spark, sf).groupBy("d").agg(F.avg("iv").alias("x"))
    w = R.series([], "d")
    p20, p60 = R.prior(w, 20), R.prior(w, 60)
    s = s.withColumns({"past": F.collect_list(F.round("x", 9)).over(p60), "n": F.count("x").over(p20)})
    ok = S("n") >= 20
    return s.select(text("d").alias("d"), r(F.when(ok, S("x") - F.avg("x").over(p20))).alias("vs_mean"), r(F.when(ok, R.z_score(S("x"), p20)), 4).alias("z"), r(F.when(F.size("past") >= 20, R.percent_rank_of(F.round("x", 9), S("past")))).alias("pct_60"))


def option_state_asof(spark: SparkSession, sf: str) -> DataFrame:
    s = V.surface(spark, sf).groupBy("d").agg(F.avg("iv").alias("iv")).filter("dayofyear(d) % 4 <> 0").withColumn("source", S("d"))
    out = asof_join(V.daily(spark, sf).select("d"), s, "d", "d", columns=["iv", "source"], strict=True, tolerance_days=7)
    return out.select(text("d").alias("d"), r("iv", 8).alias("iv"), text("source").alias("source"))


def nearest_atm_contract(spark: SparkSession, sf: str) -> DataFrame:
    out = options.nearest(V.surface(spark, sf).filter("pc is not null"), ["d", "pc"], "strike", "spot", "dte", ["contract", "okey"])
    return out.select(text("d").alias("d"), "pc", "contract", "strike", S("dte").cast("long").alias("dte"))


def iv_cross_section(spark: SparkSession, sf: str) -> DataFrame:
    s = V.chain(spark, sf).withColumn("bucket", options.dte_bucket(S("dte")))
    out = options.cross_section(s, ["d", "bucket"], "iv")
    return out.select(text("d").alias("d"), "bucket", r("median", 4).alias("median"), r("trimmed", 9).alias("trimmed"), "max", "n", r("dispersion", 5).alias("dispersion"))


def option_liquidity(spark: SparkSession, sf: str) -> DataFrame:
    s = V.chain(spark, sf).withColumn("bucket", options.dte_bucket(S("dte")))
    per_day = s.groupBy("d", "bucket").agg(F.countDistinct("contract").alias("contracts"), F.count("*").alias("quotes"))
    return per_day.groupBy("bucket").agg(F.max("contracts").alias("max_contracts"), F.sum("quotes").alias("quotes"), F.count("*").alias("days"))


def intraday_late_session(spark: SparkSession, sf: str) -> DataFrame:
    m = V.minute_bars(spark, sf)
    out = None
    for minutes in (60, 240):
        part = intraday.late_session(m, minutes).withColumn("minutes", F.lit(minutes).cast("long"))
        out = part if out is None else out.unionByName(part)
    return out.select("ticker", text("d").alias("d"), "minutes", "bars", *[r(c, 5).alias(c) for c in ("ret", "rv", "semi_down", "semi_up", "log_range")])


def cross_market_features(spark: SparkSession, sf: str) -> DataFrame:
    w = R.series(["ticker"], "d")
    b = V.bars(spark, sf).withColumn("ret", X.log_return(F.lag("close").over(w), S("close")))
    g = b.groupBy("d").agg(F.count("ret").alias("n"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("sd"), F.max(F.when(S("ticker").startswith("1"), S("ret"))).alias("a"), F.max(F.when(S("ticker").startswith("5"), S("ret"))).alias("b"))
    one = R.prior(R.series([], "d"), 20)
    g = g.withColumns({"mean": F.when(S("n") >= 3, S("m")), "spread": F.when(S("n") >= 3, S("sd"))})
    return g.select(text("d").alias("d"), r("mean").alias("mean"), r("spread").alias("spread"), r(S("a") - S("b")).alias("urgent_vs_low"), r(S("mean") - F.avg("mean").over(one)).alias("shock_20"))


def event_intensity(spark: SparkSession, sf: str) -> DataFrame:
    """Events are days with more shipments than 19 of 20 days; counts and distances within 30 days of each day."""
    n = V.table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("e")).agg(F.count("*").alias("n"))
    busy = n.crossJoin(n.agg(F.percentile("n", F.lit(0.95)).alias("cut"))).filter("n > cut").select("e")
    days = V.daily(spark, sf).select("d", F.date_sub("d", 30).alias("low"), F.date_add("d", 30).alias("high"))
    gap = F.date_diff("e", "d")
    out = interval_join(busy, days, "e", "low", "high", how="left").groupBy("d").agg(F.count_if(gap == 0).alias("same_day"), F.count_if(gap.between(1, 3)).alias("next_3"), F.min(F.when(gap > 0, gap)).alias("to_next"), F.min(F.when(gap < 0, -gap)).alias("since_last"))
    return out.select(text("d").alias("d"), "same_day", "next_3", F.coalesce("to_next", F.lit(30)).cast("long").alias("to_next"), F.coalesce("since_last", F.lit(30)).cast("long").alias("since_last"))


def oos_start_search(spark: SparkSession, sf: str) -> DataFrame:
    """The first day with enough rows and exceedances before it, and how many such days there are."""
    b = B.quantiles(B.positions(V.losses(spark, sf), ["side"], "d"), ["side"], "loss", V.LEVEL, V.ROLLING)
    ok = b.filter((S("pos") >= V.MIN_TRAIN) & (S("above_all") >= 20))
    return ok.groupBy("side").agg(F.min("d").cast("string").alias("start"), F.count("*").alias("days"))


def refit_calendar(spark: SparkSession, sf: str) -> DataFrame:
    return V.daily(spark, sf).groupBy(F.trunc("d", "MM").alias("m")).agg(F.min("d").alias("d"), F.count("*").alias("n")).select(text("m").alias("month"), text("d").alias("refit"), "n")


def block_maxima_scaling(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for b in (5, 10, 20, 40):
        w = R.series(["side"], "d")
        ahead = w.rowsBetween(0, b - 1)
        part = V.losses(spark, sf).select("side", F.count("loss").over(ahead).alias("n"), F.max("loss").over(ahead).alias("m")).filter(S("n") == b)
        part = part.groupBy("side").agg(F.percentile("m", F.lit(0.5)).alias("median"), F.count("*").alias("blocks")).withColumn("size", F.lit(b).cast("long"))
        out = part if out is None else out.unionByName(part)
    return out.select("side", "size", "blocks", r("median").alias("median"))


def stress_episodes(spark: SparkSession, sf: str) -> DataFrame:
    q = V.losses(spark, sf).groupBy("side").agg(F.percentile("loss", F.lit(0.9)).alias("q"))
    b = V.losses(spark, sf).join(F.broadcast(q), "side").filter("loss > q")
    return R.islands(b, ["side"], "d", 5).groupBy("side", "cluster").agg(F.min("d").cast("string").alias("first"), F.max("d").cast("string").alias("last"), F.count("*").alias("days"), r(F.max("loss")).alias("worst")).drop("cluster")


def spaced_extremes(spark: SparkSession, sf: str) -> DataFrame:
    q = V.losses(spark, sf).groupBy("side").agg(F.percentile("loss", F.lit(0.95)).alias("q"))
    tops = V.losses(spark, sf).join(F.broadcast(q), "side").filter("loss > q").drop("q")
    return R.spaced_top(tops, ["side"], "d", "loss", 10, 30).select("side", S("rank").cast("long").alias("rank"), text("d").alias("d"), r("loss").alias("loss"))


def hill_mean_excess_survival(spark: SparkSession, sf: str) -> DataFrame:
    pos = V.losses(spark, sf).filter("loss > 0")
    down = Window.partitionBy("side").orderBy(F.desc("loss"))
    c = pos.select("side", "loss", F.row_number().over(down).alias("k"), F.avg(F.log("loss")).over(down.rowsBetween(Window.unboundedPreceding, -1)).alias("above"), F.avg("loss").over(down.rowsBetween(Window.unboundedPreceding, -1)).alias("mean_above"), (1 - F.cume_dist().over(Window.partitionBy("side").orderBy("loss"))).alias("survival"))
    return c.filter("k >= 9").select("side", S("k").cast("long").alias("k"), r(S("above") - F.log("loss")).alias("hill"), r(S("mean_above") - S("loss")).alias("mean_excess"), r("survival").alias("survival"))


def target_summary_jb(spark: SparkSession, sf: str) -> DataFrame:
    x, n = S("loss"), F.count("loss")
    b = V.losses(spark, sf).groupBy("side").agg(n.alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), X.sample_skew(x, n).alias("skew"), X.sample_excess_kurtosis(x, n).alias("kurt"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.max_by(text("d"), "loss").alias("worst_day"), *[F.percentile(x, F.lit(p)).alias(f"q{int(100 * p):02d}") for p in (0.01, 0.05, 0.5, 0.95, 0.99)])
    jb = S("n") / 6 * (S("skew") * S("skew") + S("kurt") * S("kurt") / 4)
    return b.select("side", "n", *[r(c).alias(c) for c in ("mean", "sd", "lo", "hi", "q01", "q05", "q50", "q95", "q99")], r("skew", 4).alias("skew"), r("kurt", 4).alias("kurt"), "worst_day", r(jb, 2).alias("jarque_bera"))


def extremal_index_fs(spark: SparkSession, sf: str) -> DataFrame:
    """Ferro-Segers from the gaps between exceedances of the 95 % quantile."""
    b = V.losses(spark, sf).withColumn("i", F.row_number().over(R.series(["side"], "d")))
    q = b.groupBy("side").agg(F.percentile("loss", F.lit(0.95)).alias("q"))
    t = b.join(F.broadcast(q), "side").filter("loss > q").withColumn("t", S("i") - F.lag("i").over(Window.partitionBy("side").orderBy("i"))).filter("t is not null")
    g = t.groupBy("side").agg(F.count("*").alias("n"), F.max("t").alias("mx"), F.sum("t").alias("s1"), F.sum(S("t") * S("t")).alias("s2"), F.sum(S("t") - 1).alias("u1"), F.sum((S("t") - 1) * (S("t") - 2)).alias("u2"))
    theta = F.when(S("mx") <= 2, 2 * S("s1") * S("s1") / (S("n") * S("s2"))).otherwise(2 * S("u1") * S("u1") / (S("n") * S("u2")))
    return g.select("side", (S("n") + 1).alias("exceedances"), r(F.least(F.lit(1.0), theta)).alias("theta"))


def extremal_index_kgaps(spark: SparkSession, sf: str) -> DataFrame:
    """K-gaps likelihood on a grid of theta (K = 2)."""
    b = V.losses(spark, sf).withColumns({"i": F.row_number().over(R.series(["side"], "d")), "n": F.count("*").over(Window.partitionBy("side"))})
    q = b.groupBy("side").agg(F.percentile("loss", F.lit(0.95)).alias("q"))
    x = b.join(F.broadcast(q), "side").filter("loss > q").withColumn("t", S("i") - F.lag("i").over(Window.partitionBy("side").orderBy("i")))
    s = x.groupBy("side").agg(F.count("*").alias("k"), F.max("n").alias("n"), F.count_if(S("t") <= 2).alias("zero"), F.count_if(S("t") > 2).alias("some"), F.sum(F.when(S("t").isNotNull(), F.greatest(S("t") - 2, F.lit(0)))).alias("gap"))
    grid = s.select("*", F.explode(F.sequence(F.lit(1), F.lit(99))).alias("g")).withColumn("theta", S("g") / 100)
    ll = S("zero") * F.log(1 - S("theta")) + 2 * S("some") * F.log("theta") - S("theta") * S("k") / S("n") * S("gap")
    return grid.withColumn("ll", ll).groupBy("side").agg(F.max_by("theta", "ll").alias("theta"), r(F.max("ll"), 4).alias("log_likelihood"))


Q = {f.__name__: f for f in (
    rolling_history_stats, session_interleaved_moments, parkinson_rolling, volume_zscores, volume_surge, tail_hit_counts, contract_calendar_features,
    option_surface_daily, option_state_rolling, option_state_asof, nearest_atm_contract, iv_cross_section, option_liquidity, intraday_late_session,
    cross_market_features, event_intensity, oos_start_search, refit_calendar, block_maxima_scaling, stress_episodes, spaced_extremes,
    hill_mean_excess_survival, target_summary_jb, extremal_index_fs, extremal_index_kgaps,
)}

D = "CAST(d AS VARCHAR) AS d"
BUCKET = "CASE WHEN dte BETWEEN 7 AND 30 THEN 'short' WHEN dte BETWEEN 31 AND 90 THEN 'medium' ELSE 'long' END"
SKEW = "avg(pow((x - {m}) / {s}, 3))"
EXCESS = f"""{V.LOSSES}, q AS (SELECT side, quantile_cont(loss, 0.95) AS q FROM losses GROUP BY 1),
i AS (SELECT side, loss, row_number() OVER (PARTITION BY side ORDER BY d) AS i, count(*) OVER (PARTITION BY side) AS n FROM losses),
t AS (SELECT side, n, i - lag(i) OVER (PARTITION BY side ORDER BY i) AS t FROM i JOIN q USING (side) WHERE loss > q)"""
SQL = {
    "spaced_extremes": f"""WITH {V.LOSSES}, q AS (SELECT side, quantile_cont(loss, 0.95) AS q FROM losses GROUP BY 1),
      t AS (SELECT side, list([{{'v': loss, 'd': d}}] ORDER BY loss DESC, d) AS h FROM losses JOIN q USING (side) WHERE loss > q GROUP BY 1),
      p AS (SELECT side, list_reduce(h, lambda a, x: CASE WHEN len(a) < 10 AND len(list_filter(a, lambda y: abs(date_diff('day', y.d, x[1].d)) < 30)) = 0 THEN list_concat(a, x) ELSE a END) AS p FROM t),
      u AS (SELECT side, unnest(p) AS e, generate_subscripts(p, 1) AS rank FROM p)
      SELECT side, rank, CAST(e.d AS VARCHAR) AS d, round(e.v, 6) AS loss FROM u""",
    "rolling_history_stats": f"""WITH {V.GAPS} SELECT {D}, round(lag(gap, 1) OVER w, 6) AS lag_1, round(lag(gap, 5) OVER w, 6) AS lag_5, round(avg(gap) OVER p, 6) AS mean_20, round(stddev_samp(gap) OVER p, 6) AS sd_20,
      round(quantile_cont(gap, 0.95) OVER p, 6) AS q95_20, round(avg(gap) OVER a, 6) + 0 AS mean_all, round(CASE WHEN count(gap) OVER p >= 20 THEN max(gap) OVER p END, 6) AS max_20 FROM gaps
      WINDOW w AS (ORDER BY d), p AS (ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), a AS (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "session_interleaved_moments": f"""WITH {V.BARS}, s AS (SELECT ticker, d, 0 AS slot, ln(high) - ln(open) AS x FROM bars WHERE volume > 1 UNION ALL SELECT ticker, d, 1, ln(low) - ln(close) FROM bars WHERE volume > 1),
      l AS (SELECT *, list(x) OVER b AS h, avg(x) OVER b AS m, stddev_samp(x) OVER b AS sd, count(*) OVER a AS k, avg(x) OVER a AS m20, avg(CASE WHEN x < 0 THEN x * x END) OVER a AS dn, avg(CASE WHEN x > 0 THEN x * x END) OVER a AS up FROM s
        WINDOW a AS (PARTITION BY ticker ORDER BY d, slot ROWS 19 PRECEDING), b AS (PARTITION BY ticker ORDER BY d, slot ROWS 119 PRECEDING))
      SELECT ticker, {D}, CAST(slot AS BIGINT) AS slot, round(x, 6) AS x, round(CASE WHEN k >= 20 THEN m20 END, 6) AS mean_20, round(CASE WHEN k >= 20 THEN coalesce(dn, 0) END, 6) AS semi_down_20,
        round(CASE WHEN k >= 20 THEN coalesce(up, 0) END, 6) AS semi_up_20, round(CASE WHEN len(h) >= 120 THEN list_avg(list_transform(h, lambda z: pow((z - m) / sd, 3))) END, 5) AS skew_120,
        round(CASE WHEN len(h) >= 120 THEN list_avg(list_transform(h, lambda z: pow((z - m) / sd, 4))) - 3 END, 5) AS kurt_120 FROM l""",
    "parkinson_rolling": f"""WITH {V.BARS}, p AS (SELECT ticker, d, pow(ln(high) - ln(low), 2) / (4 * ln(2)) AS pk FROM bars) SELECT ticker, {D}, round(pk, 6) AS pk,
      round(CASE WHEN count(pk) OVER a >= 5 THEN avg(pk) OVER a END, 6) AS pk_5, round(CASE WHEN count(pk) OVER b >= 20 THEN avg(pk) OVER b END, 6) AS pk_20, round(CASE WHEN count(pk) OVER c >= 20 THEN avg(pk) OVER c END, 6) AS pk_60 FROM p
      WINDOW a AS (PARTITION BY ticker ORDER BY d ROWS 4 PRECEDING), b AS (PARTITION BY ticker ORDER BY d ROWS 19 PRECEDING), c AS (PARTITION BY ticker ORDER BY d ROWS 59 PRECEDING)""",
    "volume_zscores": f"""WITH {V.BARS}, l AS (SELECT ticker, d, ln(volume) AS v FROM bars) SELECT ticker, {D}, round(v - lag(v) OVER w, 6) AS dlog, round(CASE WHEN count(*) OVER f >= 20 THEN (v - avg(v) OVER f) / nullif(stddev_samp(v) OVER f, 0) END, 6) AS z_60 FROM l
      WINDOW w AS (PARTITION BY ticker ORDER BY d), f AS (PARTITION BY ticker ORDER BY d ROWS 59 PRECEDING)""",
    "volume_surge": f"""WITH {V.BARS}, l AS (SELECT ticker, d, volume, list(volume) OVER p AS h, avg(volume) OVER p AS m, stddev_samp(volume) OVER p AS sd FROM bars WINDOW p AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
      SELECT ticker, {D}, round(volume / m, 6) AS ratio, round((volume - m) / nullif(sd, 0), 6) AS z, round(len(list_filter(h, lambda x: x <= volume)) / nullif(len(h), 0), 6) AS pct FROM l""",
    "tail_hit_counts": f"""WITH {V.LOSSES}, l AS (SELECT side, d, CASE WHEN count(loss) OVER y = 252 THEN quantile_cont(loss, 0.95) OVER y END AS thr, list(loss) OVER a AS h20, list(loss) OVER b AS h60 FROM losses
        WINDOW y AS (PARTITION BY side ORDER BY d ROWS 251 PRECEDING), a AS (PARTITION BY side ORDER BY d ROWS 19 PRECEDING), b AS (PARTITION BY side ORDER BY d ROWS 59 PRECEDING))
      SELECT side, {D}, round(thr, 6) AS threshold, CASE WHEN thr IS NOT NULL THEN CAST(len(list_filter(h20, lambda x: x > thr)) AS DOUBLE) END AS hits_20, CASE WHEN thr IS NOT NULL THEN CAST(len(list_filter(h60, lambda x: x > thr)) AS DOUBLE) END AS hits_60 FROM l""",
    "contract_calendar_features": f"""WITH {V.DAILY}, s AS (SELECT d, CAST(date_trunc('month', d) AS DATE) AS m FROM daily)
      SELECT {D}, date_diff('day', d, m + CAST((5 - dayofweek(m) + 7) % 7 + 7 AS INTEGER)) AS days_to_sq, round(sin(month(d) * 2 * pi() / 12), 6) + 0 AS month_sin, round(cos(month(d) * 2 * pi() / 12), 6) + 0 AS month_cos FROM s""",
    "option_surface_daily": f"""WITH {V.SURFACE}, m AS (SELECT *, abs(strike - spot) = min(abs(strike - spot)) OVER (PARTITION BY d) AS atm, {BUCKET} AS b, strike / spot AS mo FROM surface)
      SELECT {D}, count(*) AS rows, round(avg(iv) FILTER (WHERE atm), 5) AS atm_iv, count(*) FILTER (WHERE atm) AS atm_rows, round(quantile_cont(iv, 0.5) FILTER (WHERE b = 'short'), 4) AS iv_short,
        round(quantile_cont(iv, 0.5) FILTER (WHERE b = 'medium'), 4) AS iv_medium, round(quantile_cont(iv, 0.5) FILTER (WHERE mo < 0.9), 4) AS iv_otm_put,
        round(count(*) FILTER (WHERE pc = 'put') / nullif(count(*) FILTER (WHERE pc = 'call'), 0), 6) AS put_call_ratio, round(sum(iv * oi) / sum(oi), 6) AS iv_weighted FROM m GROUP BY m.d""",
    "option_state_rolling": f"""WITH {V.SURFACE}, s AS (SELECT d, avg(iv) AS x FROM surface GROUP BY d), l AS (SELECT d, x, list(round(x, 9)) OVER b AS h, count(*) OVER a AS n, avg(x) OVER a AS m, stddev_samp(x) OVER a AS sd FROM s
        WINDOW a AS (ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), b AS (ORDER BY d ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))
      SELECT {D}, round(CASE WHEN n >= 20 THEN x - m END, 6) AS vs_mean, round(CASE WHEN n >= 20 THEN (x - m) / nullif(sd, 0) END, 4) AS z, round(CASE WHEN len(h) >= 20 THEN len(list_filter(h, lambda v: v <= round(x, 9))) / len(h) END, 6) AS pct_60 FROM l""",
    "option_state_asof": f"""WITH {V.SURFACE}, {V.DAILY}, s AS (SELECT d AS source, avg(iv) AS iv FROM surface WHERE dayofyear(d) % 4 <> 0 GROUP BY d), j AS (SELECT daily.d, source, iv FROM daily ASOF LEFT JOIN s ON daily.d > source)
      SELECT {D}, CASE WHEN d - source <= 7 THEN round(iv, 8) END AS iv, CASE WHEN d - source <= 7 THEN CAST(source AS VARCHAR) END AS source FROM j""",
    "nearest_atm_contract": f"""WITH {V.SURFACE}, r AS (SELECT *, row_number() OVER (PARTITION BY d, pc ORDER BY round(abs(ln(strike / spot)), 9), dte, contract, okey) AS k FROM surface WHERE pc IS NOT NULL)
      SELECT {D}, pc, contract, strike, CAST(dte AS BIGINT) AS dte FROM r WHERE k = 1""",
    "iv_cross_section": f"""WITH {V.SURFACE}, g AS (SELECT d, {BUCKET} AS bucket, list(iv ORDER BY iv) AS h, quantile_cont(iv, 0.5) AS m, max(iv) AS mx, count(*) AS n, stddev_pop(iv) AS sd FROM surface GROUP BY 1, 2)
      SELECT {D}, bucket, round(m, 4) AS median, round(list_avg(h[CAST(floor(n * 0.2) AS INTEGER) + 1 : n - CAST(floor(n * 0.2) AS INTEGER)]), 9) AS trimmed, mx AS max, n, round(CASE WHEN n >= 2 THEN sd END, 5) AS dispersion FROM g""",
    "option_liquidity": f"WITH {V.SURFACE}, g AS (SELECT d, {BUCKET} AS bucket, count(DISTINCT contract) AS c, count(*) AS q FROM surface GROUP BY 1, 2) SELECT bucket, max(c) AS max_contracts, CAST(sum(q) AS BIGINT) AS quotes, count(*) AS days FROM g GROUP BY 1",
    "intraday_late_session": f"""WITH {V.MINUTES}, k AS (SELECT *, CAST(unnest([60, 240]) AS BIGINT) AS minutes, max(ts) OVER (PARTITION BY ticker, d) AS last FROM minutes),
      l AS (SELECT *, ln(CASE WHEN close > 0 THEN close END) - ln(CASE WHEN lag(close) OVER w > 0 THEN lag(close) OVER w END) AS ret FROM k WHERE ts >= last - INTERVAL 1 MINUTE * minutes WINDOW w AS (PARTITION BY ticker, d, minutes ORDER BY ts, id))
      SELECT ticker, {D}, minutes, count(*) AS bars, round(CASE WHEN arg_min(close, (ts, id)) > 0 AND arg_max(close, (ts, id)) > 0 THEN ln(arg_max(close, (ts, id))) - ln(arg_min(close, (ts, id))) END, 5) AS ret,
        round(CASE WHEN count(ret) >= 2 THEN sum(ret * ret) END, 5) AS rv, round(CASE WHEN count(ret) >= 2 THEN coalesce(sum(ret * ret) FILTER (WHERE ret < 0), 0) END, 5) AS semi_down,
        round(CASE WHEN count(ret) >= 2 THEN coalesce(sum(ret * ret) FILTER (WHERE ret > 0), 0) END, 5) AS semi_up, round(ln(max(close) FILTER (WHERE close > 0)) - ln(min(close) FILTER (WHERE close > 0)), 5) AS log_range FROM l GROUP BY ticker, l.d, minutes""",
    "cross_market_features": f"""WITH {V.BARS}, b AS (SELECT ticker, d, ln(close) - ln(lag(close) OVER (PARTITION BY ticker ORDER BY d)) AS ret FROM bars),
      g AS (SELECT d, count(ret) AS n, avg(ret) AS m, stddev_samp(ret) AS sd, max(ret) FILTER (WHERE ticker LIKE '1%') AS a, max(ret) FILTER (WHERE ticker LIKE '5%') AS b FROM b GROUP BY d), h AS (SELECT *, CASE WHEN n >= 3 THEN m END AS mean FROM g)
      SELECT {D}, round(mean, 6) AS mean, round(CASE WHEN n >= 3 THEN sd END, 6) AS spread, round(a - b, 6) AS urgent_vs_low, round(mean - avg(mean) OVER (ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 6) AS shock_20 FROM h""",
    "event_intensity": f"""WITH {V.DAILY}, c AS (SELECT CAST(l_shipdate AS DATE) AS e, count(*) AS n FROM lineitem GROUP BY 1), busy AS (SELECT e FROM c WHERE n > (SELECT quantile_cont(n, 0.95) FROM c)), j AS (SELECT d, e - d AS g FROM daily LEFT JOIN busy ON abs(e - d) <= 30)
      SELECT {D}, count(*) FILTER (WHERE g = 0) AS same_day, count(*) FILTER (WHERE g BETWEEN 1 AND 3) AS next_3, CAST(coalesce(min(g) FILTER (WHERE g > 0), 30) AS BIGINT) AS to_next, CAST(coalesce(min(-g) FILTER (WHERE g < 0), 30) AS BIGINT) AS since_last FROM j GROUP BY j.d""",
    "oos_start_search": f"""WITH {V.LOSSES}, p AS (SELECT side, d, count(loss) OVER w AS k, quantile_cont(loss, 0.95) OVER w AS q, list(loss) OVER w AS h FROM losses WINDOW w AS (PARTITION BY side ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
      SELECT side, CAST(min(d) AS VARCHAR) AS start, count(*) AS days FROM p WHERE k >= {V.MIN_TRAIN} AND len(list_filter(h, lambda x: x > q)) >= 20 GROUP BY side""",
    "refit_calendar": f"WITH {V.DAILY} SELECT CAST(CAST(date_trunc('month', d) AS DATE) AS VARCHAR) AS month, CAST(min(d) AS VARCHAR) AS refit, count(*) AS n FROM daily GROUP BY 1",
    "block_maxima_scaling": "WITH " + V.LOSSES + ", m AS (" + " UNION ALL ".join(f"SELECT side, CAST({b} AS BIGINT) AS size, count(*) OVER w AS n, max(loss) OVER w AS m FROM losses WINDOW w AS (PARTITION BY side ORDER BY d ROWS BETWEEN CURRENT ROW AND {b - 1} FOLLOWING)" for b in (5, 10, 20, 40)) + ") SELECT side, size, count(*) AS blocks, round(quantile_cont(m, 0.5), 6) AS median FROM m WHERE n = size GROUP BY 1, 2",
    "stress_episodes": f"""WITH {V.LOSSES}, q AS (SELECT side, quantile_cont(loss, 0.9) AS q FROM losses GROUP BY 1), x AS (SELECT side, d, loss, coalesce(d - lag(d) OVER (PARTITION BY side ORDER BY d) > 5, TRUE) AS n FROM losses JOIN q USING (side) WHERE loss > q),
      c AS (SELECT *, sum(CAST(n AS INTEGER)) OVER (PARTITION BY side ORDER BY d) AS c FROM x) SELECT side, CAST(min(d) AS VARCHAR) AS first, CAST(max(d) AS VARCHAR) AS last, count(*) AS days, round(max(loss), 6) AS worst FROM c GROUP BY side, c""",
    "hill_mean_excess_survival": f"""WITH {V.LOSSES}, c AS (SELECT side, loss, row_number() OVER w AS k, avg(ln(loss)) OVER p AS above, avg(loss) OVER p AS ma, 1 - cume_dist() OVER (PARTITION BY side ORDER BY loss) AS survival FROM losses WHERE loss > 0
        WINDOW w AS (PARTITION BY side ORDER BY loss DESC), p AS (PARTITION BY side ORDER BY loss DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
      SELECT side, k, round(above - ln(loss), 6) AS hill, round(ma - loss, 6) AS mean_excess, round(survival, 6) AS survival FROM c WHERE k >= 9""",
    "target_summary_jb": f"""WITH {V.LOSSES}, m AS (SELECT side, count(*) AS n, avg(loss) AS mean, stddev_samp(loss) AS sd, min(loss) AS lo, max(loss) AS hi, arg_max(CAST(d AS VARCHAR), loss) AS worst_day,
        {', '.join(f"quantile_cont(loss, {p}) AS q{int(100 * p):02d}" for p in (0.01, 0.05, 0.5, 0.95, 0.99))} FROM losses GROUP BY side),
      s AS (SELECT side, avg(pow((loss - mean) / sd, 3)) AS skew, avg(pow((loss - mean) / sd, 4)) - 3 AS kurt FROM losses JOIN m USING (side) GROUP BY side)
      SELECT side, n, {', '.join(f'round({c}, 6) AS {c}' for c in ('mean', 'sd', 'lo', 'hi', 'q01', 'q05', 'q50', 'q95', 'q99'))}, round(skew, 4) AS skew, round(kurt, 4) AS kurt, worst_day, round(n / 6 * (skew * skew + kurt * kurt / 4), 2) AS jarque_bera FROM m JOIN s USING (side)""",
    "extremal_index_fs": f"""WITH {EXCESS} SELECT side, count(*) AS exceedances, round(least(1.0, CASE WHEN max(t) <= 2 THEN 2 * pow(sum(t), 2) / (count(t) * sum(t * t)) ELSE 2 * pow(sum(t - 1), 2) / (count(t) * sum((t - 1) * (t - 2))) END), 6) AS theta FROM t GROUP BY side""",
    "extremal_index_kgaps": f"""WITH {EXCESS}, s AS (SELECT side, count(*) AS k, max(n) AS n, count(*) FILTER (WHERE greatest(t - 2, 0) = 0 AND t IS NOT NULL) AS z, count(*) FILTER (WHERE t > 2) AS o, sum(CASE WHEN t IS NOT NULL THEN greatest(t - 2, 0) END) AS g FROM t GROUP BY side),
      l AS (SELECT side, theta, z * ln(1 - theta) + 2 * o * ln(theta) - theta * k / n * g AS ll FROM s, (SELECT unnest(range(1, 100)) / 100 AS theta))
      SELECT side, arg_max(theta, ll) AS theta, round(max(ll), 4) AS log_likelihood FROM l GROUP BY side""",
}
