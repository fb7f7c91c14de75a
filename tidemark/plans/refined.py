"""Implied volatility by underlying, closing windows of a session, and the choice between tail-index estimators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intraday
from ..operators.select import order_statistics
from . import audit
from . import views as V
from .panel import S, r, text

#: An option is liquid from this open interest on.
LIQUID = 30_000
#: Underlyings from which a day's cross-section is given.
LEAST_UNDERLYINGS = 3
#: Differences from the moment estimate beyond which the other estimates contradict it.
APART = 0.75


def by_underlying(spark: SparkSession, sf: str) -> DataFrame:
    """d, underlying, short, medium (implied volatilities), short_n, medium_n: of each underlying and bucket of days to expiry the mean of the
    liquid call and put nearest the money, and how many contracts are liquid.  A contract's underlying is its part's brand; the spot is the
    underlying's mean strike of the day."""
    parts = V.table(spark, sf, "part").select(S("p_partkey").alias("contract"), S("p_brand").alias("underlying"))
    c = V.chain(spark, sf).filter("pc is not null").join(parts, "contract")
    spots = c.groupBy("d", "underlying").agg(F.avg("strike").alias("spot"))
    bucket = F.when(S("dte").between(15, 30), "short").when(S("dte").between(45, 90), "medium")
    c = c.withColumn("bucket", bucket).filter((S("oi") > LIQUID) & (S("strike") > 0) & S("bucket").isNotNull()).join(spots, ["d", "underlying"])
    near = F.struct(F.round(F.abs(F.log(S("strike") / S("spot"))), 9), "dte", "contract", "okey", "iv")
    best = c.groupBy("d", "underlying", "bucket", "pc").agg(F.min_by("iv", near).alias("iv"), F.count("*").alias("n"))
    one = lambda b, what, c: what(F.when(S("bucket") == b, S(c)))
    return best.groupBy("d", "underlying").agg(*[one(b, F.avg, "iv").alias(b) for b in ("short", "medium")], *[F.coalesce(one(b, F.sum, "n"), F.lit(0)).alias(f"{b}_n") for b in ("short", "medium")])


def option_underlying_iv(spark: SparkSession, sf: str) -> DataFrame:
    u = by_underlying(spark, sf)
    return u.select(text("d").alias("d"), "underlying", r("short").alias("short_iv"), r("medium").alias("medium_iv"), r(S("medium") - S("short")).alias("term_slope"), "short_n", "medium_n")


def option_iv_by_bucket(spark: SparkSession, sf: str) -> DataFrame:
    """By day and measure (short, medium, slope) over underlyings: median, 20 % trimmed mean and count, where there are enough."""
    u = by_underlying(spark, sf)
    long = u.select("d", F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), c.alias("v")) for n, c in (("short", S("short")), ("medium", S("medium")), ("slope", S("medium") - S("short")))])).alias("m")).select("d", "m.*")
    out = order_statistics(long, ["d", "measure"], "v", {"median": 0.5}, {"trimmed": 0.2}).filter(S("n") >= LEAST_UNDERLYINGS)
    return out.select(text("d").alias("d"), "measure", S("n").alias("underlyings"), (r("median", 9) + 0.0).alias("median"), (r("trimmed", 9) + 0.0).alias("trimmed"))


def session_closing_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Returns over three windows before a session's last bar, and moments of the longest."""
    m = V.minute_bars(spark, sf).withColumn("volume", S("id") % 7 + 1)
    out = intraday.closing_windows(m, {"final": 60, "half": 120, "whole": 240}, "whole")
    return out.select("ticker", text("d").alias("d"), "bars", *[r(c, 5).alias(c) for c in ("return_final", "return_half", "return_whole", "rv", "semi_down", "semi_up", "skew", "kurtosis", "log_range", "volume_share")])


def evi_selection(spark: SparkSession, sf: str) -> DataFrame:
    """The tail index of each side: the moment estimate at its stable window, unless the Hill or the Pickands estimate lies far from it."""
    w = audit.evi_stable_window(spark, sf)
    of = lambda m: F.max(F.when(S("method") == m, S("xi")))
    g = w.groupBy("side").agg(of("dedh").alias("moment"), of("hill").alias("hill"), of("pickands").alias("pickands"))
    apart = F.greatest(F.abs(S("moment") - S("hill")), F.abs(S("moment") - S("pickands")))
    status = F.when(S("moment").isNull(), "no_moment_estimate").when(apart > APART, "estimates_disagree").otherwise("ok")
    return g.select("side", status.alias("status"), F.when(status == "ok", S("moment")).alias("xi"), r(apart, 5).alias("largest_difference"))


Q = {f.__name__: f for f in (option_underlying_iv, option_iv_by_bucket, session_closing_windows, evi_selection)}

U = f"""li AS (SELECT CAST(l_shipdate AS DATE) AS d, p_brand AS underlying, l_partkey AS contract, l_quantity AS strike, l_discount AS iv, l_extendedprice AS oi,
  CASE l_returnflag WHEN 'R' THEN 'put' WHEN 'A' THEN 'call' END AS pc, l_linenumber * 15 AS dte, l_orderkey AS okey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag IN ('R', 'A')),
spots AS (SELECT d, underlying, avg(strike) AS spot FROM li GROUP BY 1, 2),
c AS (SELECT *, CASE WHEN dte BETWEEN 15 AND 30 THEN 'short' WHEN dte BETWEEN 45 AND 90 THEN 'medium' END AS bucket FROM li JOIN spots USING (d, underlying) WHERE oi > {LIQUID} AND strike > 0),
b AS (SELECT d, underlying, bucket, pc, iv, count(*) OVER (PARTITION BY d, underlying, bucket, pc) AS n FROM c WHERE bucket IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY d, underlying, bucket, pc ORDER BY round(abs(ln(strike / spot)), 9), dte, contract, okey, iv) = 1),
u AS (SELECT d, underlying, avg(iv) FILTER (WHERE bucket = 'short') AS short, avg(iv) FILTER (WHERE bucket = 'medium') AS medium, CAST(coalesce(sum(n) FILTER (WHERE bucket = 'short'), 0) AS BIGINT) AS short_n,
  CAST(coalesce(sum(n) FILTER (WHERE bucket = 'medium'), 0) AS BIGINT) AS medium_n FROM b GROUP BY 1, 2)"""
SQL = {
    "option_underlying_iv": f"WITH {U} SELECT CAST(d AS VARCHAR) AS d, underlying, round(short, 6) AS short_iv, round(medium, 6) AS medium_iv, round(medium - short, 6) AS term_slope, short_n, medium_n FROM u",
    "option_iv_by_bucket": f"""WITH {U}, l AS (SELECT d, unnest(['short', 'medium', 'slope']) AS measure, unnest([short, medium, medium - short]) AS v FROM u), g AS (SELECT d, measure, list(v ORDER BY v) AS h, count(*) AS n FROM l WHERE v IS NOT NULL GROUP BY 1, 2)
      SELECT CAST(d AS VARCHAR) AS d, measure, n AS underlyings, round(list_aggregate(h, 'quantile_cont', 0.5), 9) + 0.0 AS median, round(list_avg(h[CAST(floor(n * 0.2) AS INTEGER) + 1 : n - CAST(floor(n * 0.2) AS INTEGER)]), 9) + 0.0 AS trimmed FROM g WHERE n >= {LEAST_UNDERLYINGS}""",
    "session_closing_windows": f"""WITH {V.MINUTES}, k AS (SELECT *, id % 7 + 1 AS volume, max(ts) OVER (PARTITION BY ticker, d) AS last, ln(CASE WHEN close > 0 THEN close END) - ln(CASE WHEN lag(close) OVER w > 0 THEN lag(close) OVER w END) AS x, lag(ts) OVER w AS was FROM minutes WINDOW w AS (PARTITION BY ticker, d ORDER BY ts, id)),
      f AS (SELECT *, ts >= last - INTERVAL 60 MINUTE AS a, ts >= last - INTERVAL 120 MINUTE AS b, ts >= last - INTERVAL 240 MINUTE AS c, CASE WHEN was >= last - INTERVAL 240 MINUTE THEN x END AS y FROM k),
      m AS (SELECT ticker, d, avg(y) AS m, stddev_samp(y) AS sd FROM f GROUP BY 1, 2),
      g AS (SELECT f.ticker, f.d, count(*) FILTER (WHERE c) AS bars, count(*) FILTER (WHERE a) AS na, count(*) FILTER (WHERE b) AS nb, arg_min(close, (ts, id)) FILTER (WHERE a) AS fa, arg_min(close, (ts, id)) FILTER (WHERE b) AS fb, arg_min(close, (ts, id)) FILTER (WHERE c) AS fc, arg_max(close, (ts, id)) AS z,
        count(y) AS n, sum(y * y) AS rv, sum(y * y) FILTER (WHERE y < 0) AS dn, sum(y * y) FILTER (WHERE y > 0) AS up, avg(pow((y - m.m) / m.sd, 3)) AS s3, avg(pow((y - m.m) / m.sd, 4)) AS s4,
        ln(max(close) FILTER (WHERE c AND close > 0)) - ln(min(close) FILTER (WHERE c AND close > 0)) AS rng, sum(volume) FILTER (WHERE c) / sum(volume) AS share FROM f JOIN m ON m.ticker = f.ticker AND m.d = f.d GROUP BY 1, 2),
      p AS (SELECT *, CASE WHEN z > 0 THEN ln(z) END AS lz FROM g)
      SELECT ticker, CAST(d AS VARCHAR) AS d, bars, round(CASE WHEN na >= 2 AND fa > 0 THEN lz - ln(fa) END, 5) AS return_final, round(CASE WHEN nb >= 2 AND fb > 0 THEN lz - ln(fb) END, 5) AS return_half, round(CASE WHEN bars >= 2 AND fc > 0 THEN lz - ln(fc) END, 5) AS return_whole,
        round(CASE WHEN n >= 3 THEN rv END, 5) AS rv, round(CASE WHEN n >= 3 THEN coalesce(dn, 0) END, 5) AS semi_down, round(CASE WHEN n >= 3 THEN coalesce(up, 0) END, 5) AS semi_up, round(CASE WHEN n >= 3 THEN s3 END, 5) AS skew, round(CASE WHEN n >= 3 THEN s4 - 3 END, 5) AS kurtosis, round(rng, 5) AS log_range, round(share, 5) AS volume_share FROM p""",
    "evi_selection": f"""WITH w AS ({audit.SQL["evi_stable_window"]}), g AS (SELECT side, max(xi) FILTER (WHERE method = 'dedh') AS m, max(xi) FILTER (WHERE method = 'hill') AS h, max(xi) FILTER (WHERE method = 'pickands') AS p FROM w GROUP BY 1),
      a AS (SELECT *, greatest(abs(m - h), abs(m - p)) AS apart FROM g)
      SELECT side, CASE WHEN m IS NULL THEN 'no_moment_estimate' WHEN apart > {APART} THEN 'estimates_disagree' ELSE 'ok' END AS status, CASE WHEN m IS NOT NULL AND coalesce(apart <= {APART}, TRUE) THEN m END AS xi, round(apart, 5) AS largest_difference FROM a""",
}
