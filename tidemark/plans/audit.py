"""Queries over calendars of two markets, closes, event stamps, option buckets, lagged summaries and tail-index paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import rolling as R
from ..operators.asof import asof_join
from ..operators.calendar import contract_table, dense, utc_offset_minutes
from . import panel
from . import views as V
from .panel import S, r, text

STAMP = "yyyy-MM-dd HH:mm:ss"
#: Summaries older than this many days are not looked for.
LOOKBACK_DAYS = 12
#: Points of the grid of tail counts.
TAIL_COUNTS = 24


def at_time(d: Column, clock: str | Column) -> Column:
    """The timestamp of a day at HH:mm."""
    clock = F.lit(clock) if isinstance(clock, str) else clock
    return F.to_timestamp(F.concat(d.cast("string"), F.lit(" "), clock, F.lit(":00")))


def calendar_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """How each day of the dense calendar maps between two markets, and the first reason if it is not a normal one.

    The markets' sessions are the days with urgent and with high-priority orders.
    """
    o = V.table(spark, sf, "orders").select(V.day("o_orderdate").alias("d"), "o_orderpriority")
    open_ = o.groupBy("d").agg(F.max(S("o_orderpriority") == "1-URGENT").alias("us"), F.max(S("o_orderpriority") == "2-HIGH").alias("jp"))
    c = dense(open_).join(open_, "d", "left").select("d", F.coalesce("us", F.lit(False)).alias("us"), F.coalesce("jp", F.lit(False)).alias("jp"))
    before = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, -1)  # a calendar's days: one task
    c = c.withColumn("last_us", F.max(F.when(S("us"), S("d"))).over(before)).withColumn("weekday", F.dayofweek("d").between(2, 6))
    cases = [
        (~S("us") & ~S("jp"), "unmapped", "missing_time_alignment"),
        (S("last_us").isNull(), "us_holiday", "no_us_close_before_target_open"),
        (S("jp") & ~S("weekday"), "holiday_trading", "no_day_open"),
        (S("jp") & ~S("us"), "us_holiday", "us_closed_jp_open"),
        (S("us") & ~S("jp"), "desync", "us_open_jp_closed"),
        (F.date_diff("d", "last_us") > 4, "desync", "stale_us_close"),
    ]
    pick = lambda k: F.coalesce(*[F.when(case[0], case[k]) for case in cases])
    return c.select(text("d").alias("d"), "us", "jp", (S("weekday") & ~S("us")).alias("us_weekday_holiday"), F.coalesce(pick(1), F.lit("normal")).alias("status"), pick(2).alias("reason"))


def close_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Minutes from one market's close to the other's night close, against what the clock regime lets expect.

    The 24th closes early; the 10th and 11th are off, so that the check fails there.
    """
    d = S("d")
    early = F.dayofmonth("d") == 24
    us = F.to_utc_timestamp(at_time(d, F.when(early, "13:00").when(F.dayofmonth("d") == 10, "15:30").otherwise("16:00")), "America/New_York")
    night = F.to_utc_timestamp(at_time(F.date_add("d", 1), F.when(F.dayofmonth("d") == 11, "04:00").otherwise("06:00")), "Asia/Tokyo")
    c = V.daily(spark, sf).select("d", early.alias("early"), us.alias("us"), night.alias("night"), F.when(utc_offset_minutes(d, "America/New_York") == -240, "EDT").otherwise("EST").alias("regime"))
    c = c.withColumn("minutes", F.floor((S("night").cast("long") - S("us").cast("long")) / 60))
    expected = F.when(S("early"), F.when(S("regime") == "EST", 180).otherwise(240)).otherwise(F.when(S("regime") == "EST", 0).otherwise(60))
    absorption = F.when(S("minutes") == 0, "coincident").when(S("minutes") > 0, "night_absorption").otherwise("after_night_close")
    return c.select(text("d").alias("d"), "regime", "early", "minutes", (F.abs(S("minutes") - expected) <= 5).alias("aligned"), absorption.alias("absorption"), F.date_format(S("us") - F.expr("interval 30 minutes"), STAMP).alias("calendar_available"))


def last_bar_at_close(spark: SparkSession, sf: str) -> DataFrame:
    """The last bar of the regular session at or before the day's official close."""
    m = V.minute_bars(spark, sf)
    close = at_time(S("d"), F.when(F.dayofmonth("d") == 24, "13:00").otherwise("16:00"))
    inside = (F.hour("ts") >= 9) & (S("ts") <= close)
    best = F.max_by(F.struct("ts", "close"), F.when(inside, F.struct("ts", "id")))
    out = m.groupBy("ticker", "d").agg(best.alias("b"))
    found = S("b").isNotNull()
    return out.select("ticker", text("d").alias("d"), F.date_format("b.ts", STAMP).alias("bar_ts"), r("b.close").alias("close"), F.when(found, "last_regular_bar").otherwise("missing_regular_bar").alias("reason"))


def fx_last_positive(spark: SparkSession, sf: str) -> DataFrame:
    """Log return against the last positive value; values that are absent or not positive neither have nor give one."""
    week = F.weekofyear("week")
    m = V.macro(spark, sf).select("week", F.when(week % 5 == 0, -S("level")).when(week % 7 != 0, S("level")).alias("value")).withColumn("positive", X.positive(S("value")))
    before = R.last_known("positive", R.series([], "week"))
    return m.select(text("week").alias("week"), r("value", 2).alias("value"), r(F.log("positive") - F.log(before)).alias("ret"))


def forward_filled_diffs(spark: SparkSession, sf: str) -> DataFrame:
    """A carried level's difference is zero and marked as filled; on the first day of a release it is the release's own."""
    m = V.macro(spark, sf)
    m = m.withColumn("diff", S("level") - F.lag("level").over(Window.orderBy("week")))
    a = asof_join(V.daily(spark, sf).select("d"), m, "d", "week", columns=["week", "level", "diff"], available="available", tolerance_days=20, suffix="_in")
    carried = S("week_in").eqNullSafe(F.lag("week_in").over(Window.orderBy("d"))) & S("level_in").isNotNull()
    return a.withColumn("carried", carried).select(text("d").alias("d"), r("level_in", 2).alias("level"), r(F.when(S("carried"), 0.0).otherwise(S("diff_in")), 2).alias("diff"), S("carried").alias("is_filled"))


def roll_sq_window(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a day lies between a contract's roll start and its settlement."""
    days = V.daily(spark, sf).select("d")
    c = contract_table(days, roll_sessions=3).select("month", "sq", "roll_start")
    near = F.array(F.trunc("d", "MM"), F.add_months(F.trunc("d", "MM"), 1))
    met = days.select("d", F.explode(near).alias("month")).join(c, "month", "left")
    inside = F.coalesce((S("roll_start") <= S("d")) & (S("d") <= S("sq")), F.lit(False))
    return met.groupBy("d").agg(F.max(inside).alias("in_window")).select(text("d").alias("d"), "in_window")


def calendar_horizon(spark: SparkSession, sf: str) -> DataFrame:
    """The last day that any contract refers to, not before the stated one."""
    c = contract_table(V.daily(spark, sf).select("d"), roll_sessions=3)
    return c.agg(F.greatest(F.max(F.greatest("last_trade", "sq")), F.lit("1998-01-01").cast("date")).cast("string").alias("horizon"), F.count("*").alias("contracts"))


def event_stamps(spark: SparkSession, sf: str) -> DataFrame:
    """Same-session flags of two event types, known by noon, with the first event's availability or else the cutoff."""
    e = V.table(spark, sf, "events").select(V.day("ts").alias("d"), S("ts").cast("timestamp").alias("ts"), "event_type")
    cutoff = at_time(S("d"), "12:00")
    known = S("ts") + F.expr("interval 3 hours")
    per_day = e.groupBy("d").agg(
        F.min(F.when((S("event_type") == "purchase") & (S("ts") <= cutoff), S("ts"))).alias("us"),
        F.min(F.when((S("event_type") == "view") & (known <= cutoff), known)).alias("ose"),
    )
    stamp = lambda c: F.date_format(F.coalesce(S(c), cutoff), STAMP)
    flag = lambda c: S(c).isNotNull().cast("double")
    return per_day.select(text("d").alias("d"), flag("us").alias("us_session"), stamp("us").alias("us_available"), flag("ose").alias("ose_session"), stamp("ose").alias("ose_available"))


def option_bucket_iv(spark: SparkSession, sf: str) -> DataFrame:
    """Median implied volatility of the liquid call and put nearest the money, in a short and a medium bucket of days to
    expiry, and the slope between them."""
    bucket = F.when(S("dte").between(15, 30), "short").when(S("dte").between(45, 90), "medium")
    c = V.surface(spark, sf).withColumn("bucket", bucket).filter("bucket is not null and pc is not null and oi > 30000 and strike > 0")
    near = F.struct(F.abs(F.log(S("strike") / S("spot"))), "dte", "contract", "okey", "iv")
    best = c.groupBy("d", "bucket", "pc").agg(F.min_by("iv", near).alias("iv"), F.count("*").alias("n"))
    one = lambda b, what: what(F.when(S("bucket") == b, S("iv" if what is F.avg else "n")))  # noqa: E731  the median of two
    out = best.groupBy("d").agg(*[one(b, F.avg).alias(f"{b}_iv") for b in ("short", "medium")], *[F.coalesce(one(b, F.sum), F.lit(0)).alias(f"{b}_contracts") for b in ("short", "medium")])
    return out.select(text("d").alias("d"), r("short_iv").alias("short_iv"), r("medium_iv").alias("medium_iv"), r(S("medium_iv") - S("short_iv")).alias("term_slope"), "short_contracts", "medium_contracts")


def option_empty_days(spark: SparkSession, sf: str) -> DataFrame:
    """A summary for every day: counts are zero and measures null where no contract passes."""
    days = V.table(spark, sf, "lineitem").select(V.day("l_shipdate").alias("d"))
    deep = V.surface(spark, sf).filter("pc = 'put' and strike > 48").groupBy("d").agg(F.count("*").alias("n"), F.avg("iv").alias("iv"))
    return dense(days).join(deep, "d", "left").select(text("d").alias("d"), F.coalesce("n", F.lit(0)).alias("contracts"), r("iv").alias("iv"))


def option_dte_scope(spark: SparkSession, sf: str) -> DataFrame:
    """Central contracts within the days to expiry where a day has any, else all within them."""
    c = V.surface(spark, sf).filter(S("dte").between(15, 60)).withColumn("central", S("contract") % 10 == 0)
    out = c.groupBy("d").agg(F.count_if("central").alias("k"), F.count("*").alias("n"), F.avg(F.when(S("central"), S("iv"))).alias("x"), F.avg("iv").alias("y"))
    any_ = S("k") > 0
    return out.select(text("d").alias("d"), F.when(any_, "central").otherwise("all").alias("scope"), F.when(any_, S("k")).otherwise(S("n")).alias("contracts"), r(F.when(any_, S("x")).otherwise(S("y"))).alias("iv"))


def compat_volume_surge(spark: SparkSession, sf: str) -> DataFrame:
    """Volume over the mean of up to 20 volumes before it; days without one are passed over."""
    v = V.daily(spark, sf).select("d", F.when(F.dayofmonth("d") % 6 != 0, S("n")).alias("volume"))
    mean = F.avg("volume").over(Window.orderBy("d").rowsBetween(-20, -1))
    known = v.filter("volume is not null").select("d", (S("volume") / mean).alias("surge"))
    return v.join(known, "d", "left").select(text("d").alias("d"), "volume", r("surge").alias("surge"))


def row_window_returns(spark: SparkSession, sf: str) -> DataFrame:
    """Log return over the last 5 and 15 bars of a ticker's day, where it has so many."""
    rank = F.row_number().over(Window.partitionBy("ticker", "d").orderBy(F.desc("ts"), F.desc("id")))
    at = lambda k: F.max(F.when(S("k") == k, S("close")))
    out = V.minute_bars(spark, sf).withColumn("k", rank).filter("k in (1, 5, 15)").groupBy("ticker", "d").agg(*[at(k).alias(f"c{k}") for k in (1, 5, 15)])
    return out.select("ticker", text("d").alias("d"), *[r(X.log_return(S(f"c{k}"), S("c1"))).alias(f"return_{k}") for k in (5, 15)])


def lagged_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Measures of the latest earlier day whose summary was available by the day, and their change to the one before."""
    s = V.daily(spark, sf).withColumn("available", F.expr("date_add(d, if(dayofmonth(d) % 9 = 0, 3, 1))"))
    days = s.select("d", F.explode(F.expr(f"sequence(1, {LOOKBACK_DAYS})")).alias("back")).select("d", F.date_sub("d", S("back")).alias("e"))
    met = days.join(s.select(S("d").alias("e"), "lv", "n", "available"), "e").filter("available <= d")
    two = met.groupBy("d").agg(F.sort_array(F.collect_list(F.struct("e", "lv", "n")), asc=False).alias("p"))  # LOOKBACK_DAYS at most
    a, b = F.get("p", F.lit(0)), F.get("p", F.lit(1))
    out = s.select("d").join(two, "d", "left")
    return out.select(text("d").alias("d"), a["e"].cast("string").alias("source"), r(F.log1p(a["n"])).alias("count_log1p"), r(a["n"] / a["lv"] * 100000).alias("count_ratio"), r(a["lv"] - b["lv"], 2).alias("lv_change"))


def aggregate_stamp(spark: SparkSession, sf: str) -> DataFrame:
    """A mean over features with the newest availability of those that have values."""
    f = panel._features(spark, sf).filter(S("feature").startswith("bar_") & S("value").isNotNull())
    out = f.groupBy("d").agg(F.count("*").alias("components"), F.avg("value").alias("mean"), F.max("available").alias("available"))
    return out.select(text("d").alias("d"), "components", r(F.when(S("components") >= 3, S("mean")), 5).alias("mean"), text("available").alias("available"))


def bronze_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Typed columns from vendor strings: the short field, or else the long one; what is no number is null."""
    li = V.table(spark, sf, "lineitem")
    s = lambda c: S(c).cast("string")
    raw = li.select("l_orderkey", "l_linenumber", F.when(S("l_linenumber") % 2 == 0, s("l_quantity")).alias("O"), s("l_quantity").alias("WholeDayOpen"), F.when(S("l_linenumber") % 3 == 0, F.lit("-")).otherwise(s("l_tax")).alias("IV"), F.lit(None).cast("string").alias("ImpliedVolatility"))
    number = lambda a, b: F.coalesce(S(a).try_cast("double"), S(b).try_cast("double"))
    typed = raw.select("l_linenumber", number("O", "WholeDayOpen").alias("open"), number("IV", "ImpliedVolatility").alias("iv"))
    return typed.groupBy(S("l_linenumber").cast("long").alias("line")).agg(F.count("open").alias("opens"), F.count("iv").alias("ivs"), r(F.sum("open"), 2).alias("open_sum"), r(F.sum("iv"), 2).alias("iv_sum"))


# The affixes of this library's feature names.
PREFIXES = ("bar_", "macro_", "option_")
ENDINGS = ("_return", "_range", "_count")
INSIDE = ("_zscore_",)
FEATURE_NAME = f"^({'|'.join(PREFIXES)})|({'|'.join(ENDINGS)})$|{'|'.join(INSIDE)}"
SUFFIXES = ["_return", "_range", "_level__source_date", "_zscore_20", "_close", "_count"]
MEANINGS = [("_return$", "log return"), ("_range$", "log range"), ("_zscore_", "standardised level"), ("_count$", "count")]


def feature_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Which names are features, by their affixes, and what they describe."""
    name = F.concat(F.lower(F.regexp_replace("n_name", " ", "_")), F.element_at(F.array(*map(F.lit, SUFFIXES)), (S("n_nationkey") % len(SUFFIXES) + 1).cast("int")))
    n = V.table(spark, sf, "nation").select(name.alias("name"))
    is_feature = ~S("name").contains("__") & F.rlike("name", F.lit(FEATURE_NAME))
    meaning = F.coalesce(*[F.when(F.rlike("name", F.lit(p)), m) for p, m in MEANINGS], F.lit("other"))
    return n.select("name", is_feature.alias("is_feature"), F.when(is_feature, F.concat(meaning, F.lit(" of "), F.split_part("name", F.lit("_"), F.lit(1)))).alias("description"))


def _tail_paths(spark: SparkSession, sf: str) -> DataFrame:
    """side, k, hill, dedh, pickands on a geometric grid of tail counts; sums run once over the ranked losses."""
    w = Window.partitionBy("side").orderBy(F.desc("loss"), "d")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    x = V.losses(spark, sf).filter("loss > 0").withColumn("l", F.log("loss"))
    x = x.select("side", "loss", F.row_number().over(w).alias("k"), F.sum("l").over(run).alias("s1"), F.sum(S("l") * S("l")).over(run).alias("s2"), F.lead("l").over(w).alias("t"))
    n = x.groupBy("side").agg(F.max("k").alias("n"))
    upper = F.least(F.greatest(F.lit(10), F.floor(S("n") * 0.25)), S("n") - 3)
    n = n.withColumn("upper", upper).withColumn("lower", F.least(F.lit(8), S("upper")))
    grid = n.select("side", "n", "lower", "upper", F.explode(F.expr(f"sequence(0, {TAIL_COUNTS - 1})")).alias("j"))
    grid = grid.select("side", "n", F.round(S("lower") * F.pow(S("upper") / S("lower"), S("j") / (TAIL_COUNTS - 1))).cast("int").alias("k")).distinct()
    at = lambda m, c: x.select("side", (S("k") / m).alias("k"), S("loss").alias(c)).filter(S("k") == F.floor("k"))
    p = grid.join(x.select("side", "k", S("loss").alias("x1"), "s1", "s2", "t"), ["side", "k"])
    for m, c in ((2, "x2"), (4, "x4")):
        p = p.join(at(m, c), ["side", "k"], "left")
    m1, m2 = S("s1") / S("k") - S("t"), S("s2") / S("k") - 2 * S("t") * S("s1") / S("k") + S("t") * S("t")
    ratio = (S("x1") - S("x2")) / (S("x2") - S("x4"))
    return p.select("side", S("k").cast("long").alias("k"), m1.alias("hill"), (m1 + 1 - 0.5 / (1 - m1 * m1 / m2)).alias("dedh"), F.when(ratio > 0, F.log2(ratio)).alias("pickands"))


def evi_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Hill, moment and Pickands estimates of the extreme-value index by tail count."""
    return _tail_paths(spark, sf).select("side", "k", r("hill", 5).alias("hill"), r("dedh", 5).alias("dedh"), r("pickands", 5).alias("pickands"))


def evi_stable_window(spark: SparkSession, sf: str) -> DataFrame:
    """By side and method: the four neighbouring tail counts with the least spread and curvature, and the estimate there."""
    p = _tail_paths(spark, sf).selectExpr("side", "k", "stack(3, 'dedh', dedh, 'hill', hill, 'pickands', pickands) as (method, xi)").filter("xi is not null and not isnan(xi)")
    w = Window.partitionBy("side", "method").orderBy("k")
    ks = [S("k"), *[F.lead("k", j).over(w) for j in (1, 2, 3)]]
    vs = [S("xi"), *[F.lead("xi", j).over(w) for j in (1, 2, 3)]]
    p = p.select("side", "method", "k", "xi", *[c.alias(f"k{j}") for j, c in enumerate(ks)], *[c.alias(f"v{j}") for j, c in enumerate(vs)])
    mean = (S("v0") + S("v1") + S("v2") + S("v3")) / 4
    spread = sum(((S(f"v{j}") - mean) * (S(f"v{j}") - mean) for j in range(4)), F.lit(0.0)) / 4
    bend = (F.abs(S("v2") - 2 * S("v1") + S("v0")) + F.abs(S("v3") - 2 * S("v2") + S("v1"))) / 2
    best = p.filter("k3 is not null").groupBy("side", "method").agg(F.min_by(F.struct("k0", "k3", F.bround((S("k1") + S("k2")) / 2).alias("mid")), F.struct(spread + 0.5 * bend, "k0")).alias("b"))
    near = p.select("side", "method", "k", "xi").join(best, ["side", "method"]).groupBy("side", "method").agg(F.min_by(F.struct("k", "xi"), F.struct(F.abs(S("k") - S("b.mid")), "k")).alias("c"), F.first("b").alias("b"))
    return near.select("side", "method", S("b.k0").alias("from_k"), S("b.k3").alias("to_k"), S("c.k").alias("selected_k"), r("c.xi", 5).alias("xi"))


Q = {f.__name__: f for f in (
    calendar_mapping, close_alignment, last_bar_at_close, fx_last_positive, forward_filled_diffs, roll_sq_window, calendar_horizon, event_stamps,
    option_bucket_iv, option_empty_days, option_dte_scope, compat_volume_surge, row_window_returns, lagged_summaries, aggregate_stamp, bronze_projection,
    feature_catalog, evi_paths, evi_stable_window,
)}

D = "CAST(d AS VARCHAR) AS d"
NOON = "CAST(d AS TIMESTAMP) + INTERVAL 12 HOUR"
PATHS = f"""{V.LOSSES}, x AS (SELECT side, loss, ln(loss) AS l, row_number() OVER w AS k, sum(ln(loss)) OVER w AS s1, sum(ln(loss) * ln(loss)) OVER w AS s2, lead(ln(loss)) OVER w AS t
  FROM losses WHERE loss > 0 WINDOW w AS (PARTITION BY side ORDER BY loss DESC, d)),
n AS (SELECT side, max(k) AS n, least(greatest(10, floor(max(k) * 0.25)), max(k) - 3) AS hi FROM x GROUP BY side),
grid AS (SELECT DISTINCT side, CAST(round(least(8, hi) * pow(hi / least(8, hi), j / {TAIL_COUNTS - 1}.0)) AS BIGINT) AS k FROM n, range({TAIL_COUNTS}) g(j)),
m AS (SELECT g.side, g.k, x.s1 / g.k - x.t AS m1, x.s2 / g.k - 2 * x.t * x.s1 / g.k + x.t * x.t AS m2, (x.loss - b.loss) / (b.loss - c.loss) AS q
  FROM grid g JOIN x ON x.side = g.side AND x.k = g.k LEFT JOIN x b ON b.side = g.side AND b.k = 2 * g.k LEFT JOIN x c ON c.side = g.side AND c.k = 4 * g.k),
paths AS (SELECT side, k, m1 AS hill, m1 + 1 - 0.5 / (1 - m1 * m1 / m2) AS dedh, CASE WHEN q > 0 THEN log2(q) END AS pickands FROM m)"""
SQL = {
    "calendar_mapping": f"""WITH o AS (SELECT CAST(o_orderdate AS DATE) AS d, bool_or(o_orderpriority = '1-URGENT') AS us, bool_or(o_orderpriority = '2-HIGH') AS jp FROM orders GROUP BY 1),
      days AS (SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM o),
      c AS (SELECT days.d, coalesce(us, FALSE) AS us, coalesce(jp, FALSE) AS jp, dayofweek(days.d) BETWEEN 1 AND 5 AS wd FROM days LEFT JOIN o USING (d)),
      e AS (SELECT *, max(CASE WHEN us THEN d END) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_us FROM c)
      SELECT {D}, us, jp, wd AND NOT us AS us_weekday_holiday,
        CASE WHEN NOT us AND NOT jp THEN 'unmapped' WHEN last_us IS NULL THEN 'us_holiday' WHEN jp AND NOT wd THEN 'holiday_trading' WHEN NOT us THEN 'us_holiday' WHEN NOT jp THEN 'desync' WHEN d - last_us > 4 THEN 'desync' ELSE 'normal' END AS status,
        CASE WHEN NOT us AND NOT jp THEN 'missing_time_alignment' WHEN last_us IS NULL THEN 'no_us_close_before_target_open' WHEN jp AND NOT wd THEN 'no_day_open' WHEN NOT us THEN 'us_closed_jp_open' WHEN NOT jp THEN 'us_open_jp_closed' WHEN d - last_us > 4 THEN 'stale_us_close' END AS reason FROM e""",
    "close_alignment": f"""WITH {V.DAILY}, c AS (SELECT d, day(d) = 24 AS early,
        timezone('UTC', timezone('America/New_York', CAST(d AS TIMESTAMP) + CASE WHEN day(d) = 24 THEN INTERVAL '13 hours' WHEN day(d) = 10 THEN INTERVAL '15 hours 30 minutes' ELSE INTERVAL '16 hours' END)) AS us,
        timezone('UTC', timezone('Asia/Tokyo', CAST(d + 1 AS TIMESTAMP) + CASE WHEN day(d) = 11 THEN INTERVAL '4 hours' ELSE INTERVAL '6 hours' END)) AS night,
        CASE WHEN date_diff('minute', timezone('UTC', timezone('America/New_York', {NOON})), {NOON}) = -240 THEN 'EDT' ELSE 'EST' END AS regime FROM daily),
      m AS (SELECT *, date_diff('minute', us, night) AS minutes FROM c)
      SELECT {D}, regime, early, minutes, abs(minutes - CASE WHEN early THEN CASE regime WHEN 'EST' THEN 180 ELSE 240 END ELSE CASE regime WHEN 'EST' THEN 0 ELSE 60 END END) <= 5 AS aligned,
        CASE WHEN minutes = 0 THEN 'coincident' WHEN minutes > 0 THEN 'night_absorption' ELSE 'after_night_close' END AS absorption, strftime(us - INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS calendar_available FROM m""",
    "last_bar_at_close": f"""WITH {V.MINUTES}, g AS (SELECT DISTINCT ticker, d FROM minutes),
      b AS (SELECT * FROM minutes WHERE hour(ts) >= 9 AND ts <= CAST(d AS TIMESTAMP) + CASE WHEN day(d) = 24 THEN INTERVAL 13 HOUR ELSE INTERVAL 16 HOUR END QUALIFY row_number() OVER (PARTITION BY ticker, d ORDER BY ts DESC, id DESC) = 1)
      SELECT ticker, {D}, strftime(ts, '%Y-%m-%d %H:%M:%S') AS bar_ts, round(close, 6) AS close, CASE WHEN ts IS NULL THEN 'missing_regular_bar' ELSE 'last_regular_bar' END AS reason FROM g LEFT JOIN b USING (ticker, d)""",
    "fx_last_positive": f"""WITH {V.MACRO}, m AS (SELECT week, CASE WHEN weekofyear(week) % 5 = 0 THEN -level WHEN weekofyear(week) % 7 <> 0 THEN level END AS value FROM macro)
      SELECT CAST(week AS VARCHAR) AS week, round(value, 2) AS value, round(CASE WHEN value > 0 THEN ln(value) END - ln(last_value(CASE WHEN value > 0 THEN value END IGNORE NULLS) OVER (ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 6) AS ret FROM m""",
    "forward_filled_diffs": f"""WITH {V.MACRO}, m AS (SELECT *, level - lag(level) OVER (ORDER BY week) AS diff FROM macro),
      j AS (SELECT daily.d, CASE WHEN date_diff('day', week, daily.d) <= 20 THEN week END AS week, m.level, m.diff FROM daily ASOF LEFT JOIN m ON daily.d >= m.available),
      c AS (SELECT d, CASE WHEN week IS NOT NULL THEN level END AS level, CASE WHEN week IS NOT NULL THEN diff END AS diff, coalesce(week = lag(week) OVER (ORDER BY d), FALSE) AS carried FROM j)
      SELECT {D}, round(level, 2) AS level, round(CASE WHEN carried THEN 0.0 ELSE diff END, 2) AS diff, carried AS is_filled FROM c""",
    "roll_sq_window": f"WITH {panel.CONTRACTS} SELECT {D}, EXISTS (SELECT 1 FROM contracts c WHERE c.roll_start <= daily.d AND daily.d <= c.sq) AS in_window FROM daily",
    "calendar_horizon": f"WITH {panel.CONTRACTS} SELECT CAST(greatest(max(greatest(last_trade, sq)), DATE '1998-01-01') AS VARCHAR) AS horizon, count(*) AS contracts FROM contracts",
    "event_stamps": f"""WITH e AS (SELECT CAST(ts AS DATE) AS d, ts, event_type FROM events),
      p AS (SELECT d, min(ts) FILTER (WHERE event_type = 'purchase' AND ts <= {NOON}) AS us, min(ts + INTERVAL 3 HOUR) FILTER (WHERE event_type = 'view' AND ts + INTERVAL 3 HOUR <= {NOON}) AS ose FROM e GROUP BY d)
      SELECT {D}, CASE WHEN us IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS us_session, strftime(coalesce(us, {NOON}), '%Y-%m-%d %H:%M:%S') AS us_available,
        CASE WHEN ose IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS ose_session, strftime(coalesce(ose, {NOON}), '%Y-%m-%d %H:%M:%S') AS ose_available FROM p""",
    "option_bucket_iv": f"""WITH {V.SURFACE}, c AS (SELECT *, CASE WHEN dte BETWEEN 15 AND 30 THEN 'short' WHEN dte BETWEEN 45 AND 90 THEN 'medium' END AS bucket FROM surface WHERE pc IS NOT NULL AND oi > 30000 AND strike > 0),
      b AS (SELECT d, bucket, pc, iv, count(*) OVER (PARTITION BY d, bucket, pc) AS n FROM c WHERE bucket IS NOT NULL QUALIFY row_number() OVER (PARTITION BY d, bucket, pc ORDER BY abs(ln(strike / spot)), dte, contract, okey, iv) = 1),
      o AS (SELECT d, avg(iv) FILTER (WHERE bucket = 'short') AS s, avg(iv) FILTER (WHERE bucket = 'medium') AS m, coalesce(sum(n) FILTER (WHERE bucket = 'short'), 0) AS sn, coalesce(sum(n) FILTER (WHERE bucket = 'medium'), 0) AS mn FROM b GROUP BY d)
      SELECT {D}, round(s, 6) AS short_iv, round(m, 6) AS medium_iv, round(m - s, 6) + 0.0 AS term_slope, CAST(sn AS BIGINT) AS short_contracts, CAST(mn AS BIGINT) AS medium_contracts FROM o""",
    "option_empty_days": f"""WITH {V.SURFACE}, days AS (SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM li), p AS (SELECT d, count(*) AS n, avg(iv) AS iv FROM surface WHERE pc = 'put' AND strike > 48 GROUP BY d)
      SELECT CAST(days.d AS VARCHAR) AS d, coalesce(n, 0) AS contracts, round(iv, 6) AS iv FROM days LEFT JOIN p ON p.d = days.d""",
    "option_dte_scope": f"""WITH {V.SURFACE}, c AS (SELECT d, count(*) FILTER (WHERE contract % 10 = 0) AS k, count(*) AS n, avg(iv) FILTER (WHERE contract % 10 = 0) AS x, avg(iv) AS y FROM surface WHERE dte BETWEEN 15 AND 60 GROUP BY d)
      SELECT {D}, CASE WHEN k > 0 THEN 'central' ELSE 'all' END AS scope, CASE WHEN k > 0 THEN k ELSE n END AS contracts, round(CASE WHEN k > 0 THEN x ELSE y END, 6) AS iv FROM c""",
    "compat_volume_surge": f"""WITH {V.DAILY}, v AS (SELECT d, CASE WHEN day(d) % 6 <> 0 THEN n END AS volume FROM daily),
      k AS (SELECT d, volume / avg(volume) OVER (ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS surge FROM v WHERE volume IS NOT NULL)
      SELECT CAST(v.d AS VARCHAR) AS d, volume, round(surge, 6) AS surge FROM v LEFT JOIN k ON k.d = v.d""",
    "row_window_returns": f"""WITH {V.MINUTES}, k AS (SELECT *, row_number() OVER (PARTITION BY ticker, d ORDER BY ts DESC, id DESC) AS k FROM minutes),
      c AS (SELECT ticker, d, max(close) FILTER (WHERE k = 1) AS c1, max(close) FILTER (WHERE k = 5) AS c5, max(close) FILTER (WHERE k = 15) AS c15 FROM k GROUP BY 1, 2)
      SELECT ticker, {D}, round(CASE WHEN c1 > 0 AND c5 > 0 THEN ln(c1) - ln(c5) END, 6) AS return_5, round(CASE WHEN c1 > 0 AND c15 > 0 THEN ln(c1) - ln(c15) END, 6) AS return_15 FROM c""",
    "lagged_summaries": f"""WITH {V.DAILY}, s AS (SELECT *, d + CASE WHEN day(d) % 9 = 0 THEN 3 ELSE 1 END AS available FROM daily),
      j AS (SELECT a.d, b.d AS e, b.lv, b.n, row_number() OVER (PARTITION BY a.d ORDER BY b.d DESC) AS k FROM s a JOIN s b ON b.d < a.d AND b.d >= a.d - {LOOKBACK_DAYS} AND b.available <= a.d),
      t AS (SELECT d, max(e) FILTER (WHERE k = 1) AS e, max(n) FILTER (WHERE k = 1) AS n, max(lv) FILTER (WHERE k = 1) AS lv, max(lv) FILTER (WHERE k = 2) AS lv2 FROM j GROUP BY d)
      SELECT CAST(s.d AS VARCHAR) AS d, CAST(e AS VARCHAR) AS source, round(ln(1 + t.n), 6) AS count_log1p, round(t.n / t.lv * 100000, 6) AS count_ratio, round(t.lv - lv2, 2) AS lv_change FROM s LEFT JOIN t ON t.d = s.d""",
    "aggregate_stamp": f"""WITH {panel.FEATURES} SELECT {D}, count(*) AS components, round(CASE WHEN count(*) >= 3 THEN avg(value) END, 5) AS mean, CAST(max(available) AS VARCHAR) AS available
      FROM features WHERE feature LIKE 'bar\\_%' ESCAPE '\\' AND value IS NOT NULL GROUP BY d""",
    "bronze_projection": """WITH t AS (SELECT l_linenumber, coalesce(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END, l_quantity) AS open, CASE WHEN l_linenumber % 3 <> 0 THEN l_tax END AS iv FROM lineitem)
      SELECT CAST(l_linenumber AS BIGINT) AS line, count(open) AS opens, count(iv) AS ivs, round(CAST(sum(open) AS DOUBLE), 2) AS open_sum, round(CAST(sum(iv) AS DOUBLE), 2) AS iv_sum FROM t GROUP BY 1""",
    "feature_catalog": f"""WITH n AS (SELECT lower(replace(n_name, ' ', '_')) || ({SUFFIXES})[n_nationkey % {len(SUFFIXES)} + 1] AS name FROM nation),
      f AS (SELECT name, NOT contains(name, '__') AND regexp_matches(name, '{FEATURE_NAME}') AS ok FROM n)
      SELECT name, ok AS is_feature, CASE WHEN ok THEN {" ".join(["CASE", *[f"WHEN regexp_matches(name, '{p}') THEN '{m}'" for p, m in MEANINGS], "ELSE 'other' END"])} || ' of ' || split_part(name, '_', 1) END AS description FROM f""",
    "evi_paths": f"WITH {PATHS} SELECT side, k, round(hill, 5) AS hill, round(dedh, 5) AS dedh, round(pickands, 5) AS pickands FROM paths",
    "evi_stable_window": f"""WITH {PATHS}, l AS (SELECT side, k, unnest(['dedh', 'hill', 'pickands']) AS method, unnest([dedh, hill, pickands]) AS xi FROM paths), p AS (SELECT * FROM l WHERE xi IS NOT NULL AND NOT isnan(xi)),
      v AS (SELECT side, method, k AS k0, lead(k, 1) OVER w AS k1, lead(k, 2) OVER w AS k2, lead(k, 3) OVER w AS k3, xi AS v0, lead(xi, 1) OVER w AS v1, lead(xi, 2) OVER w AS v2, lead(xi, 3) OVER w AS v3 FROM p WINDOW w AS (PARTITION BY side, method ORDER BY k)),
      s AS (SELECT side, method, k0, k3, round_even((k1 + k2) / 2, 0) AS mid FROM v WHERE k3 IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY side, method ORDER BY list_var_pop([v0, v1, v2, v3]) + 0.25 * (abs(v2 - 2 * v1 + v0) + abs(v3 - 2 * v2 + v1)), k0) = 1)
      SELECT side, method, k0 AS from_k, k3 AS to_k, k AS selected_k, round(xi, 5) AS xi FROM p JOIN s USING (side, method) QUALIFY row_number() OVER (PARTITION BY side, method ORDER BY abs(k - mid), k) = 1""",
}
