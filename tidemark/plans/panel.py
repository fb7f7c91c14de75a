"""Queries over bars, as-of joins, calendars and panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import rolling as R
from ..operators.asof import asof_join, asof_long, previous_of
from ..operators.calendar import business_days, contract_table, h10_release, session_calendar
from ..operators.quality import coverage, duplicate_keys, leakage_audit, ohlc_flags, unpivot_features
from . import views as V

S = F.col


def r(c: str | F.Column, n: int = 6) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def text(c: str) -> F.Column:
    return F.col(c).cast("string")


def daily_gap_losses(spark: SparkSession, sf: str) -> DataFrame:
    return V.losses(spark, sf).select(text("d").alias("d"), "side", r("loss").alias("loss"))


def bars_ohlc_flags(spark: SparkSession, sf: str) -> DataFrame:
    out = ohlc_flags(V.bars(spark, sf))
    return out.select("ticker", text("d").alias("d"), "open", "high", "low", "close", S("volume").cast("long").alias("volume"), "invalid_price", "ohlc_violation")


def log_return_range_by_ticker(spark: SparkSession, sf: str) -> DataFrame:
    w = R.series(["ticker"], "d")
    out = V.bars(spark, sf).withColumn("prev", R.last_known("close", w))
    return out.select("ticker", text("d").alias("d"), r(X.log_return(S("prev"), S("close"))).alias("ret"), r(X.log_return(S("low"), S("high"))).alias("log_range"))


def diff_vs_last_nonnull(spark: SparkSession, sf: str) -> DataFrame:
    w = R.series([], "week")
    m = V.macro(spark, sf).withColumn("x", F.when(F.dayofyear("week") % 5 != 0, S("level")))
    return m.select(text("week").alias("week"), r("x", 2).alias("x"), r(S("x") - R.last_known("x", w), 2).alias("diff"))


def asof_record_tolerance(spark: SparkSession, sf: str) -> DataFrame:
    m = V.macro(spark, sf).withColumn("x", F.when(F.dayofyear("week") % 5 != 0, S("level")))
    out = asof_join(V.daily(spark, sf).select("d"), m, "d", "week", columns=["x", "week"], available="available", tolerance_days=9, suffix="_asof")
    fill = F.when(S("week_asof").isNull(), "missing").when(S("x_asof").isNull(), "null_record").otherwise("carried")
    return out.select(text("d").alias("d"), r("x_asof", 2).alias("x"), text("week_asof").alias("source_week"), fill.alias("fill_method"))


def asof_per_feature(spark: SparkSession, sf: str) -> DataFrame:
    m = V.macro(spark, sf)
    f = m.selectExpr("week as source_time", "available", "stack(2, 'level', if(dayofyear(week) % 5 != 0, level, null), 'log_level', if(dayofyear(week) % 3 != 0, ln(level), null)) as (feature, value)")
    out = asof_long(V.daily(spark, sf).select("d"), f, "d", available="available", tolerance_days=30)
    return out.select(text("d").alias("d"), "feature", r("value").alias("value"), text("source_time").alias("source_time"))


def asof_strict_latest_close(spark: SparkSession, sf: str) -> DataFrame:
    e = V.table(spark, sf, "events").select("event_id", "user_id", S("ts").cast("timestamp").alias("ts"), "event_type", "value")
    seen = e.filter("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("view_value"))
    out = asof_join(e.filter("event_type = 'purchase'"), seen, "ts", "ts", ["user_id"], ["view_value"], strict=True, bucket="day")
    return out.select("event_id", "user_id", r("value").alias("value"), r("view_value").alias("view_value"))


def asof_release_age_cap(spark: SparkSession, sf: str) -> DataFrame:
    m = V.macro(spark, sf)
    out = asof_join(V.daily(spark, sf).select("d"), m, "d", "week", columns=["level", "available"], available="available", suffix="_fx")
    age = F.greatest(F.lit(0), F.date_diff("d", "available_fx"))
    ok = age <= 4
    reason = F.when(S("level_fx").isNull(), "no_release").when(~ok, "stale_release").otherwise("ok")
    return out.select(text("d").alias("d"), r(F.when(ok, S("level_fx")), 2).alias("level"), age.cast("long").alias("release_age"), reason.alias("reason"))


def previous_same_contract(spark: SparkSession, sf: str) -> DataFrame:
    b = previous_of(V.bars(spark, sf), ["ticker"], "d", ["d", "close"])
    sessions = previous_of(V.daily(spark, sf).select("d"), [], "d", ["d"]).select("d", S("prev_d").alias("session"))
    out = b.join(sessions, "d")
    return out.select("ticker", text("d").alias("d"), F.when(S("prev_d") == S("session"), S("prev_close")).alias("prev_close"), F.coalesce(S("prev_d") == S("session"), F.lit(False)).alias("adjacent"))


def target_missing_reasons(spark: SparkSession, sf: str) -> DataFrame:
    b = previous_of(V.bars(spark, sf), ["ticker"], "d", ["d", "close", "volume"])
    reasons = F.array_compact(F.array(
        F.when(S("prev_close").isNull(), "no_previous_row"),
        F.when(F.date_diff("d", "prev_d") > 1, "session_gap"),
        F.when(S("volume") < 2, "low_volume"),
        F.when(S("volume") > 3 * S("prev_volume"), "volume_jump"),
    ))
    first = F.when(S("prev_close").isNull(), "no_history").when(F.date_diff("d", "prev_d") > 3, "join_miss").when(S("volume") < 2, "not_clean").otherwise("ok")
    return b.select("ticker", text("d").alias("d"), F.array_join(reasons, ";").alias("missing_reasons"), first.alias("sample_reason"))


def key_violations(spark: SparkSession, sf: str) -> DataFrame:
    return duplicate_keys(V.table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey"]).select("l_orderkey", "l_partkey", S("count").alias("n"))


def calendar_dense_flags(spark: SparkSession, sf: str) -> DataFrame:
    out = session_calendar(V.daily(spark, sf).select("d"))
    return out.select(text("d").alias("d"), "is_session", "holiday_adjacent", "is_dst", "regime", text("month_start").alias("month_start"), text("last_friday").alias("last_friday"))


def contract_roll_table(spark: SparkSession, sf: str) -> DataFrame:
    out = contract_table(V.daily(spark, sf).select("d"), roll_sessions=3)
    return out.select(text("month").alias("month"), text("sq").alias("sq"), text("last_trade").alias("last_trade"), text("roll_start").alias("roll_start"))


def central_contract(spark: SparkSession, sf: str) -> DataFrame:
    days = V.daily(spark, sf).select("d")
    c = contract_table(days, roll_sessions=3).filter("last_trade is not null")
    # the front contract is the nearest one that still trades; from its roll start on, the next one
    near = days.join(c, (S("last_trade") >= S("d")) & (F.date_diff("last_trade", "d") <= 80))
    rank = F.row_number().over(Window.partitionBy("d").orderBy("last_trade"))
    two = near.withColumn("k", rank).filter("k <= 2").groupBy("d").agg(F.min_by("month", "k").alias("front"), F.min_by("roll_start", "k").alias("roll"), F.max_by("month", "k").alias("second"))
    return two.select(text("d").alias("d"), text("front").alias("front"), F.when(S("d") >= S("roll"), S("second")).otherwise(S("front")).cast("string").alias("central"))


def h10_release_calendar(spark: SparkSession, sf: str) -> DataFrame:
    days = V.daily(spark, sf).select("d")
    out = h10_release(business_days(days, 2), "d")
    return out.select(text("d").alias("d"), text("plus_2").alias("plus_2"), F.date_format("release_utc", "yyyy-MM-dd HH:mm:ss").alias("release_utc"))


def opra_ticker_parse(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.normalize import parse_option_ticker

    p = V.table(spark, sf, "part")
    made = F.concat(F.lit("O:"), F.element_at(F.array(*[F.lit(u) for u in ("SPY", "SP", "EWJ")]), (S("p_partkey") % 3 + 1).cast("int")), F.lit("2"), F.lpad((S("p_size") % 7).cast("string"), 1, "0"), F.lit("0"), (S("p_size") % 9 + 1).cast("string"), F.lit("15"), F.when(S("p_partkey") % 2 == 0, "C").otherwise("P"), F.lpad((S("p_partkey") * 500).cast("string"), 8, "0"))
    out = parse_option_ticker(p.select("p_partkey", made.alias("ticker")), "ticker", ["SPY", "SP", "EWJ"])
    return out.select("p_partkey", "ticker", "underlying", text("expiry").alias("expiry"), "kind", S("strike").cast("double").alias("strike"), F.date_diff("expiry", F.lit("2020-01-01").cast("date")).cast("long").alias("dte"))


def _features(spark: SparkSession, sf: str) -> DataFrame:
    """d, cutoff, feature, value, available: a long panel of three sources."""
    w = R.series(["ticker"], "d")
    b = V.bars(spark, sf).withColumn("v", X.log_return(R.last_known("close", w), S("close"))).select("d", F.concat(F.lit("bar_"), X.safe_name(S("ticker"))).alias("feature"), S("v").alias("value"), S("d").alias("available"))
    m = asof_join(V.daily(spark, sf).select("d"), V.macro(spark, sf), "d", "week", columns=["level", "available"], available="available", tolerance_days=20, suffix="")
    # whole hundredths: their mean does not depend on the order of summation
    li = V.table(spark, sf, "lineitem").select(V.day("l_shipdate").alias("d"), F.round(S("l_discount") * 100).cast("long").alias("iv"))
    s = li.groupBy("d").agg((F.sum("iv") / (F.count("iv") * 100)).alias("value"))
    out = b.unionByName(m.select("d", F.lit("macro_level").alias("feature"), S("level").alias("value"), "available"))
    out = out.unionByName(V.daily(spark, sf).select("d").join(s, "d", "left").select("d", F.lit("option_iv").alias("feature"), "value", F.date_add("d", 1).alias("available")))
    return out.withColumn("cutoff", S("d"))


def pit_panel_long(spark: SparkSession, sf: str) -> DataFrame:
    return _features(spark, sf).select(text("d").alias("d"), "feature", r("value", 10).alias("value"), text("available").alias("available"))


def pit_panel_wide(spark: SparkSession, sf: str) -> DataFrame:
    """The panel by day: values known after the day's cutoff never enter; options of a day are known on the next."""
    f = _features(spark, sf)
    macro = f.filter("feature = 'macro_level' and available <= cutoff").select("d", S("value").alias("macro_level"))
    options = f.filter("feature = 'option_iv' and value is not null").select(S("d").alias("day"), S("value").alias("option_iv"), "available")
    out = asof_join(V.gaps(spark, sf).join(macro, "d", "left"), options, "d", "day", columns=["option_iv", "available"], available="available")
    clean = S("gap").isNotNull() & (S("d") >= F.lit("1996-01-01").cast("date"))
    return out.select(text("d").alias("d"), r("gap").alias("gap"), r("macro_level", 8).alias("macro_level"), r("option_iv", 10).alias("option_iv"), text("available").alias("option_available"), F.coalesce(clean, F.lit(False)).alias("forecast_sample"))


def feature_coverage(spark: SparkSession, sf: str) -> DataFrame:
    days = V.daily(spark, sf).count()
    out = coverage(_features(spark, sf), "feature", "d", "value", days)
    source = F.when(S("feature").startswith("bar_"), "bars").when(S("feature").startswith("macro_"), "macro").otherwise("options")
    return out.select("feature", source.alias("source"), "non_missing", r("missing_rate").alias("missing_rate"), text("first_valid").alias("first_valid"), text("last_valid").alias("last_valid"))


def effective_start(spark: SparkSession, sf: str) -> DataFrame:
    c = feature_coverage(spark, sf)
    return c.groupBy("source").agg(F.max("first_valid").alias("start"), F.count("*").alias("features"))


def field_coverage_policy(spark: SparkSession, sf: str) -> DataFrame:
    b = V.bars(spark, sf).withColumn("sample", F.when(S("d") < F.lit("1998-01-01").cast("date"), "before").otherwise("after"))
    b = b.withColumn("high", F.when(S("volume") > 1, S("high")))
    long = unpivot_features(b, ["sample", "ticker", "d"], ["open", "high", "close"])
    out = long.groupBy("sample", "feature").agg(F.count("*").alias("n"), F.count("value").alias("present"), F.count_if(S("value") <= 0).alias("zero_or_less"))
    return out.select("sample", "feature", "n", "present", "zero_or_less", (S("present") >= 0.95 * S("n")).alias("passes"))


def leakage(spark: SparkSession, sf: str) -> DataFrame:
    out = leakage_audit(_features(spark, sf), "value", "available", "cutoff")
    return out.select(text("d").alias("d"), "feature", "status", S("lag_minutes").cast("double").alias("lag_minutes"))


def leakage_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return leakage(spark, sf).groupBy(F.coalesce("status", F.lit("missing")).alias("status")).agg(F.count("*").alias("n"), F.min("d").alias("first_d"), F.max("d").alias("last_d"))


def vix_style_reconciliation(spark: SparkSession, sf: str) -> DataFrame:
    o = V.table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.avg("o_totalprice").alias("a"), F.percentile("o_totalprice", F.lit(0.5)).alias("b"))
    return o.withColumn("gap", F.abs(S("a") - S("b"))).filter("gap > 40000").select(text("d").alias("d"), r("a", 3).alias("a"), r("b", 3).alias("b"), r("gap", 5).alias("gap"))


def training_gate(spark: SparkSession, sf: str) -> DataFrame:
    f = _features(spark, sf)
    g = f.groupBy("feature").agg(F.count("*").alias("rows"), F.count("value").alias("n"), F.stddev_samp("value").alias("sd"))
    limit = F.when(S("feature").startswith("option"), 0.30).when(S("feature").startswith("bar"), 0.05).otherwise(0.20)
    reason = F.when(1 - S("n") / S("rows") > limit, "missingness").when(S("n") < 2, "too_few").when(S("sd") < 1e-6, "low_variance").otherwise("kept")
    return g.select("feature", "n", r(limit, 2).alias("missing_limit"), reason.alias("gate"))


def feature_set_delta(spark: SparkSession, sf: str) -> DataFrame:
    f = _features(spark, sf).filter("value is not null")
    cut = F.lit("1998-01-01").cast("date")
    early = f.filter(S("d") < cut).select("feature").distinct()
    late = f.filter((S("d") >= cut) & ~S("feature").contains("urgent")).select("feature").distinct()
    gone = early.join(late, "feature", "left_anti").withColumn("change", F.lit("removed"))
    new = late.join(early, "feature", "left_anti").withColumn("change", F.lit("added"))
    return gone.unionByName(new).unionByName(early.intersect(late).withColumn("change", F.lit("retained")))


def first_increment_by_feature(spark: SparkSession, sf: str) -> DataFrame:
    blocks = spark.createDataFrame([("A", "bars", 1), ("B", "bars", 2), ("B", "macro", 2), ("C", "bars", 3), ("C", "macro", 3), ("C", "options", 3)], "infoset string, source string, lvl int")
    c = feature_coverage(spark, sf).select("feature", "source")
    return c.join(F.broadcast(blocks), "source").groupBy("feature").agg(F.min_by("infoset", "lvl").alias("first_infoset"), F.count("*").alias("n_infosets"))


Q = {f.__name__: f for f in (
    daily_gap_losses, bars_ohlc_flags, log_return_range_by_ticker, diff_vs_last_nonnull, asof_record_tolerance, asof_per_feature, asof_strict_latest_close,
    asof_release_age_cap, previous_same_contract, target_missing_reasons, key_violations, calendar_dense_flags, contract_roll_table, central_contract, h10_release_calendar,
    opra_ticker_parse, pit_panel_long, pit_panel_wide, feature_coverage, effective_start, field_coverage_policy, leakage_status_counts, vix_style_reconciliation,
    training_gate, feature_set_delta, first_increment_by_feature,
)} | {"leakage_audit": leakage}

PREV = "prev AS (SELECT *, lag(d) OVER w AS prev_d, lag(close) OVER w AS prev_close, lag(volume) OVER w AS prev_volume FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY d))"
RET = "rets AS (SELECT ticker, d, low, high, close, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM bars)"
FEATURES = f"""{V.MACRO}, {V.BARS}, {RET}, {V.SURFACE},
mac AS (SELECT d, CASE WHEN date_diff('day', week, d) <= 20 THEN level END AS value, CASE WHEN date_diff('day', week, d) <= 20 THEN available END AS available
  FROM (SELECT daily.d, m.week, m.level, m.available FROM daily ASOF LEFT JOIN macro m ON daily.d >= m.available)),
features AS (
  SELECT d, 'bar_' || trim(regexp_replace(lower(ticker), '[^a-z0-9]', '_', 'g'), '_') AS feature, ln(close) - ln(prev) AS value, d AS available FROM rets
  UNION ALL SELECT d, 'macro_level', value, available FROM mac
  UNION ALL SELECT daily.d, 'option_iv', o.value, daily.d + 1 FROM daily LEFT JOIN (SELECT d, sum(CAST(round(iv * 100) AS BIGINT)) / (count(iv) * 100) AS value FROM surface GROUP BY d) o ON o.d = daily.d)"""
COVER = f"""{FEATURES}, cover AS (SELECT feature, CASE WHEN feature LIKE 'bar\\_%' ESCAPE '\\' THEN 'bars' WHEN feature LIKE 'macro\\_%' ESCAPE '\\' THEN 'macro' ELSE 'options' END AS source,
  count(value) AS non_missing, round(1 - count(value) / (SELECT count(*) FROM daily), 6) AS missing_rate,
  CAST(min(d) FILTER (WHERE value IS NOT NULL) AS VARCHAR) AS first_valid, CAST(max(d) FILTER (WHERE value IS NOT NULL) AS VARCHAR) AS last_valid FROM features GROUP BY feature)"""
CONTRACTS = f"""{V.DAILY}, months AS (SELECT CAST(unnest(generate_series(date_trunc('month', min(d)), date_trunc('month', max(d)), INTERVAL 1 MONTH)) AS DATE) AS month FROM daily),
sqs AS (SELECT month, month + CAST((5 - dayofweek(month) + 7) % 7 + 7 AS INTEGER) AS sq FROM months),
idx AS (SELECT d, row_number() OVER (ORDER BY d) AS k FROM daily),
last AS (SELECT month, sq, max(d) AS last_trade, max(k) AS k FROM sqs LEFT JOIN idx ON d < sq AND d >= sq - 20 GROUP BY 1, 2),
contracts AS (SELECT month, sq, last_trade, idx.d AS roll_start FROM last LEFT JOIN idx ON idx.k = last.k - 3)"""
SQL = {
    "daily_gap_losses": f"WITH {V.LOSSES} SELECT CAST(d AS VARCHAR) AS d, side, round(loss, 6) AS loss FROM losses",
    "bars_ohlc_flags": f"""WITH {V.BARS} SELECT ticker, CAST(d AS VARCHAR) AS d, open, high, low, close, volume,
      least(open, high, low, close) <= 0 AS invalid_price, high < greatest(open, close, low) OR low > least(open, close, high) AS ohlc_violation FROM bars""",
    "log_return_range_by_ticker": f"WITH {V.BARS}, {RET} SELECT ticker, CAST(d AS VARCHAR) AS d, round(ln(close) - ln(prev), 6) AS ret, round(ln(high) - ln(low), 6) AS log_range FROM rets",
    "diff_vs_last_nonnull": f"""WITH {V.MACRO}, m AS (SELECT week, CASE WHEN dayofyear(week) % 5 <> 0 THEN level END AS x FROM macro)
      SELECT CAST(week AS VARCHAR) AS week, round(x, 2) AS x, round(x - last_value(x IGNORE NULLS) OVER (ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 2) AS diff FROM m""",
    "asof_record_tolerance": f"""WITH {V.MACRO}, m AS (SELECT *, CASE WHEN dayofyear(week) % 5 <> 0 THEN level END AS x FROM macro),
      j AS (SELECT d, week, x, row_number() OVER (PARTITION BY d ORDER BY week DESC) AS k FROM daily LEFT JOIN m ON week <= d AND available <= d),
      t AS (SELECT d, CASE WHEN date_diff('day', week, d) <= 9 THEN week END AS week, CASE WHEN date_diff('day', week, d) <= 9 THEN x END AS x FROM j WHERE k = 1)
      SELECT CAST(d AS VARCHAR) AS d, round(x, 2) AS x, CAST(week AS VARCHAR) AS source_week, CASE WHEN week IS NULL THEN 'missing' WHEN x IS NULL THEN 'null_record' ELSE 'carried' END AS fill_method FROM t""",
    "asof_per_feature": f"""WITH {V.MACRO}, f AS (SELECT week, available, 'level' AS feature, level AS value FROM macro WHERE dayofyear(week) % 5 <> 0
        UNION ALL SELECT week, available, 'log_level', ln(level) FROM macro WHERE dayofyear(week) % 3 <> 0),
      g AS (SELECT d, feature FROM daily, (SELECT DISTINCT feature FROM f)),
      j AS (SELECT g.d, g.feature, week, value, row_number() OVER (PARTITION BY g.d, g.feature ORDER BY week DESC) AS k FROM g LEFT JOIN f ON f.feature = g.feature AND week <= d AND available <= d)
      SELECT CAST(d AS VARCHAR) AS d, feature, CASE WHEN date_diff('day', week, d) <= 30 THEN round(value, 6) END AS value, CASE WHEN date_diff('day', week, d) <= 30 THEN CAST(week AS VARCHAR) END AS source_time FROM j WHERE k = 1""",
    "asof_strict_latest_close": """WITH v AS (SELECT user_id, ts, max(value) AS view_value FROM events WHERE event_type = 'view' GROUP BY 1, 2)
      SELECT event_id, e.user_id, round(value, 6) AS value, round(view_value, 6) AS view_value FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.ts > v.ts""",
    "asof_release_age_cap": f"""WITH {V.MACRO}, j AS (SELECT daily.d, m.level, m.available FROM daily ASOF LEFT JOIN macro m ON daily.d >= m.available)
      SELECT CAST(d AS VARCHAR) AS d, round(CASE WHEN greatest(0, date_diff('day', available, d)) <= 4 THEN level END, 2) AS level,
        CASE WHEN available IS NULL THEN 0 ELSE greatest(0, date_diff('day', available, d)) END AS release_age,
        CASE WHEN level IS NULL THEN 'no_release' WHEN date_diff('day', available, d) > 4 THEN 'stale_release' ELSE 'ok' END AS reason FROM j""",
    "previous_same_contract": f"""WITH {V.DAILY}, {V.BARS}, {PREV}, s AS (SELECT d, lag(d) OVER (ORDER BY d) AS session FROM daily)
      SELECT ticker, CAST(d AS VARCHAR) AS d, CASE WHEN prev_d = session THEN prev_close END AS prev_close, coalesce(prev_d = session, FALSE) AS adjacent FROM prev JOIN s USING (d)""",
    "target_missing_reasons": f"""WITH {V.BARS}, {PREV} SELECT ticker, CAST(d AS VARCHAR) AS d,
        array_to_string(list_filter([CASE WHEN prev_close IS NULL THEN 'no_previous_row' END, CASE WHEN d - prev_d > 1 THEN 'session_gap' END,
          CASE WHEN volume < 2 THEN 'low_volume' END, CASE WHEN volume > 3 * prev_volume THEN 'volume_jump' END], lambda x: x IS NOT NULL), ';') AS missing_reasons,
        CASE WHEN prev_close IS NULL THEN 'no_history' WHEN d - prev_d > 3 THEN 'join_miss' WHEN volume < 2 THEN 'not_clean' ELSE 'ok' END AS sample_reason FROM prev""",
    "key_violations": "SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "calendar_dense_flags": f"""WITH {V.DAILY}, dense AS (SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM daily),
      c AS (SELECT dense.d, daily.d IS NOT NULL AS s FROM dense LEFT JOIN daily ON daily.d = dense.d),
      n AS (SELECT d, s, NOT coalesce(lag(s) OVER (ORDER BY d), TRUE) OR NOT coalesce(lead(s) OVER (ORDER BY d), TRUE) AS adj,
        date_part('timezone', timezone('America/New_York', CAST(d AS TIMESTAMP) + INTERVAL 12 HOUR)) AS z0,
        date_diff('minute', timezone('UTC', timezone('America/New_York', CAST(d AS TIMESTAMP) + INTERVAL 12 HOUR)), CAST(d AS TIMESTAMP) + INTERVAL 12 HOUR) AS o FROM c)
      SELECT CAST(d AS VARCHAR) AS d, s AS is_session, adj AS holiday_adjacent, o = -240 AS is_dst, CASE WHEN o = -240 THEN 'EDT' ELSE 'EST' END AS regime,
        CAST(CAST(date_trunc('month', d) AS DATE) AS VARCHAR) AS month_start, CAST(d - CAST((dayofweek(d) + 1) % 7 + 1 AS INTEGER) AS VARCHAR) AS last_friday FROM n""",
    "contract_roll_table": f"WITH {CONTRACTS} SELECT CAST(month AS VARCHAR) AS month, CAST(sq AS VARCHAR) AS sq, CAST(last_trade AS VARCHAR) AS last_trade, CAST(roll_start AS VARCHAR) AS roll_start FROM contracts",
    "central_contract": f"""WITH {CONTRACTS}, near AS (SELECT d, month, roll_start, row_number() OVER (PARTITION BY d ORDER BY last_trade) AS k FROM daily JOIN contracts ON last_trade >= d AND last_trade - d <= 80),
      two AS (SELECT d, arg_min(month, k) AS front, arg_min(CASE WHEN k = 1 THEN roll_start END, k) FILTER (WHERE k = 1) AS roll, arg_max(month, k) AS second FROM near WHERE k <= 2 GROUP BY d)
      SELECT CAST(d AS VARCHAR) AS d, CAST(front AS VARCHAR) AS front, CAST(CASE WHEN d >= roll THEN second ELSE front END AS VARCHAR) AS central FROM two""",
    "h10_release_calendar": f"""WITH {V.DAILY}, bd AS (SELECT d, row_number() OVER (ORDER BY d) AS k FROM daily WHERE dayofweek(d) BETWEEN 1 AND 5),
      base AS (SELECT daily.d, coalesce(max(bd.k), 0) AS k FROM daily LEFT JOIN bd ON bd.d <= daily.d GROUP BY 1),
      plus AS (SELECT base.d, bd.d AS plus_2 FROM base LEFT JOIN bd ON bd.k = base.k + 2),
      mon AS (SELECT d, plus_2, d + CAST((8 - dayofweek(d)) % 7 + CASE WHEN dayofweek(d) = 1 THEN 7 ELSE 0 END AS INTEGER) AS m FROM plus),
      rel AS (SELECT mon.d, plus_2, min(bd.d) AS r FROM mon LEFT JOIN bd ON bd.d >= m AND bd.d <= m + 10 GROUP BY 1, 2)
      SELECT CAST(d AS VARCHAR) AS d, CAST(plus_2 AS VARCHAR) AS plus_2, strftime(timezone('UTC', timezone('America/New_York', CAST(r AS TIMESTAMP) + INTERVAL '16 hours 15 minutes')), '%Y-%m-%d %H:%M:%S') AS release_utc FROM rel""",
    "opra_ticker_parse": """WITH t AS (SELECT p_partkey, 'O:' || (['SPY', 'SP', 'EWJ'])[p_partkey % 3 + 1] || '2' || (p_size % 7) || '0' || (p_size % 9 + 1) || '15' || CASE WHEN p_partkey % 2 = 0 THEN 'C' ELSE 'P' END || lpad(CAST(p_partkey * 500 AS VARCHAR), 8, '0') AS ticker FROM part),
      x AS (SELECT p_partkey, ticker, regexp_extract(ticker, '^O:(SPY|EWJ|SP)([0-9]{6})([CP])([0-9]{8})$', 1) AS u, regexp_extract(ticker, '^O:(SPY|EWJ|SP)([0-9]{6})([CP])([0-9]{8})$', 2) AS e FROM t)
      SELECT p_partkey, ticker, u AS underlying, CAST(strptime('20' || e, '%Y%m%d')::DATE AS VARCHAR) AS expiry, CASE WHEN ticker[length(ticker) - 8] = 'C' THEN 'call' ELSE 'put' END AS kind,
        CAST(right(ticker, 8) AS DOUBLE) / 1000 AS strike, date_diff('day', DATE '2020-01-01', strptime('20' || e, '%Y%m%d')::DATE) AS dte FROM x""",
    "pit_panel_long": f"WITH {FEATURES} SELECT CAST(d AS VARCHAR) AS d, feature, round(value, 10) AS value, CAST(available AS VARCHAR) AS available FROM features",
    "pit_panel_wide": f"""WITH {FEATURES}, g AS (SELECT *, ln(lv) - ln(lag(lv) OVER (ORDER BY d)) AS gap FROM daily)
      SELECT CAST(g.d AS VARCHAR) AS d, round(gap, 6) AS gap, round(a.value, 8) AS macro_level, round(b.value, 10) AS option_iv, CAST(b.available AS VARCHAR) AS option_available, coalesce(gap IS NOT NULL AND g.d >= DATE '1996-01-01', FALSE) AS forecast_sample
      FROM g ASOF LEFT JOIN (SELECT value, available FROM features WHERE feature = 'option_iv' AND value IS NOT NULL) b ON g.d >= b.available LEFT JOIN features a ON a.d = g.d AND a.feature = 'macro_level'""",
    "feature_coverage": f"WITH {COVER} SELECT * FROM cover",
    "effective_start": f"WITH {COVER} SELECT source, max(first_valid) AS start, count(*) AS features FROM cover GROUP BY source",
    "field_coverage_policy": f"""WITH {V.BARS}, l AS (SELECT CASE WHEN d < DATE '1998-01-01' THEN 'before' ELSE 'after' END AS sample, unnest(['open', 'high', 'close']) AS feature, unnest([open, CASE WHEN volume > 1 THEN high END, close]) AS value FROM bars)
      SELECT sample, feature, count(*) AS n, count(value) AS present, count(*) FILTER (WHERE value <= 0) AS zero_or_less, count(value) >= 0.95 * count(*) AS passes FROM l GROUP BY 1, 2""",
    "leakage_audit": f"""WITH {FEATURES} SELECT CAST(d AS VARCHAR) AS d, feature, CASE WHEN value IS NULL THEN 'warn' WHEN available IS NULL OR available > d THEN 'fail' ELSE 'pass' END AS status,
      CAST(date_diff('minute', available::TIMESTAMP, d::TIMESTAMP) AS DOUBLE) AS lag_minutes FROM features""",
    "leakage_status_counts": f"""WITH {FEATURES}, s AS (SELECT CAST(d AS VARCHAR) AS d, CASE WHEN value IS NULL THEN 'warn' WHEN available IS NULL OR available > d THEN 'fail' ELSE 'pass' END AS status FROM features)
      SELECT status, count(*) AS n, min(d) AS first_d, max(d) AS last_d FROM s GROUP BY 1""",
    "vix_style_reconciliation": """WITH o AS (SELECT CAST(o_orderdate AS DATE) AS d, avg(o_totalprice) AS a, quantile_cont(o_totalprice, 0.5) AS b FROM orders GROUP BY 1)
      SELECT CAST(d AS VARCHAR) AS d, round(a, 3) AS a, round(b, 3) AS b, round(abs(a - b), 5) AS gap FROM o WHERE abs(a - b) > 40000""",
    "training_gate": f"""WITH {FEATURES}, g AS (SELECT feature, count(*) AS rows, count(value) AS n, stddev_samp(value) AS sd, CASE WHEN feature LIKE 'option%' THEN 0.3 WHEN feature LIKE 'bar%' THEN 0.05 ELSE 0.2 END AS lim FROM features GROUP BY 1)
      SELECT feature, n, CAST(round(lim, 2) AS DOUBLE) AS missing_limit, CASE WHEN 1 - n / rows > lim THEN 'missingness' WHEN n < 2 THEN 'too_few' WHEN sd < 1e-6 THEN 'low_variance' ELSE 'kept' END AS gate FROM g""",
    "feature_set_delta": f"""WITH {FEATURES}, e AS (SELECT DISTINCT feature FROM features WHERE value IS NOT NULL AND d < DATE '1998-01-01'),
      l AS (SELECT DISTINCT feature FROM features WHERE value IS NOT NULL AND d >= DATE '1998-01-01' AND feature NOT LIKE '%urgent%')
      SELECT feature, 'removed' AS change FROM e ANTI JOIN l USING (feature) UNION ALL SELECT feature, 'added' FROM l ANTI JOIN e USING (feature) UNION ALL SELECT feature, 'retained' FROM e SEMI JOIN l USING (feature)""",
    "first_increment_by_feature": f"""WITH {COVER}, b(infoset, source, lvl) AS (VALUES ('A', 'bars', 1), ('B', 'bars', 2), ('B', 'macro', 2), ('C', 'bars', 3), ('C', 'macro', 3), ('C', 'options', 3))
      SELECT feature, arg_min(infoset, lvl) AS first_infoset, count(*) AS n_infosets FROM cover JOIN b USING (source) GROUP BY feature""",
}
