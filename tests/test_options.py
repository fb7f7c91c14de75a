from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.sources import options as O

DAY, NOW = dt.date(2020, 1, 6), dt.datetime(2020, 2, 1)


def bronze(spark, rows, schema):
    return O.bronze(spark.createDataFrame(rows, schema), DAY, "/x", NOW)


def test_bronze_takes_the_long_header_where_the_short_one_is_blank(spark):
    rows = [("1.5", "9", "", "7"), (" ", "9", "-", "7"), (None, None, "NaN", None)]
    out = bronze(spark, rows, "O string, WholeDayOpen string, IV string, ImpliedVolatility string").select("O", "IV", "Date", "H").collect()
    assert [tuple(r) for r in out] == [(1.5, 7.0, "2020-01-06", None), (9.0, None, "2020-01-06", None), (None, None, "2020-01-06", None)]


def test_bronze_has_every_field_whatever_the_headers(spark):
    out = bronze(spark, [("a",)], "other string")
    assert set(O.NUMBERS) | set(O.TEXTS) <= set(out.columns) and out.count() == 1
    assert len(O.NUMBERS) == 23


def test_silver_scales_and_decodes(spark):
    rows = [("2020-01-06", "1", "20", "1.5", "100", "1"), ("2020-01-07", "2", "0.2", "0", "0", "TRUE"), ("2020-01-08", "3", "-1", None, "-5", "x"), ("no day", "1", "20", "1", "1", "0")]
    out = O.silver(bronze(spark, rows, "Date string, PCDiv string, IV string, IR string, EO string, CCMFlag string")).orderBy("trading_date").collect()
    assert [(r.put_call, r.implied_volatility, r.interest_rate, r.night_open, r.central_month) for r in out] == [
        ("put", 0.2, 0.015, 100.0, True), ("call", 0.2, None, None, True), (None, None, None, None, None),
    ]
    assert out[0].available == dt.datetime(2020, 1, 6, 18)  # three in the morning of the next day in Tokyo


@pytest.mark.parametrize(("prices", "valid"), [((2, 3, 1, 2), True), ((2, 1, 3, 2), False), ((0, 3, 1, 2), False), ((None, 3, 1, 2), False)])
def test_valid_night(spark, prices, valid):
    df = spark.createDataFrame([tuple(None if p is None else float(p) for p in prices)], "night_open double, night_high double, night_low double, night_close double")
    assert df.select(O.valid_night()).first()[0] is valid


def test_feature_map_takes_what_is_known_last(spark):
    rows = [("a", dt.datetime(2020, 1, 1, 5), 1.0, 9), ("a", dt.datetime(2020, 1, 1, 7), None, 8), ("b", None, 2.0, 7), (None, NOW, 3.0, 6)]
    df = spark.createDataFrame(rows, "d string, t timestamp, option_x double, other int")
    out = {(r.day, r.feature): (r.value, r.source_date) for r in O.feature_map(df, "d", "t", "option_").collect()}
    assert out == {("a", "option_x"): (None, "a"), ("b", "option_x"): (2.0, "b")}
    assert O.feature_map(df.limit(0), "d", "t", "option_").count() == 0


def test_symbol_map_knows_the_symbol_in_any_case(spark):
    df = spark.createDataFrame([("vix", "a", NOW, 1.0, 2.0), ("other", "a", NOW, 5.0, 6.0)], "s string, d string, t timestamp, close double, range double")
    out = {(r.feature, r.value) for r in O.symbol_map(df, "s", "VIX", "d", "t", {"index_close": "close", "index_range": "range"}).collect()}
    assert out == {("index_close", 1.0), ("index_range", 2.0)}


def test_daily_state_of_a_day_without_calls(spark):
    out = O.daily_state(O.silver(bronze(spark, [("2020-01-06", "1", "5")], "Date string, PCDiv string, OI string")))
    row = out.withColumn("n", F.lit(1)).first()
    assert row.option_put_call_interest is None and row.option_night_share == 0.0 and row.option_weighted_iv is None


def test_numbers_are_cast_once_and_only_where_they_have_a_digit(spark):
    """Typed rows of bronze rows read the doubles as they are; before, each passed through text again and its cast stood many times in the plan."""
    raw = spark.createDataFrame([("2020-01-06", "5"), ("2020-01-07", "-"), ("2020-01-08", "Infinity"), ("2020-01-09", "1e2")], "Date string, IV string")
    typed = O.silver(O.bronze(raw, DAY, "/x", NOW)).select("trading_date", "implied_volatility")
    plan = typed._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("as double") == 1 and plan.count("rlike") == 1
    assert [r[1] for r in typed.orderBy("trading_date").collect()] == [0.05, None, None, 1.0]
