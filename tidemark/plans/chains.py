"""Vendor option rows from line items: raw text to typed columns, typed rows by month, daily state and feature maps."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.store import place
from ..sources import lake
from ..sources import options as O
from . import views as V
from .panel import S, r, text

REQUESTED = dt.date(1995, 1, 2)
DOWNLOADED = dt.datetime(2001, 1, 1)
ENDPOINT = "/options/daily"
LINE = ["l_orderkey", "l_linenumber"]
FIRST, LAST = "1996-02-10", "1996-05-20"


def _value(i: int, short: str) -> str:
    """SQL of a field's number as text: volatilities and rates are percents or fractions, night prices may be zero."""
    if short in ("IV", "BaseVol"):
        return "CASE WHEN l_linenumber % 2 = 0 THEN concat('0.', CAST(10 + l_partkey % 80 AS VARCHAR(9))) ELSE CAST(10 + l_partkey % 80 AS VARCHAR(9)) END"
    if short in O.NIGHT.values():
        return f"CAST((l_orderkey + {i}) % 4 * (10 + l_suppkey % 7 + {i % 3}) AS VARCHAR(20))"
    return f"CAST(CAST(floor(l_quantity) AS INTEGER) * {i + 1} + l_linenumber AS VARCHAR(20))"


def _raw_columns() -> list[str]:
    """The same text in Spark and in DuckDB.  By turns a number has its short header, the long one (the short is blank), both
    with different values, a dash in the short one, or neither."""
    turn = lambda i: f"(l_orderkey + l_linenumber + {i}) % 5"
    out = list(LINE)
    for i, (short, long) in enumerate(O.NUMBERS.items()):
        v = _value(i, short)
        out.append(f'CASE {turn(i)} WHEN 0 THEN {v} WHEN 1 THEN \'\' WHEN 2 THEN {v} WHEN 3 THEN \'-\' END AS "{short}"')
        out.append(f'CASE {turn(i)} WHEN 1 THEN {v} WHEN 2 THEN concat({v}, \'1\') WHEN 3 THEN {v} END AS "{long}"')
    day = "CAST(CAST(l_shipdate AS DATE) AS VARCHAR(10))"
    out += [
        f'CASE WHEN l_linenumber = 7 THEN \'\' ELSE {day} END AS "Date"',
        'CAST(l_partkey AS VARCHAR(20)) AS "Code"',
        f'CASE WHEN l_linenumber % 2 = 0 THEN substr({day}, 1, 7) END AS "CM"',
        f'substr({day}, 1, 4) AS "ContractMonth"',
        "CASE l_returnflag WHEN 'R' THEN '1' WHEN 'A' THEN '2' ELSE '3' END AS \"PCDiv\"",
        "CASE l_linestatus WHEN 'O' THEN '1' ELSE 'false' END AS \"CentralContractMonthFlag\"",
        f'{day} AS "LastTradingDay"',
        "'none' AS \"SQD\"",
        "'002' AS \"EmMrgnTrgDiv\"",
    ]
    return out


def vendor_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The date stands in a function over an array, so that Spark leaves these columns out of whole-stage code: together they make a method too long for the JIT."""
    columns = [c.replace('"', "`") for c in _raw_columns()]
    at = next(k for k, c in enumerate(columns) if c.endswith(" AS `Date`"))
    columns[at] = f"transform(array(l_linenumber), n -> {columns[at].removesuffix(' AS `Date`').replace('l_linenumber', 'n')})[0] AS `Date`"
    return V.table(spark, sf, "lineitem").selectExpr(*columns)


def option_bronze_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every vendor row with its texts and 23 numbers."""
    return O.bronze(vendor_rows(spark, sf), REQUESTED, ENDPOINT, DOWNLOADED, LINE).select(*LINE, "Date", *O.TEXTS, *O.NUMBERS, "source_endpoint", "requested_date", text("downloaded").alias("downloaded"))


def typed_rows(spark: SparkSession, sf: str) -> DataFrame:
    return O.silver(O.bronze(vendor_rows(spark, sf), REQUESTED, ENDPOINT, DOWNLOADED, LINE), carry=LINE)


def option_silver_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Typed rows written by month; a range of days reads only its months' folders."""
    rows = typed_rows(spark, sf)
    path = place(spark, "option_rows")
    lake.write_months(rows, path, "trading_date")
    back = lake.scan(spark, path, StructType([*rows.schema, StructField("year", IntegerType()), StructField("month", IntegerType())]))
    back = back.filter(lake.month_range(FIRST, LAST) & lake.in_range([S("trading_date")], FIRST, LAST))
    dates = [text(c).alias(c) for c in ("trading_date", "last_trading_day", "special_quotation_day", "available")]
    numbers = [r(c).alias(c) for c in ("base_volatility", "implied_volatility", "interest_rate")]
    return back.select(*LINE, *dates, "option_code", "contract_month", "central_month", "put_call", *O.PRICES, "volume", "open_interest", *numbers, "emergency_margin")


def option_state_map(spark: SparkSession, sf: str) -> DataFrame:
    """The day's option state as a long feature map with the time from which each value is known."""
    m = O.feature_map(O.daily_state(typed_rows(spark, sf)), "trading_date", "available", "option_")
    return m.select(text("day").alias("day"), "feature", r("value", 5).alias("value"), text("available").alias("available"), text("source_date").alias("source_date"))


def volatility_index_map(spark: SparkSession, sf: str) -> DataFrame:
    """Close and range of one symbol's orders by day; of several orders of a day the one with the greatest key is known last."""
    o = V.table(spark, sf, "orders")
    known = V.day("o_orderdate").cast("timestamp") + F.expr("INTERVAL 20 HOURS") + F.make_dt_interval(secs=(S("o_orderkey") % 3_600).cast("decimal(18,6)"))
    records = o.select(S("o_orderpriority").alias("symbol"), V.day("o_orderdate").alias("d"), known.alias("available"), S("o_totalprice").alias("close"), F.when(S("o_orderkey") % 5 != 0, S("o_totalprice") / 10).alias("range"))
    m = O.symbol_map(records, "symbol", "2-high", "d", "available", {"index_close": "close", "index_range": "range"})
    return m.select(text("day").alias("day"), "feature", r("value", 4).alias("value"), text("available").alias("available"))


Q = {f.__name__: f for f in (option_bronze_rows, option_silver_rows, option_state_map, volatility_index_map)}


def _pick(short: str, long: str) -> str:
    return f"coalesce(nullif(\"{short}\", ''), \"{long}\")"


_NUMBER = {s: f"TRY_CAST({_pick(s, long)} AS DOUBLE)" for s, long in O.NUMBERS.items()}
_POSITIVE = {s: f"CASE WHEN {c} > 0 THEN {c} END" for s, c in _NUMBER.items()}
_FRACTION = {s: f"CASE WHEN {c} > 1 THEN {c} / 100 WHEN {c} > 0 THEN {c} END" for s, c in _NUMBER.items()}
_DATE = f"coalesce(nullif(\"Date\", ''), '{REQUESTED.isoformat()}')"
RAW = f"raw AS (SELECT {', '.join(_raw_columns())} FROM lineitem)"
TYPED = f"""{RAW}, typed AS (SELECT {', '.join(LINE)}, CAST({_DATE} AS DATE) AS trading_date, "Code" AS option_code, {_pick("CM", "ContractMonth")} AS contract_month,
  "CentralContractMonthFlag" = '1' AS central_month, CASE "PCDiv" WHEN '1' THEN 'put' WHEN '2' THEN 'call' END AS put_call,
  {', '.join(f'{_POSITIVE[s]} AS {name}' for name, s in O.PRICES.items())}, {_NUMBER["Vo"]} AS volume, {_NUMBER["OI"]} AS open_interest,
  {_FRACTION["BaseVol"]} AS base_volatility, {_FRACTION["IV"]} AS implied_volatility, {_POSITIVE["IR"]} / 100 AS interest_rate,
  CAST("LastTradingDay" AS DATE) AS last_trading_day, "EmMrgnTrgDiv" AS emergency_margin, CAST({_DATE} AS DATE) + INTERVAL 18 HOURS AS available FROM raw)"""
SQL = {
    "option_bronze_rows": f"""WITH {RAW} SELECT {', '.join(LINE)}, {_DATE} AS "Date", "Code", {_pick("CM", "ContractMonth")} AS "CM", "EmMrgnTrgDiv", "PCDiv", "LastTradingDay" AS "LTD", "SQD",
      "CentralContractMonthFlag" AS "CCMFlag", {', '.join(f'{c} AS "{s}"' for s, c in _NUMBER.items())}, '{ENDPOINT}' AS source_endpoint, '{REQUESTED.isoformat()}' AS requested_date,
      '{DOWNLOADED:%Y-%m-%d %H:%M:%S}' AS downloaded FROM raw""",
    "option_silver_rows": f"""WITH {TYPED} SELECT {', '.join(LINE)}, CAST(trading_date AS VARCHAR) AS trading_date, CAST(last_trading_day AS VARCHAR) AS last_trading_day,
      CAST(NULL AS VARCHAR) AS special_quotation_day, strftime(available, '%Y-%m-%d %H:%M:%S') AS available, option_code, contract_month, central_month, put_call, {', '.join(O.PRICES)},
      volume, open_interest, round(base_volatility, 6) AS base_volatility, round(implied_volatility, 6) AS implied_volatility, round(interest_rate, 6) AS interest_rate, emergency_margin
      FROM typed WHERE trading_date BETWEEN DATE '{FIRST}' AND DATE '{LAST}'""",
    "option_state_map": f"""WITH {TYPED}, n AS (SELECT *, coalesce(night_open > 0 AND night_high > 0 AND night_low > 0 AND night_close > 0 AND night_high >= night_low, FALSE) AS night FROM typed),
      g AS (SELECT trading_date, max(available) AS available, CAST(count(*) AS DOUBLE) AS option_rows, count(*) FILTER (WHERE night) / count(*) AS option_night_share,
        sum(open_interest) FILTER (WHERE put_call = 'put') / nullif(sum(open_interest) FILTER (WHERE put_call = 'call'), 0) AS option_put_call_interest,
        sum(implied_volatility * open_interest) / nullif(sum(open_interest) FILTER (WHERE implied_volatility IS NOT NULL), 0) AS option_weighted_iv,
        avg(ln(night_high / night_low)) FILTER (WHERE night) AS option_night_range FROM n GROUP BY 1),
      l AS (SELECT trading_date, available, unnest(['option_rows', 'option_night_share', 'option_put_call_interest', 'option_weighted_iv', 'option_night_range']) AS feature,
        unnest([option_rows, option_night_share, option_put_call_interest, option_weighted_iv, option_night_range]) AS value FROM g)
      SELECT CAST(trading_date AS VARCHAR) AS day, feature, round(value, 5) AS value, strftime(available, '%Y-%m-%d %H:%M:%S') AS available, CAST(trading_date AS VARCHAR) AS source_date FROM l""",
    "volatility_index_map": """WITH o AS (SELECT CAST(o_orderdate AS DATE) AS d, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 20 HOURS + to_seconds(o_orderkey % 3600) AS available, o_totalprice AS close,
        CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice / 10 END AS rng FROM orders WHERE upper(o_orderpriority) = '2-HIGH'),
      b AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY d ORDER BY available DESC, close DESC, rng DESC NULLS LAST) = 1)
      SELECT CAST(d AS VARCHAR) AS day, unnest(['index_close', 'index_range']) AS feature, round(unnest([close, rng]), 4) AS value, strftime(available, '%Y-%m-%d %H:%M:%S') AS available FROM b""",
}
