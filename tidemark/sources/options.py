"""Vendor rows of listed options: text columns as delivered, typed rows, the daily state that features read."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from .normalize import percent_to_fraction

# The vendor's short and long header of each numeric field and of each text field.
NUMBERS = {
    "O": "WholeDayOpen", "H": "WholeDayHigh", "L": "WholeDayLow", "C": "WholeDayClose",
    "EO": "NightSessionOpen", "EH": "NightSessionHigh", "EL": "NightSessionLow", "EC": "NightSessionClose",
    "AO": "DaySessionOpen", "AH": "DaySessionHigh", "AL": "DaySessionLow", "AC": "DaySessionClose",
    "Vo": "Volume", "OI": "OpenInterest", "Va": "TurnoverValue", "Strike": "StrikePrice", "VoOA": "Volume(OnlyAuction)",
    "Settle": "SettlementPrice", "Theo": "TheoreticalPrice", "BaseVol": "BaseVolatility", "UnderPx": "UnderlyingPrice",
    "IV": "ImpliedVolatility", "IR": "InterestRate",
}
TEXTS = {
    "Code": "Code", "CM": "ContractMonth", "EmMrgnTrgDiv": "EmergencyMarginTriggerDivision", "PCDiv": "PutCallDivision",
    "LTD": "LastTradingDay", "SQD": "SpecialQuotationDay", "CCMFlag": "CentralContractMonthFlag",
}
NIGHT = {"night_open": "EO", "night_high": "EH", "night_low": "EL", "night_close": "EC"}
PRICES = NIGHT | {"settlement": "Settle", "theoretical": "Theo", "strike": "Strike", "underlying": "UnderPx"}
#: Numbers that typed rows have.
SILVER = [*PRICES.values(), "Vo", "OI", "BaseVol", "IV", "IR"]


def _field(kinds: Mapping[str, str], short: str, long: str) -> Column:
    """The short field's text, or the long one's where the short is missing or blank; either column may be absent.  `kinds`: types by column."""
    found = [F.col(f"`{c}`").cast("string") for c in _found(kinds, short, long)]
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in found]) if found else F.lit(None).cast("string")


def _found(kinds: Mapping[str, str], short: str, long: str) -> list[str]:
    have = {c.lower(): c for c in kinds}
    return [have[n.lower()] for n in dict.fromkeys((short, long)) if n.lower() in have]


def _cast(text: Column) -> Column:
    """A failed cast raises an error inside the JVM, which costs more than the rest of the row: what has no digit (the vendor's dashes) is not cast."""
    return F.when(text.rlike("[0-9]"), text.try_cast("double"))


def _number(kinds: Mapping[str, str], short: str, long: str) -> Column:
    """The field's finite number; columns that are doubles already do not pass through text.

    The steps are functions over an array of one, whose argument is worked out once.  Spark also leaves projections with such functions out
    of whole-stage code, where all fields would stand in one method, too long for the JIT to compile.
    """
    found = _found(kinds, short, long)
    if found and all(kinds[c] == "double" for c in found):
        value = F.array(F.coalesce(*[F.col(f"`{c}`") for c in found]))
    else:
        value = F.transform(F.array(_field(kinds, short, long)), _cast)
    return F.transform(value, X.finite)[0]


def bronze(rows: DataFrame, requested: dt.date, endpoint: str, downloaded: dt.datetime, carry: Sequence[str] = ()) -> DataFrame:
    """One row for each vendor row: texts as they are, 23 numbers as doubles, and where the row came from.

    A field comes from its short header, or from the long one if that is blank; what is no finite number is null, also where the
    long field holds one.  A row without a date takes the requested one.  `carry` names columns that are kept beside them.
    """
    kinds = dict(rows.dtypes)
    day = F.coalesce(_field(kinds, "Date", "Date"), F.lit(requested.isoformat()))
    texts = [_field(kinds, s, long).alias(s) for s, long in TEXTS.items()]
    numbers = [_number(kinds, s, long).alias(s) for s, long in NUMBERS.items()]
    source = [F.lit(endpoint).alias("source_endpoint"), F.lit(requested.isoformat()).alias("requested_date"), F.lit(downloaded).alias("downloaded")]
    return rows.select(*carry, day.alias("Date"), *texts, *numbers, *source)


def silver(rows: DataFrame, zone: str = "Asia/Tokyo", carry: Sequence[str] = ()) -> DataFrame:
    """Typed rows from vendor or bronze rows: prices above zero, volatilities and rates as fractions, put or call by code.

    A day's row is known at three in the morning of the next day, exchange time.  Rows without a valid date are left out.
    """
    kinds = dict(rows.dtypes)
    texts = [_field(kinds, s, TEXTS[s]).alias(f"__{s}") for s in TEXTS]
    read = rows.select(*carry, _field(kinds, "Date", "Date").alias("__Date"), *texts, *[_number(kinds, s, NUMBERS[s]).alias(f"__{s}") for s in SILVER])
    text = lambda s: F.col(f"__{s}")
    number = text
    positive = lambda s: F.when(number(s) > 0, number(s))
    day = F.try_to_date(text("Date"), "yyyy-MM-dd")
    flag = F.lower(text("CCMFlag"))
    known = F.to_utc_timestamp(F.date_add("trading_date", 1).cast("timestamp") + F.expr("INTERVAL 3 HOURS"), zone)
    return read.select(
        *carry,
        day.alias("trading_date"),
        text("Code").alias("option_code"),
        text("CM").alias("contract_month"),
        F.when(flag.isin("1", "true"), True).when(flag.isin("0", "false"), False).alias("central_month"),
        F.when(text("PCDiv") == "1", "put").when(text("PCDiv") == "2", "call").alias("put_call"),
        *[positive(s).alias(name) for name, s in PRICES.items()],
        number("Vo").alias("volume"),
        number("OI").alias("open_interest"),
        percent_to_fraction(positive("BaseVol")).alias("base_volatility"),
        percent_to_fraction(positive("IV")).alias("implied_volatility"),
        (positive("IR") / 100).alias("interest_rate"),
        F.try_to_date(text("LTD"), "yyyy-MM-dd").alias("last_trading_day"),
        F.try_to_date(text("SQD"), "yyyy-MM-dd").alias("special_quotation_day"),
        text("EmMrgnTrgDiv").alias("emergency_margin"),
    ).filter("trading_date is not null").withColumn("available", known)


def valid_night() -> Column:
    """Whether a typed row has a whole night session: four prices above zero, the high not below the low."""
    every = F.lit(True)
    for name in NIGHT:
        every = every & F.coalesce(F.col(name) > 0, F.lit(False))
    return every & F.coalesce(F.col("night_high") >= F.col("night_low"), F.lit(False))


def daily_state(rows: DataFrame) -> DataFrame:
    """trading_date, available and option_ features of typed rows: one aggregation, sums over all contracts of a day."""
    night = valid_night()
    of = lambda kind, c: F.sum(F.when(F.col("put_call") == kind, F.col(c)))
    ratio = lambda a, b: F.when(b > 0, a / b)
    return rows.groupBy("trading_date").agg(
        F.max("available").alias("available"),
        F.count("*").cast("double").alias("option_rows"),
        (F.count_if(night) / F.count("*")).alias("option_night_share"),
        ratio(of("put", "open_interest"), of("call", "open_interest")).alias("option_put_call_interest"),
        ratio(F.sum(F.col("implied_volatility") * F.col("open_interest")), F.sum(F.when(F.col("implied_volatility").isNotNull(), F.col("open_interest")))).alias("option_weighted_iv"),
        F.avg(F.when(night, F.log(F.col("night_high") / F.col("night_low")))).alias("option_night_range"),
    )


def feature_map(records: DataFrame, day: str, available: str, prefix: str) -> DataFrame:
    """day, feature, value, available, source_date for each column whose name begins with the prefix.

    Of several records of a day the one known last counts, also with a null value; ties go to the larger values.
    Records without a day have no row.
    """
    names = [c for c in records.columns if c.startswith(prefix)]
    order = F.struct(F.col(available), *[F.col(c).cast("double").alias(c) for c in names])
    last = records.filter(F.col(day).isNotNull()).groupBy(F.col(day).alias("day")).agg(F.max(order).alias("last"))
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"last.{c}").alias("value")) for c in names])
    return last.select("day", F.col(f"last.{available}").alias("available"), F.explode(cells).alias("cell")).select("day", "cell.feature", "cell.value", "available", F.col("day").alias("source_date"))


def symbol_map(records: DataFrame, symbol: str, wanted: str, day: str, available: str, measures: Mapping[str, str]) -> DataFrame:
    """The feature map of one symbol's records (whatever the case of its name): `measures` maps features to columns."""
    prefix = "__symbol_"
    own = records.filter(F.upper(F.col(symbol)) == wanted.upper())
    out = feature_map(own.select(day, available, *[F.col(c).alias(prefix + name) for name, c in measures.items()]), day, available, prefix)
    return out.withColumn("feature", F.substring("feature", len(prefix) + 1, 1_000))
