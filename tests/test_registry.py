from __future__ import annotations

import datetime as dt
import math
from pathlib import Path

import pytest

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="test tables are not here")
duckdb = pytest.importorskip("duckdb")

# one or two of each kind; the whole registry is compared by the runs against SQL
NAMES = [
    "daily_gap_losses", "asof_record_tolerance", "asof_per_feature", "asof_strict_latest_close", "calendar_dense_flags", "contract_roll_table", "opra_ticker_parse",
    "leakage_status_counts", "session_interleaved_moments", "option_surface_daily", "intraday_late_session", "stress_episodes", "forecast_metrics",
    "common_sample_eviction", "murphy_curves", "sessionize_events", "scan_partition_prune", "csv_alias_and_null_marker",
    "spaced_extremes", "expectile_grid", "option_bronze_rows", "option_state_map", "volatility_index_map", "sample_audits", "threshold_diagnostics", "stress_regimes",
    "information_saturation", "combined_start",
]


def canon(rows):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "NULL"
        return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    from tidemark.plans import registry

    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    df = registry.queries()[name](spark, str(SF))
    want = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert canon(df.select(*columns).collect()) == canon(want.fetchall())


def test_every_sql_has_its_query():
    from tidemark.plans import registry

    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry(spark):
    from tidemark.plans import registry

    row = registry.entry(spark).first()
    assert row is not None


def test_later_losses_leave_forecasts_alone(spark, tmp_path):
    """Changing the future changes no forecast before it."""
    from pyspark.sql import functions as F

    from tidemark.plans import views as V

    o = spark.read.parquet(f"{SF}/orders.parquet")
    cut = dt.datetime(1999, 1, 1)
    o.withColumn("o_totalprice", F.when(F.col("o_orderdate") >= F.lit(cut), F.col("o_totalprice") * 3 + 1).otherwise(F.col("o_totalprice"))).write.parquet(f"file://{tmp_path}/orders.parquet")
    early = lambda sf: sorted(map(tuple, V.forecasts(spark, sf).filter(F.col("d") < F.lit(cut).cast("date")).select("d", "side", "model", F.round("var", 9), F.round("es", 9)).collect()))
    a, b = early(str(SF)), early(f"file://{tmp_path}")
    assert a and a == b
