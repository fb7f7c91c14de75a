from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import expr as X
from tidemark.operators import evaluate, numerics, options, quality
from tidemark.operators import rolling as R
from tidemark.operators.asof import asof_join, asof_long
from tidemark.operators.calendar import business_days, contract_table, session_calendar
from tidemark.sources import lake, normalize

D0 = dt.date(2024, 1, 1)


def day(k: int) -> dt.date:
    return D0 + dt.timedelta(days=k)


@pytest.mark.parametrize("bucket", [None, "month"])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_matches_brute_force(spark, bucket, strict):
    rng = random.Random(3)
    left = [(k, rng.choice("ab"), day(rng.randint(0, 120))) for k in range(80)]
    right = []
    for k in range(60):
        d = rng.randint(0, 120)
        right.append((rng.choice("ab"), day(d), day(d + rng.choice([0, 0, 5, 30])), float(k) if rng.random() < 0.8 else None))
    seen, rows = set(), []
    for r in right:
        if r[:2] not in seen:
            seen.add(r[:2])
            rows.append(r)
    l = spark.createDataFrame(left, "k int, g string, t date")
    f = spark.createDataFrame(rows, "g string, s date, known date, v double")
    got = {r.k: (r.v, r.s) for r in asof_join(l, f, "t", "s", ["g"], ["v", "s"], available="known", strict=strict, tolerance_days=20, bucket=bucket).collect()}
    for k, g, t in left:
        best = max((r for r in rows if r[0] == g and (max(r[1], r[2]) < t if strict else max(r[1], r[2]) <= t)), key=lambda r: r[1], default=None)
        want = (best[3], best[1]) if best and (t - best[1]).days <= 20 else (None, None)
        assert got[k] == want


def test_asof_never_uses_later_knowledge(spark):
    left = spark.createDataFrame([(day(10),)], "t date")
    early = [(day(1), day(2), 1.0), (day(5), day(20), 2.0)]
    late = [(day(1), day(2), 1.0), (day(5), day(20), 99.0), (day(9), day(11), 7.0)]
    out = [asof_join(left, spark.createDataFrame(r, "s date, known date, v double"), "t", "s", columns=["v"], available="known").first().v for r in (early, late)]
    assert out == [1.0, 1.0]


def test_asof_long_picks_each_feature_alone(spark):
    f = spark.createDataFrame([("a", day(1), 1.0), ("b", day(2), None), ("b", day(0), 5.0)], "feature string, source_time date, value double")
    got = {r.feature: r.value for r in asof_long(spark.createDataFrame([(day(3),)], "t date"), f, "t").collect()}
    assert got == {"a": 1.0, "b": 5.0}


def test_spaced_top_is_greedy(spark):
    rng = random.Random(5)
    rows = [("a", day(k), rng.random()) for k in range(100)]
    got = [(r.t, r.v) for r in R.spaced_top(spark.createDataFrame(rows, "g string, t date, v double"), ["g"], "t", "v", 5, 10).orderBy("rank").collect()]
    want = []
    for _, t, v in sorted(rows, key=lambda r: -r[2]):
        if len(want) < 5 and all(abs((t - u).days) >= 10 for u, _ in want):
            want.append((t, v))
    assert got == want


def test_islands(spark):
    rows = [("a", day(k)) for k in (0, 1, 9, 10, 30)]
    got = [r.cluster for r in R.islands(spark.createDataFrame(rows, "g string, t date"), ["g"], "t", 5).orderBy("t").collect()]
    assert got == [1, 1, 2, 2, 3]


def test_forecast_validity_and_losses(spark):
    df = spark.createDataFrame([(2.0, 2.5), (2.0, 1.9), (-2.0, -1.0), (float("nan"), 1.0)], "var double, es double")
    got = [r[0] for r in df.select(X.validity_reason(F.col("var"), F.col("es"))).collect()]
    assert got == ["ok", "invalid_es_below_var", "invalid_nonpositive_es", "invalid_nonfinite"]
    one = spark.createDataFrame([(3.0, 2.0, 2.5)], "loss double, var double, es double")
    q, fz = one.select(X.quantile_loss(F.col("loss"), F.col("var"), 0.95), X.fz_loss(F.col("loss"), F.col("var"), F.col("es"), 0.95)).first()
    assert q == pytest.approx(0.95)
    assert fz == pytest.approx((-3 + 2) / (0.05 * -2.5) + 2 / 2.5 + math.log(2.5) - 1)


def test_empirical_es(spark):
    es = spark.range(1).select(X.empirical_es(F.array(*[F.lit(float(v)) for v in (1, 2, 3, 10)]), F.lit(2.5))).first()[0]
    assert es == 6.5


def test_metrics_and_common_sample(spark):
    hits = [0, 1, 1, 0, 0, 1, 0]
    rows = [("m", day(k), float(h) * 2, 1.0, 1.5) for k, h in enumerate(hits)] + [("n", day(k), 0.5, 1.0, 1.5) for k in range(3)]
    s = evaluate.scored(spark.createDataFrame(rows, "model string, d date, loss double, var double, es double"), 0.95)
    m = evaluate.metrics(s, ["model"], "d", 0.95).filter("model = 'm'").first()
    assert (m.rows, m.hits, m.n00, m.n01, m.n10, m.n11) == (7, 3, 1, 2, 2, 1)
    p = 3 / 7
    assert m.kupiec_lr == pytest.approx(-2 * (3 * math.log(0.05) + 4 * math.log(0.95) - 3 * math.log(p) - 4 * math.log(1 - p)))
    status, days = evaluate.common_sample(s.withColumn("g", F.lit(1)), ["g"], "model", "d", "m", 0.95)
    assert {r.model: r.kept for r in status.collect()} == {"m": True, "n": False}
    assert days.count() == 7


def test_calendar(spark):
    days = spark.createDataFrame([(day(k),) for k in range(40) if day(k).weekday() < 5 and k != 14], "d date")
    c = {r.d: r for r in session_calendar(days).collect()}
    assert len(c) == 40 - (0 if day(39).weekday() < 5 else day(39).weekday() - 4)
    assert not c[day(14)].is_session and c[day(15)].holiday_adjacent and c[day(0)].regime == "EST"
    plus = {r.d: r.plus_2 for r in business_days(days, 2).collect()}
    assert plus[dt.date(2024, 1, 5)] == dt.date(2024, 1, 9) and plus[dt.date(2024, 1, 12)] == dt.date(2024, 1, 17)
    jan = {r.month: r for r in contract_table(days, 3).collect()}[dt.date(2024, 1, 1)]
    assert (jan.sq, jan.last_trade, jan.roll_start) == (dt.date(2024, 1, 12), dt.date(2024, 1, 11), dt.date(2024, 1, 8))


def test_option_ticker(spark):
    df = spark.createDataFrame([("O:SPY260116C00100000",), ("O:SPYX260116C00100000",), ("SPY",), (None,)], "t string")
    a, b, c, d = normalize.parse_option_ticker(df, "t", ["SPY", "SP"]).collect()
    assert (a.underlying, a.expiry, a.kind, a.strike) == ("SPY", dt.date(2026, 1, 16), "call", 100.0)
    assert b.underlying is None and c.strike is None and d.kind is None


def test_leakage_and_coverage(spark):
    df = spark.createDataFrame([("f", day(1), 1.0, day(1)), ("f", day(2), None, day(2)), ("f", day(3), 2.0, day(9)), ("f", day(4), 2.0, None)], "feature string, d date, value double, available date")
    got = [r.status for r in quality.leakage_audit(df, "value", "available", "d").orderBy("d").collect()]
    assert got == ["pass", "warn", "fail", "fail"]
    c = quality.coverage(df, "feature", "d", "value", 4).first()
    assert (c.non_missing, c.missing_rate, c.first_valid) == (3, 0.25, day(1))
    with pytest.raises(ValueError):
        quality.require_unique(df, ["feature"])


def test_signature_ignores_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "<x>")], "k int, s string")
    a, b = quality.table_signature(df).first(), quality.table_signature(df.orderBy(F.desc("k"))).first()
    assert a == b
    assert a != quality.table_signature(df.filter("k > 1")).first()


def test_last_wins_keeps_unkeyed(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 1), (None, 2)], "k string, o int")
    assert sorted((r.k or "", r.o) for r in options.last_wins(df, ["k"], "o").collect()) == [("", 1), ("", 2), ("a", 2)]


def test_lake_round_trip_and_resume(spark, tmp_path):
    df = spark.createDataFrame([(day(k), k) for k in range(70)], "d date, v int")
    lake.write_months(df, f"file://{tmp_path}/t", "d")
    back = lake.scan(spark, f"file://{tmp_path}/t").filter(lake.month_range("2024-02-01", "2024-02-29"))
    assert back.count() == 29
    assert "PartitionFilters: [isnotnull" in back._jdf.queryExecution().executedPlan().toString() or "month" in back._jdf.queryExecution().executedPlan().toString()
    assert lake.scan_optional(spark, f"file://{tmp_path}/none", "a int").count() == 0
    jobs = spark.createDataFrame([(1,), (2,)], "j int")
    assert [r.j for r in lake.pending(jobs, jobs.filter("j = 1"), ["j"]).collect()] == [2]
    assert lake.covers(df, df.limit(3), "d") and not lake.covers(df.filter("v < 5"), df, "d")


def test_implied_vol_recovers_sigma():
    k = np.array(["call", "put"])
    args = (np.array([100.0, 100.0]), np.array([105.0, 95.0]), np.array([0.5, 0.25]))
    price = numerics.black_scholes(k, *args, 0.01, np.array([0.25, 0.25]))
    assert numerics.implied_vol(k, price, *args, 0.01) == pytest.approx([0.25, 0.25], abs=1e-6)
    assert np.isnan(numerics.implied_vol(k, np.array([1000.0, -1.0]), *args, 0.01)).all()


def test_tail_numerics():
    rng = np.random.default_rng(1)
    x = rng.pareto(4, 8000)
    assert numerics.gpd_tail(x, 0.9, 0.99)["xi"] == pytest.approx(0.25, abs=0.12)
    assert numerics.hill(x + 1, 400) == pytest.approx(0.25, abs=0.06)
    t = numerics.gpd_tail(x, 0.9, 0.99)
    assert t["es"] >= t["var"] and abs((x > t["var"]).mean() - 0.01) < 0.004
    assert numerics.expectile(x, 0.5) == pytest.approx(x.mean(), abs=1e-6)
    z = np.linspace(-9, 9, 2001)
    assert numerics.normal_cdf(z) == pytest.approx(np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z]), rel=1e-12)


def test_chi_square_tail(spark):
    x = [0.0, 1e-6, 0.5, 3.841459, 20.0, 70.0, None]
    got = [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(x)], "k int, x double").coalesce(1).orderBy("k").select(X.chi2_1_sf(F.col("x"))).collect()]
    assert got[:-1] == pytest.approx([math.erfc(math.sqrt(v / 2)) for v in x[:-1]], abs=1e-12) and got[-1] is None


def test_nelder_mead():
    best, value = numerics.nelder_mead(lambda p: float(((p - [1, 2, 3]) ** 2).sum()), np.zeros(3), 500)
    assert value < 1e-6 and best == pytest.approx([1, 2, 3], abs=1e-2)


def test_tail_fits_use_the_whole_series(spark):
    from tidemark.operators import tails
    from tidemark.plans import models, views

    sf = "/root/testdata/sf0.001"
    days = views.losses(spark, sf).toPandas().sort_values("d")
    series = {side: g.loss.to_numpy(float) for side, g in days.groupby("side")}
    assert all(len(x) > 600 for x in series.values())
    for r in models.gas_t_fit(spark, sf).collect():
        assert r["loss"] == pytest.approx(tails.MODELS["score"].fit(series[r.side], views.LEVEL, None, {}).value)
    for r in models.garch_t_tail(spark, sf).collect():
        assert r["loss"] == pytest.approx(tails.MODELS["gjr_garch" if r.model == "gjr_garch_t" else "garch"].fit(series[r.side], views.LEVEL, None, {}).value)
