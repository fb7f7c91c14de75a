from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest

from tidemark.operators import origins, tails


def losses(n, seed=0):
    rng = np.random.default_rng(seed)
    h, out = 1.0, []
    for _ in range(n):
        e = math.sqrt(h) * rng.standard_t(6) * math.sqrt(4 / 6)
        out.append(-e / 100)
        h = 0.05 + 0.08 * e * e + 0.87 * h
    return np.array(out)


def test_linear_path_is_the_recursion():
    rng = np.random.default_rng(0)
    push = rng.normal(size=300)
    for decay in (0.0, 0.3, 0.95, -0.4, 0.9999):
        v, want = 0.7, []
        for p in push:
            want.append(v)
            v = decay * v + p
        assert tails.linear_path(push, decay, 0.7) == pytest.approx(np.array([*want, v]), abs=1e-9)


def test_student_t_tail():
    assert tails.t_cdf(2.015048, 5.0) == pytest.approx(0.95, abs=1e-6)  # tables of the t distribution
    assert tails.t_cdf(-2.570582, 5.0) == pytest.approx(0.025, abs=1e-6)
    q, s = tails.t_tail(0.95, 4.5)
    z = np.linspace(q, 2000, 4_000_001)
    unit = math.sqrt((4.5 - 2) / 4.5)
    c = math.exp(math.lgamma(2.75) - math.lgamma(2.25)) / math.sqrt(4.5 * math.pi) / unit
    f = c * (1 + (z / unit) ** 2 / 4.5) ** -2.75
    assert np.trapezoid(f, z) == pytest.approx(0.05, abs=1e-5) and np.trapezoid(f * z, z) / 0.05 == pytest.approx(s, rel=1e-2)


def test_fits_find_what_made_the_series():
    x = losses(2500, 3)
    fit = tails.MODELS["garch"].fit(x, 0.95, None, {})
    assert fit.status == "ok" and fit.extra["persistence"] == pytest.approx(0.95, abs=0.04) and fit.extra["nu"] == pytest.approx(6, abs=2)
    for name in ("caviar_sav", "caviar_as", "care_sav", "score"):
        fit = tails.MODELS[name].fit(x, 0.95, None, {})
        (var, es), *_ = tails.MODELS[name].forecast(x[:500], x[500:], 0.95, fit).values()
        assert 0.035 < (x[500:] > var).mean() < 0.07 and (es >= var).all()
    assert tails.MODELS["garch"].fit(np.zeros(60), 0.95, None, {}).status == "no_variation"
    few = tails.MODELS["caviar_sav"].fit(x[:300], 0.95, None, {})
    assert math.isnan(few.extra["times"])


@pytest.mark.parametrize("name", list(tails.MODELS))
def test_daily_state_needs_no_later_losses(name):
    x = losses(1200)
    model = tails.MODELS[name]
    fit = model.fit(x[:1100], 0.95, None, {"nu": 6.0})
    whole = model.forecast(x[:1100], x[1100:], 0.95, fit)
    changed = model.forecast(x[:1100], np.append(x[1100:1150], x[1150:] * 5), 0.95, fit)
    for key in whole:
        assert whole[key][0][:51] == pytest.approx(changed[key][0][:51])


def frame(spark, n, sides=("left", "right")):
    rows = []
    for k, side in enumerate(sides):
        day = dt.date(2015, 1, 1)
        for x in losses(n, k):
            rows.append((side, day, float(x)))
            day += dt.timedelta(days=3 if day.weekday() == 4 else 1)
    return spark.createDataFrame(rows, "side string, d date, loss double").repartition(3)


def test_jobs_see_the_rows_before_their_month_and_no_others(spark):
    from tidemark.operators.blocks import positions

    placed = positions(frame(spark, 420, ("left",)), ["side"], "d")
    refits = origins.refit_days(placed, ["side"], "d", 300)
    dealt = origins.jobs(placed, refits, ["side"], "d", "loss").toPandas()
    days = placed.toPandas().sort_values("pos").d.tolist()
    months = sorted({d.strftime("%Y-%m") for d in days[300:]})
    assert sorted(dealt.refit.unique()) == list(range(1, len(months) + 1))
    covered = []
    for k, month in enumerate(months, 1):
        job = dealt[dealt.refit == k].sort_values("pos")
        first = next(p for p, d in enumerate(days) if p >= 300 and d.strftime("%Y-%m") == month)
        assert (job["first"] == first).all() and job.pos.tolist() == list(range(len(job)))
        assert all(days[p].strftime("%Y-%m") == month for p in job.pos[job.pos >= first])
        covered += job.pos[job.pos >= first].tolist()
    assert covered == list(range(300, 420))
    assert (refits.filter("year(month) = 2016 and first = anchor").count(), refits.filter("first = anchor").count()) == (1, len({m[:4] for m in months}))


def test_a_job_does_not_depend_on_its_neighbours(spark):
    """All jobs, two refits alone, one model alone, and a single fit by hand."""
    df = frame(spark, 1130)
    of = lambda rows: {(r.side, r.model, r.d): (r.var, r.es, r.status, r.refit) for r in rows}
    whole = of(origins.forecasts(df, ["side"], "d", "loss", ["caviar_sav", "gjr_garch", "pot"]).collect())
    assert len(whole) == 130 * 2 * 4 and {m for _, m, _ in whole} == {"caviar_sav", "gjr_garch_t", "gjr_garch_evt", "pot_gpd"}
    some = of(origins.forecasts(df, ["side"], "d", "loss", ["gjr_garch"], only=[2, 4]).collect())
    assert some and all(whole[k] == v for k, v in some.items()) and {v[3] for v in some.values()} == {2, 4}
    x = np.array([r.loss for r in df.filter("side = 'left'").orderBy("d").collect()])
    days = [r.d for r in df.filter("side = 'left'").orderBy("d").collect()]
    anchor = tails.MODELS["caviar_sav"].fit(x[:1000], 0.95, None, {})
    second = next(k for k in range(1000, 1130) if days[k].month != days[1000].month)
    fit = tails.MODELS["caviar_sav"].fit(x[:second], 0.95, anchor.params, anchor.extra)
    if days[second].year == days[1000].year:
        var, _ = tails.MODELS["caviar_sav"].forecast(x[:second], x[second : second + 3], 0.95, fit)["caviar_sav"]
        assert [whole["left", "caviar_sav", d][0] for d in days[second : second + 3]] == pytest.approx(var.tolist())


def test_status_of_what_cannot_be_fitted(spark):
    df = frame(spark, 340, ("left",))
    out = origins.forecasts(df, ["side"], "d", "loss", ["caviar_sav", "pot", "garch"], least=300).collect()
    status = {(r.model, r.status) for r in out}
    assert ("caviar_sav", "few_exceedances") in status and ("pot_gpd", "few_exceedances") in status
    assert all(r.var is not None and r.es is not None for r in out if r.status in ("ok", "step_limit"))
    assert all(r.var is not None and r.es is None for r in out if r.model == "caviar_sav") and all(r.var is None for r in out if r.model == "pot_gpd")
    flat = df.selectExpr("side", "d", "0D as loss")
    assert {r.status for r in origins.forecasts(flat, ["side"], "d", "loss", ["garch"], least=300).collect()} == {"no_variation"}
    assert origins.forecasts(df, ["side"], "d", "loss", ["pot"]).count() == 0  # too few rows for a first fit
