from __future__ import annotations

import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import blocks, numerics, reports, select


def test_combined_status(spark):
    rows = [("a", "ok"), ("a", "ok"), ("b", "ok"), ("b", "common_sample_unstable"), ("c", "z"), ("c", "ok"), ("d", None)]
    out = {r.k: r.combined_status for r in reports.combined_status(spark.createDataFrame(rows, "k string, s string"), ["k"], "s").collect()}
    assert out == {"a": "ok", "b": "common_sample_unstable", "c": "ok,z", "d": "unavailable_empty_forecasts"}


def scores(spark, rows):
    return spark.createDataFrame(rows, "side string, model string, d date, hit boolean")


def test_sample_audit_counts_days_that_all_have(spark):
    day = lambda i: dt.date(2020, 1, 1) + dt.timedelta(i)
    rows = [("l", m, day(i), m == "b" and i % 10 == 0) for m in "ab" for i in range(300) if m == "a" or i >= 5]
    rows += [("l", "a", day(7), False), ("r", "a", day(0), None), ("x", "other", day(0), True)]
    out = {r.side: r for r in reports.sample_audit(scores(spark, rows), ["side"], "model", "d", ["b", "a"]).collect()}
    assert (out["l"].common_n, out["l"].date_start, out["l"].joint_exceptions, out["l"].metric_status, out["l"].test_status) == (295, day(5), 29, "ok", "ok")
    assert json.loads(out["r"].missing_json) == ["b"] and out["r"].metric_status == "unavailable_missing_model" and out["r"].common_n == 1
    assert json.loads(out["x"].missing_json) == ["a", "b"] and out["x"].joint_rate is None and json.loads(out["x"].entities_json) == []
    few = reports.sample_audit(scores(spark, rows).filter("dayofyear(d) < 200 and side = 'l'"), ["side"], "model", "d", ["a", "b"]).first()
    assert (few.metric_status, few.test_status) == ("ok", "unavailable_few_common_days")


def test_standardised_falls_back_to_scores(spark):
    rows = [("a", 1.0, 0.5), ("a", 2.0, float("nan")), ("a", 3.0, -1.0), ("b", 1.0, None), ("b", 3.0, float("inf")), ("c", 4.0, None), ("c", 4.0, None)]
    out = reports.standardised(spark.createDataFrame(rows, "k string, x double, e double"), ["k"], "x", "e").collect()
    got = sorted((r.k, r.standardised) for r in out)
    assert got == [("a", -0.5), ("a", 1.0), ("b", pytest.approx(-(0.5**0.5))), ("b", pytest.approx(0.5**0.5)), ("c", 0.0), ("c", 0.0)]


def test_publishable_needs_its_columns(spark):
    df = spark.createDataFrame([("primary_common_sample", "ok", "ok", True), ("primary_common_sample", "ok", "failed", True), ("primary_common_sample", "ok", "ok", None)], "sample_policy string, common_sample_status string, fit_status string, is_valid_forecast boolean")
    assert reports.publishable(df).count() == 1
    assert reports.publishable(df.drop("fit_status", "is_valid_forecast")).count() == 3
    assert reports.publishable(df.drop("sample_policy")).count() == 0


def test_value_range_over_frames_that_have_the_column(spark):
    a, b = spark.createDataFrame([(1.0,), (float("nan"),)], "s double"), spark.createDataFrame([("x",)], "other string")
    assert tuple(reports.value_range([a, b, a.withColumn("s", F.col("s") * 4)], "s").first()) == (2, 1.0, 4.0)
    assert tuple(reports.value_range([b], "s").first()) == (0, None, None)


def test_passing_wants_each_scenario(spark):
    rows = [("a", True), ("a", True), ("b", True), ("c", True), ("c", None), ("d", True), ("d", False)]
    df = spark.createDataFrame(rows, "model string, ok boolean")
    assert [r.model for r in reports.passing(df, "model", F.col("ok"), 2).collect()] == ["a"]


def test_job_ids_name_their_settings(spark):
    keys = spark.createDataFrame([("l", "s"), ("l", "s"), ("r", None)], "side string, block string")
    jobs = reports.job_grid(keys, ["m", "n"], "evt", {"low": 0.8, "high": 0.9}, 0.95).collect()
    assert len(jobs) == 8 and len({j.job for j in jobs}) == 8 and not any(j.primary_claim_allowed for j in jobs)
    with pytest.raises(ValueError, match="below the level"):
        reports.job_grid(keys, ["m"], "evt", {"base": 0.95}, 0.95)


def test_overlay_takes_one_benchmark_for_each_key(spark):
    rows = [("l", "main", 1), ("l", "stand_in", 1), ("r", "stand_in", 1), ("r", "x", 0), ("r", "x", 1), ("r", "y", 1)]
    out = reports.overlay(spark.createDataFrame(rows, "side string, model string, ok int"), ["side"], "model", ["main", "stand_in"], ["x"], F.col("ok") == 1)
    assert sorted((r.side, r.plot_group, r.plot_order) for r in out.collect()) == [("l", "main", 0), ("r", "stand_in", 0), ("r", "x", 1)]


@pytest.mark.parametrize("buckets", [1, 7, 1000])
def test_expectiles_are_exact(spark, buckets):
    rng = np.random.default_rng(4)
    series = {"normal": rng.normal(size=900), "ties": rng.integers(-3, 4, 700).astype(float), "one": np.array([2.5]), "same": np.full(5, -1.0), "two": np.array([0.0, 1.0])}
    df = spark.createDataFrame([(k, float(v)) for k, x in series.items() for v in x] + [("normal", None), ("normal", float("nan"))], "k string, x double")
    taus = (0.05, 0.5, 0.9, 0.995)
    out = {(r.k, r.tau): r for r in reports.expectiles(df, ["k"], "x", taus, buckets).collect()}
    assert len(out) == len(series) * len(taus)
    for (k, tau), r in out.items():
        x = series[k]
        assert r.expectile == pytest.approx(numerics.expectile(x, tau), abs=1e-9)
        assert r.breach_rate == pytest.approx((x > r.expectile + 1e-12).mean())


@pytest.mark.parametrize("size", [8, 100, 5000])
def test_block_maxima_do_not_depend_on_parts(spark, size):
    rng = np.random.default_rng(9)
    series = {"a": rng.pareto(3, 700), "b": rng.integers(0, 5, 331).astype(float)}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)], "k string, pos long, x double")
    sizes = lambda n: [1, 5, 17, n // 10]
    out = select.order_statistics(blocks.block_maxima(df, ["k"], "x", sizes, size=size), ["k", "block"], "v", {"median": 0.5}, weight="m").collect()
    assert {(r.k, r.block) for r in out} == {(k, b) for k, x in series.items() for b in sizes(len(x))}
    for r in out:
        x = series[r.k]
        assert r.n == len(x) - r.block + 1
        assert r.median == np.median(np.lib.stride_tricks.sliding_window_view(x, r.block).max(1))


def test_exceedances_know_the_value_below(spark):
    x = np.random.default_rng(2).normal(size=500)
    df = spark.createDataFrame([(None, float(v)) for v in x], "k string, x double")
    out = select.exceedances(df, ["k"], "x", {"a": 0.8, "b": 0.99}).toPandas()
    for q in (0.8, 0.99):
        g, u = out[out.q == q], np.quantile(x, q)
        assert sorted(g.x) == sorted(x[x > u]) and (g.n == 500).all()
        assert g.u.iloc[0] == pytest.approx(u) and g.below.iloc[0] == x[x <= u].max()


def test_tail_queries_equal_fits_of_the_whole_series(spark):
    from tidemark.plans import models
    from tidemark.plans import views as V

    sf = "/root/testdata/sf0.001"
    x = {k: g.sort_values("d").loss.to_numpy(float) for k, g in V.losses(spark, sf).toPandas().groupby("side")}
    for r in models.pot_gpd_tail(spark, sf).collect():
        want = numerics.gpd_tail(x[r.side], 0.9, 0.99)
        assert all(getattr(r, c) == pytest.approx(v, rel=1e-3) for c, v in want.items())
    for r in models.gpd_stability(spark, sf).collect():
        k = int((x[r.side] > np.quantile(x[r.side], r.q)).sum())
        assert r.hill == pytest.approx(numerics.hill(x[r.side], k)) and (r.delta is None) == (r.q == 0.8)
    shapes = {r.side: r for r in models.block_maxima_shape(spark, sf).collect()}
    assert all(getattr(shapes[k], c) == pytest.approx(w) for k in x for c, w in numerics.block_shape(x[k]).items())
    variants = models.evt_shape_variants(spark, sf).collect()
    assert len(variants) == 4 and all(math.isfinite(r.var) for r in variants)
    assert all(r.xi == pytest.approx(min(0.5, max(-0.5, shapes[r.side].shape))) for r in variants if r.variant == "unibm")
