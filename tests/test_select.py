from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import blocks as B
from tidemark.operators.asof import interval_join
from tidemark.operators.select import order_statistics


def test_order_statistics_are_exact(spark):
    """Ties, negative and tiny values, one value, nulls, NaN, a null key, and many values in one bin."""
    rng = np.random.default_rng(0)
    groups = {"ties": rng.integers(-3, 4, 200).astype(float), "wide": rng.standard_cauchy(301) * 10.0 ** rng.integers(-8, 8, 301), "one": np.array([2.5]), "near": 1 + rng.random(150) * 1e-9, None: rng.normal(size=40), "two": np.array([-1.0, 5.0])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("ties", None), ("ties", float("nan")), ("none", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    names = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q95": 0.95, "q1": 1.0}
    got = {r.k: r for r in order_statistics(df, ["k"], "x", names, {"trimmed": 0.2, "halved": 0.45}).collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        assert got[k].n == len(v)
        for name, p in names.items():
            assert got[k][name] == pytest.approx(np.quantile(v, p), rel=1e-12, abs=1e-300)
        for name, t in (("trimmed", 0.2), ("halved", 0.45)):
            c = int(len(v) * t)
            assert got[k][name] == pytest.approx(np.sort(v)[c : len(v) - c].mean(), rel=1e-9, abs=1e-12)


@pytest.mark.parametrize("window", [1, 7, 64])
def test_sliding_moments_are_those_of_each_window(spark, window):
    rng = np.random.default_rng(1)
    series = {"a": rng.gamma(2, 1, 150), "b": np.append(rng.normal(1e3, 1e-2, 70), [np.nan])}
    rows = [(k, j, None if np.isnan(x) else float(x)) for k, v in series.items() for j, x in enumerate(v)]
    p = B.positions(spark.createDataFrame(rows, "k string, t int, x double").repartition(4), ["k"], "t")
    out = B.sliding_moments(B.sliding_sums(p, ["k"], {"total": F.col("x")}, window), ["k"], "x", window).toPandas()
    for k, v in series.items():
        g = out[out.k == k].sort_values("t").reset_index(drop=True)
        for i in range(len(v)):
            h = v[max(0, i - window + 1) : i + 1]
            h = h[~np.isnan(h)]
            assert g.n[i] == len(h) and g.total[i] == pytest.approx(h.sum(), rel=1e-12, abs=1e-12)
            if len(h):
                assert g["mean"][i] == pytest.approx(h.mean(), rel=1e-12)
            if len(h) > 2:
                z = (h - h.mean()) / h.std(ddof=1)
                assert g["skew"][i] == pytest.approx((z**3).mean(), abs=1e-5) and g["kurt"][i] == pytest.approx((z**4).mean() - 3, abs=1e-5)
            elif len(h) == 1:
                assert pd.isna(g["skew"][i]) and pd.isna(g.sd[i])


def test_interval_join_is_the_nested_loop(spark):
    rng = np.random.default_rng(2)
    day = lambda k: dt.date(2020, 1, 1) + dt.timedelta(days=int(k))
    points = [("a" if k % 3 else None, day(rng.integers(0, 300)), k) for k in range(60)]
    intervals = [("a" if k % 2 else None, day(low), day(low + rng.integers(-2, 90)), k) for k, low in enumerate(rng.integers(-40, 320, 50))] + [("b", day(1), day(9), 50), ("a", None, day(9), 51)]
    p = spark.createDataFrame(points, "k string, at date, p int")
    i = spark.createDataFrame(intervals, "k string, low date, high date, i int").repartition(3)
    want = {(i, p) for k, low, high, i in intervals for q, at, p in points if k == q and low and low <= at <= high}
    inner = interval_join(p, i, "at", "low", "high", ["k"])
    assert {(r.i, r.p) for r in inner.collect()} == want and inner.count() == len(want)
    outer = interval_join(p, i, "at", "low", "high", ["k"], 7, "left").collect()
    assert {(r.i, r.p) for r in outer} == want | {(r[3], None) for r in intervals if r[3] not in {i for i, _ in want}}
    plan = inner._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
