from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import blocks as B
from tidemark.operators import evaluate as E


def series(spark, n, seed=0):
    """Two keys, one of them null, with ties and outliers, in no order."""
    rng = np.random.default_rng(seed)
    x, y = np.round(rng.standard_t(3, n), 2), rng.normal(5, 1e-3, n // 2)
    frame = pd.DataFrame({"k": ["a"] * n + [None] * (n // 2), "t": [*range(n), *range(n // 2)], "x": np.r_[x, y]}).sample(frac=1, random_state=1)
    return {"a": x, None: y}, spark.createDataFrame(frame, "k string, t long, x double").repartition(5)


def split(out):
    return {k: out[out.k.isna() if k is None else out.k == k].sort_values("t").reset_index(drop=True) for k in ("a", None)}


@pytest.mark.parametrize("n,size,window", [(500, 64, 50), (120, 1000, 30), (300, 40, 100)])
def test_histories_are_those_of_brute_force(spark, n, size, window):
    """Many blocks, one block, and a window over several blocks."""
    want, df = series(spark, n)
    p = B.positions(df, ["k"], "t")
    got = split(B.quantiles(B.moments(p, ["k"], "x", 0.94, size=size), ["k"], "x", 0.95, window, size=size).toPandas())
    for k, s in want.items():
        g = got[k]
        assert (g.pos == g.t).all() and len(g) == len(s) and g.q_all.isna()[0]
        for i in range(1, len(s)):
            for name, h in (("all", s[:i]), ("recent", s[max(0, i - window) : i])):
                q = np.quantile(h, 0.95)
                above = h[h > q]
                assert g[f"q_{name}"][i] == pytest.approx(q, abs=1e-12)
                assert g[f"es_{name}"][i] == pytest.approx(max(q, above.mean()) if len(above) else q, abs=1e-9)
            assert g["mean"][i] == pytest.approx(s[:i].mean(), abs=1e-12)
            if i > 1:
                v = s[:i].var(ddof=1)
                for e in s[:i]:
                    v = 0.94 * v + 0.06 * (e - s[:i].mean()) ** 2
                assert g.ewma[i] == pytest.approx(v, rel=1e-9, abs=1e-12)


def test_filters_of_long_series_stay_exact(spark):
    """50,000 rows: weights of the first ones are far beyond what doubles hold."""
    want, df = series(spark, 50_000)
    p = B.positions(df.filter("k = 'a'"), ["k"], "t")
    out = B.linear_filter(p, ["k"], {"y": 0.05 + 0.25 * F.abs("x"), "z": F.col("x")}, 0.8, 0.5)
    out = B.moments(out, ["k"], "x", 0.94).orderBy("t").toPandas()
    y = z = 0.5
    for i, x in enumerate(want["a"]):
        if i % 997 == 0 or i > 49_990:
            assert out.y[i] == pytest.approx(y, rel=1e-10) and out.z[i] == pytest.approx(z, rel=1e-9, abs=1e-10)
        y, z = 0.05 + 0.8 * y + 0.25 * abs(x), 0.8 * z + x
    for i in (2, 11_000, 49_999):
        h = want["a"][:i]
        v = h.var(ddof=1)
        for e in h:
            v = 0.94 * v + 0.06 * (e - h.mean()) ** 2
        assert out.ewma[i] == pytest.approx(v, rel=1e-8)


def test_slow_and_negative_decays(spark):
    want, df = series(spark, 400)
    p = B.positions(df, ["k"], "t")
    for decay in (0.9999, -0.5, 1e-6):
        got = split(B.linear_filter(p, ["k"], {"y": F.col("x")}, decay, 2.0, size=50).toPandas())
        for k, s in want.items():
            y = 2.0
            for i, x in enumerate(s):
                assert got[k].y[i] == pytest.approx(y, rel=1e-9, abs=1e-9)
                y = decay * y + x
    with pytest.raises(ValueError):
        B.linear_filter(p, ["k"], {"y": F.col("x")}, 1.0)


def test_rank_tree_gives_order_statistics_and_what_lies_above():
    rng = np.random.default_rng(3)
    v, w = rng.integers(0, 9, 200).astype(float), rng.integers(1, 4, 200)
    tree = B.RankTree(v, w)
    lo, hi = np.sort(rng.integers(0, 201, (2, 400)), axis=0)
    lo, hi = lo[hi > lo], hi[hi > lo]
    k = np.array([rng.integers(0, w[a:b].sum()) for a, b in zip(lo, hi, strict=True)])
    low, more, total = tree.select(lo, hi, k)
    for j, (a, b) in enumerate(zip(lo, hi, strict=True)):
        items = np.sort(np.repeat(v[a:b], w[a:b]))
        assert low[j] == items[k[j]] and more[j] == (items > low[j]).sum() and total[j] == pytest.approx(items[items > low[j]].sum())


def test_blocks_of_no_rows_and_one_row(spark):
    df = spark.createDataFrame([("a", 1, 2.0)], "k string, t long, x double")
    for rows in (df, df.limit(0)):
        p = B.positions(rows, ["k"], "t")
        out = B.quantiles(B.moments(p, ["k"], "x", 0.9), ["k"], "x", 0.95, 5).collect()
        assert [(r.pos, r.q_all, r.mean) for r in out] == [(0, None, None)] * len(out) and len(out) == rows.count()


def test_bootstrap_draws_blocks_of_the_circle(spark):
    import hashlib

    rng = np.random.default_rng(1)
    x = rng.normal(-0.1, 1, 211)
    df = spark.createDataFrame([("m", k, float(v)) for k, v in enumerate(x)], "k string, d long, x double").repartition(4)
    drawn = E.bootstrap_sums(df, ["k"], "d", "x", 60)
    got = {r.draw: r.drawn for r in drawn.collect()}
    want = {}
    for draw in range(1, 61):
        at = []
        for b in range(-(-211 // 6)):
            start = int(hashlib.md5(f"225:{draw}:{b}".encode()).hexdigest()[:8], 16) % 211
            at += [(start + j) % 211 for j in range(min(6, 211 - 6 * b))]
        want[draw] = x[at].sum()
    assert got == pytest.approx(want)
    row = E.one_sided(drawn, ["k"]).first()
    moved = np.array(list(want.values())) / 211 - x.mean()
    assert row.p_less == pytest.approx(((moved <= x.mean()).sum() + 1) / 61) and row.p_greater == pytest.approx(((moved >= x.mean()).sum() + 1) / 61)
    assert (row.pairs, row.block) == (211, 6) and row["mean"] == pytest.approx(x.mean())
