from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import boosting, origins


def data(n, seed=0):
    """Skewed targets whose spread and centre move with two of five features; values are missing, tied and infinite."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 5)), 1)
    x[rng.random((n, 5)) < 0.05] = np.nan
    x[0, 0], x[1, 1] = np.inf, -np.inf
    centre, spread = np.nan_to_num(x[:, 0], posinf=0), np.exp(0.5 * np.nan_to_num(x[:, 1], neginf=0))
    return x, centre + spread * rng.gamma(2, 1, n)


def frame(spark, x, y):
    out = pd.DataFrame(x, columns=[f"f{k}" for k in range(x.shape[1])])
    out["y"] = y
    return spark.createDataFrame(out).repartition(5)


def same(a, b):
    for s, t in zip(a.trees, b.trees, strict=True):
        assert (s.feature, s.cut, s.left, s.right) == (t.feature, t.cut, t.left, t.right)
        assert s.value == pytest.approx(t.value, rel=1e-9, abs=1e-12)


@pytest.mark.parametrize("level", [0.9, None])
def test_trees_over_rows_are_those_of_arrays_on_the_same_bins(spark, monkeypatch, level):
    monkeypatch.setattr(boosting, "REFRESH", 3)
    x, y = data(1500)
    df = frame(spark, x, y)
    names = [f"f{k}" for k in range(5)]
    edges = boosting.sketched_edges(df, names, 16)
    far = boosting.fit_rows(df, names, "y", level, trees=7, rate=0.3, leaves=6, bins=16)
    near = boosting.boost(boosting.Memory(boosting.binned(x, edges), y, level, 16), edges, level, 7, 0.3, 6, 20)
    assert far.base == pytest.approx(near.base, rel=1e-12) and all((a == b).all() for a, b in zip(far.edges, edges, strict=True))
    same(far, near)
    out = boosting.predict_rows(df, names, far).toPandas()
    assert out.predicted.to_numpy() == pytest.approx(near.predict(out[names].to_numpy()), rel=1e-12)


def test_splits_are_the_best_of_all():
    """One split by trying every cut, and leaf values by sorting."""
    x, y = data(400, 2)
    edges = boosting.edges_of(x, 8)
    codes = boosting.binned(x, edges)
    model = boosting.boost(boosting.Memory(codes, y, 0.8, 8), edges, 0.8, 1, 1.0, 2, 10)
    g = 0.8 - (y < model.base)
    best = max((g[m].sum() ** 2 / m.sum() + g[~m].sum() ** 2 / (~m).sum(), -f, -c) for f in range(5) for c in range(7) for m in [codes[:, f] <= c] if min(m.sum(), (~m).sum()) >= 10)
    tree = model.trees[0]
    left = codes[:, tree.feature[0]] <= tree.cut[0]
    assert g[left].sum() ** 2 / left.sum() + g[~left].sum() ** 2 / (~left).sum() == pytest.approx(best[0])
    r, span = np.sort(y[left] - model.base), y.max() - y.min()
    assert tree.value[1] == pytest.approx(r[int(np.ceil(0.8 * len(r))) - 1], abs=2 * span / boosting.STEPS**2)


def test_forecasts_cover_what_they_should():
    x, y = data(3000, 1)
    for level in (0.5, 0.95):
        model = boosting.fit(x[:2000], y[:2000], level)
        assert len(model.trees) == 160 and max(sum(f < 0 for f in t.feature) for t in model.trees) == 20
        assert (y[2000:] <= model.predict(x[2000:])).mean() == pytest.approx(level, abs=0.04)
    mean = boosting.fit(x[:2000], y[:2000], None)
    assert np.corrcoef(mean.predict(x[2000:]), y[2000:])[0, 1] > 0.55


def test_rows_without_values_or_choice(spark):
    x = np.column_stack([np.full(60, np.nan), np.ones(60)])
    y = np.arange(60.0)
    model = boosting.fit_rows(frame(spark, x, y), ["f0", "f1"], "y", 0.5, trees=2, bins=8)
    assert [t.feature for t in model.trees] == [[-1], [-1]] and model.predict(x)[0] == pytest.approx(29, abs=0.1)
    with pytest.raises(ValueError):
        boosting.fit_rows(frame(spark, x, np.full(60, np.nan)), ["f0"], "y", 0.5)


def test_tables_of_leaves_give_the_nodes_of_a_walk():
    rng = np.random.default_rng(6)
    codes = rng.integers(0, 16, (5000, 4)).astype(np.uint8)
    for leaves in (1, 2, 20, 64, 65, 150):
        tree = boosting.Tree()
        while tree.feature.count(-1) < leaves:
            node = int(rng.choice([k for k, f in enumerate(tree.feature) if f < 0]))
            if len(np.unique(some := codes[tree.nodes(codes) == node], axis=0)) > 1:
                f = int(rng.choice([k for k in range(4) if len(np.unique(some[:, k])) > 1]))
                tree.split(node, f, int(rng.choice(np.unique(some[:, f])[:-1])))
        look = boosting.Leaves(tree)
        assert (np.array(look.ends)[look.places(codes.T)] == tree.nodes(codes)).all()


def test_one_part_is_dealt_over_all_tasks_in_blocks(spark, monkeypatch):
    """Passes over a file of one part had one task, whatever the cores, and moved single rows."""
    monkeypatch.setattr(boosting, "BLOCK", 100)
    x, y = data(1500, 3)
    y[7] = np.nan
    df = frame(spark, x, y).coalesce(1)
    names = [f"f{k}" for k in range(5)]
    edges = boosting.sketched_edges(df, names, 16)
    table = boosting.binned_rows(df, names, "y", edges)
    parts = [len(p) for p in table.rdd.glom().collect()]
    assert sum(parts) == 15 and max(parts) <= 3
    blocks = table.collect()
    assert sum(b.rows for b in blocks) == 1499 and max(b.rows for b in blocks) == 100
    pairs = sorted((v, *c) for b in blocks for v, c in zip(np.frombuffer(b.y).tolist(), np.frombuffer(b.codes, np.uint8).reshape(5, -1).T.tolist(), strict=True))
    good = np.isfinite(y)
    assert pairs == sorted((v, *c) for v, c in zip(y[good].tolist(), boosting.binned(x[good], edges).tolist(), strict=True))


def test_a_quantile_tree_takes_a_pass_for_each_level_and_two_for_its_leaves(spark, monkeypatch):
    x, y = data(600, 5)
    passes, passed = [], boosting.Rows._passed
    monkeypatch.setattr(boosting.Rows, "_passed", lambda self, tree, *a: passes.append(len(tree.feature)) or passed(self, tree, *a))
    model = boosting.fit_rows(frame(spark, x, y), [f"f{k}" for k in range(5)], "y", 0.8, trees=2, rate=0.3, leaves=4, bins=16)
    assert [sum(f < 0 for f in t.feature) for t in model.trees] == [4, 4]
    assert passes == [1, 1, *[1, 3, 7, 7] * 2]


def test_boosted_jobs_stand_alone_and_see_no_later_day(spark):
    rng = np.random.default_rng(4)
    days = [dt.date(2019, 1, 1) + dt.timedelta(days=k) for k in range(470)]
    rows = [("l", d, float(v), float(a), float(b)) for d, v, a, b in zip(days, rng.normal(size=470), rng.normal(size=470), rng.normal(size=470), strict=True)]
    df = spark.createDataFrame(rows, "side string, d date, loss double, a double, b double").repartition(3)
    args = (["side"], "d", "loss", {"A": ["a"], "B": ["b", "a"]})
    shape = {"trees": 8, "rate": 0.2, "leaves": 4}
    for method, models in (("quantile", 1), ("location_scale", 1), ("robust", 2)):
        of = lambda rows: {(r.infoset, r.model, r.d): (r.var, r.es, r.status) for r in rows}
        whole = of(origins.boosted(df, *args, method, 0.8, 400, **shape).collect())
        assert len(whole) == 70 * 2 * models and all(v[1] >= v[0] for v in whole.values())
        later = df.withColumn("loss", df.loss * (1 + 4 * (df.d > days[449]).cast("int")))
        alone = of(origins.boosted(later, *args, method, 0.8, 400, only=[2], **shape).collect())
        assert alone and all(whole[k] == v for k, v in alone.items() if k[2] <= days[449])
    by_hand = boosting.fit(np.array([[r[4], r[3]] for r in rows[:400]]), np.array([r[2] for r in rows[:400]]), 0.8, **shape)
    got = of(origins.boosted(df, *args, "quantile", 0.8, 400, only=[1], **shape).collect())
    assert got["B", "direct", days[400]][0] == pytest.approx(by_hand.predict(np.array([[rows[400][4], rows[400][3]]]))[0])
