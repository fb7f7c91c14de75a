from __future__ import annotations

import math

import numpy as np
import pytest

from tidemark.operators import numerics as N

from .test_registry import SF, canon

needs_tables = pytest.mark.skipif(not SF.exists(), reason="test tables are not here")


def audited():
    from tidemark.plans import audit

    return sorted(audit.Q)


@needs_tables
@pytest.mark.parametrize("name", [*audited(), "pit_panel_long", "pit_panel_wide", "averaged_carry", "caviar_filter", "reason_explode", "hill_mean_excess_survival"])
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from tidemark.plans import registry

    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    df = registry.queries()[name](spark, str(SF))
    want = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    got = canon(df.select(*columns).collect())
    assert got == canon(want.fetchall()) and got


@needs_tables
def test_no_panel_value_is_known_after_its_day(spark):
    from tidemark.plans import registry

    rows = registry.queries()["pit_panel_wide"](spark, str(SF)).collect()
    assert any(r.option_iv is not None for r in rows)
    assert all(r.option_available <= r.d for r in rows if r.option_iv is not None)


def test_plateau_window_equals_a_search_by_refitting():
    rng = np.random.default_rng(3)
    for n in (6, 11, 24):
        x = np.sort(rng.random(n)) * 3 + np.arange(n)
        y = 0.3 * x + rng.normal(0, 0.05, n)
        cut = int(n * 0.15)
        cut = cut if n - 2 * cut >= 5 else 0
        scores = {}
        for a in range(cut, n - cut):
            for b in range(a + 5, n - cut + 1):
                line = np.polyfit(x[a:b], y[a:b], 1)
                turn = np.abs(np.diff(np.diff(y[a:b]) / np.diff(x[a:b]))).mean()
                scores[a, b] = (((np.polyval(line, x[a:b]) - y[a:b]) ** 2).mean() + 2 * turn) / math.sqrt(b - a)
        start, stop, score = N.plateau_window(x, y)
        assert (start, stop) == min(scores, key=scores.get)
        assert score == pytest.approx(scores[start, stop])


def test_robust_errors_and_fixed_shape_scale():
    rng = np.random.default_rng(4)
    x = np.arange(40.0)
    y = 1 + 2 * x + rng.normal(0, 1 + x / 20)
    b, slope, se = N.ols_hc0(x, y)
    design = np.column_stack([np.ones(40), x])
    inverse = np.linalg.inv(design.T @ design)
    e = y - design @ np.array([b, slope])
    assert np.allclose([b, slope], np.polyfit(x, y, 1)[::-1])
    assert se == pytest.approx(math.sqrt((inverse @ (design.T * e**2) @ design @ inverse)[1, 1]))
    for xi in (0.2, 0.0, -0.2):
        u = rng.random(4000)
        excess = 2.0 * (u**-xi - 1) / xi if xi else -2.0 * np.log(u)
        scale, inside = N.gpd_scale(excess, xi)
        assert inside and scale == pytest.approx(2.0, rel=0.1)


@needs_tables
def test_model_sequences(spark):
    from tidemark.plans import registry

    q = registry.queries()
    shapes = q["evt_shape_variants"](spark, str(SF)).collect()
    assert {r.variant for r in shapes} == {"plain_mle", "unibm"} and all(r.es >= r.var for r in shapes)
    assert all(r.es >= r.var for r in q["gas_pot_tail"](spark, str(SF)).collect())
    pairs = q["pairwise_dm"](spark, str(SF)).collect()
    assert len(pairs) == 6 and all(0 < r.p_less <= 1 and r.p_less + r.p_greater > 0.9 for r in pairs)
