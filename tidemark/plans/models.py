"""Queries whose operators need iterative numerics, storage or streams.

Model fits run as one group for each job (side x model); a job's history is bounded by the
number of days.  They have no SQL form; tests hold them against known values and invariants.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import options
from ..operators import rolling as R
from ..operators.quality import table_signature
from ..operators.reports import expectiles
from ..operators.select import exceedances, order_statistics
from ..operators.store import materialise
from . import views as V
from .panel import S, r, text


def black_scholes_iv(spark: SparkSession, sf: str) -> DataFrame:
    """Price the nearest contracts at a known volatility and recover it."""
    near = options.nearest(V.surface(spark, sf).filter("pc is not null"), ["d", "pc"], "strike", "spot", "dte", ["contract", "okey"])
    rows = near.select("d", "pc", "strike", "spot", (S("dte") / 365).alias("years"), (S("iv") + 0.1).alias("sigma"))

    def run(batches):
        from ..operators.numerics import black_scholes, implied_vol

        for p in batches:
            args = (p.pc.to_numpy(), p.spot.to_numpy(), p.strike.to_numpy(), p.years.to_numpy())
            price = black_scholes(*args, 0.01, p.sigma.to_numpy())
            yield pd.DataFrame({"d": p.d.astype(str), "pc": p.pc, "sigma": p.sigma, "price": price, "implied": implied_vol(args[0], price, *args[1:], 0.01)})

    return rows.mapInPandas(run, "d string, pc string, sigma double, price double, implied double")


def _fit(spark: SparkSession, sf: str, schema: str, fit) -> DataFrame:
    """One group for each side: `fit(side, losses, days)` gives rows of the schema."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("d")
        return pd.DataFrame(fit(pdf.side.iloc[0], pdf.loss.to_numpy(float), pdf.d.astype(str).to_numpy()))

    return V.losses(spark, sf).groupBy("side").applyInPandas(run, schema)


def _over(spark: SparkSession, sf: str, grid: dict[str, float], schema: str, fit, jobs: list[str] | None = None, beside: DataFrame | None = None) -> DataFrame:
    """One group for each side, threshold and job, with only the losses above the threshold in it: `fit(first row, excesses)` gives a row.
    `beside` joins columns by side."""
    e = exceedances(V.losses(spark, sf), ["side"], "loss", grid).withColumn("job", F.explode(F.array(*[F.lit(j) for j in jobs or ["one"]])))
    if beside is not None:
        e = e.join(beside, "side")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([fit(pdf.iloc[0], np.sort(pdf.loss.to_numpy(float)) - pdf.u.iloc[0])])

    return e.repartition(2 * len(grid) * len(jobs or [0]), "side", "q", "job").groupBy("side", "q", "job").applyInPandas(run, schema)


def pot_gpd_tail(spark: SparkSession, sf: str) -> DataFrame:
    def fit(row, excess):
        from ..operators.numerics import gpd_fit, gpd_quantiles

        xi, scale = gpd_fit(excess)
        var, es = gpd_quantiles(row.u, xi, scale, len(excess) / row.n, 0.99)
        return {"side": row.side, "threshold": row.u, "exceedances": float(len(excess)), "xi": xi, "scale": scale, "var": var, "es": es}

    return _over(spark, sf, {"q": 0.9}, "side string, threshold double, exceedances double, xi double, scale double, var double, es double", fit)


def gpd_stability(spark: SparkSession, sf: str) -> DataFrame:
    """Shape by threshold, with the change to the previous one; the Hill estimate and clipped shape beside it."""

    def fit(row, excess):
        from ..operators.numerics import gpd_fit

        xi = gpd_fit(excess)[0]
        return {"side": row.side, "q": row.q, "xi": xi, "capped_xi": min(max(xi, -0.5), 0.5), "hill": float(np.log((excess + row.u) / row.below).mean())}

    grid = {f"q{i}": q for i, q in enumerate((0.80, 0.85, 0.90, 0.925, 0.95))}
    out = _over(spark, sf, grid, "side string, q double, xi double, capped_xi double, hill double", fit)
    before = F.lag("xi").over(Window.partitionBy("side").orderBy("q"))
    return out.select("side", "q", "xi", "capped_xi", (S("xi") - before).alias("delta"), "hill")


def evi_anchor(spark: SparkSession, sf: str) -> DataFrame:
    def fit(side, x, _):
        from ..operators.numerics import dedh, hill, plateau_shape

        k = max(20, len(x) // 20)
        return [{"side": side, "k": k, "hill": hill(x, k), "dedh": dedh(x, k), "plateau": plateau_shape(x, [5, 10, 20, 40])}]

    return _fit(spark, sf, "side string, k long, hill double, dedh double, plateau double", fit)


def _fits(spark: SparkSession, sf: str, models: list[str], schema: str, rows) -> DataFrame:
    """One group for each side and model, fitted to the whole series: `rows(side, fit, next)` gives rows of the schema, with the names'
    forecasts (var, es) for the day after the last."""
    from ..operators import tails

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("d").loss.to_numpy(float)
        fit = tails.MODELS[key[1]].fit(x, V.LEVEL, None, {})
        ahead = tails.MODELS[key[1]].forecast(x, np.zeros(1), V.LEVEL, fit)
        return pd.DataFrame(rows(key[0], fit, {name: (float(var[0]), float(es[0])) for name, (var, es) in ahead.items()}))

    dealt = V.losses(spark, sf).withColumn("job", F.explode(F.array(*[F.lit(m) for m in models])))
    return dealt.repartition(2 * len(models), "side", "job").groupBy("side", "job").applyInPandas(run, schema)


def garch_t_tail(spark: SparkSession, sf: str) -> DataFrame:
    def rows(side, fit, ahead):
        name = next(n for n in ahead if n.endswith("garch_t"))
        return [{"side": side, "model": name, "var": ahead[name][0], "es": ahead[name][1], "nu": fit.extra["nu"], "persistence": fit.extra["persistence"], "loss": fit.value}]

    return _fits(spark, sf, ["garch", "gjr_garch"], "side string, model string, var double, es double, nu double, persistence double, loss double", rows)


def caviar_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Fitted recursions with the multiplier that turns VaR into ES; care is the expectile form."""

    def rows(side, fit, ahead):
        return [{"side": side, "model": n, "persistence": fit.params[1], "next_var": v, "next_es": e, "breach_rate": fit.extra["breach_rate"]} for n, (v, e) in ahead.items()]

    return _fits(spark, sf, ["caviar_sav", "caviar_as", "care_sav"], "side string, model string, persistence double, next_var double, next_es double, breach_rate double", rows)


def block_maxima_shape(spark: SparkSession, sf: str) -> DataFrame:
    """Tail shape by medians of sliding block maxima over the best plateau, with a robust standard error.  Maxima come from parts of the
    series and medians from counts; only a median for each block size reaches the fit."""
    from ..operators import blocks as B

    series = materialise(B.positions(V.losses(spark, sf), ["side"], "d"), "positions")
    medians = order_statistics(B.block_maxima(series, ["side"], "loss"), ["side", "block"], "v", {"median": 0.5}, weight="m")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from ..operators.numerics import shape_of_medians

        points = pdf.sort_values("block")[["block", "median"]].itertuples(index=False, name=None)
        return pd.DataFrame([{"side": pdf.side.iloc[0], **shape_of_medians(list(points))}])

    return medians.select("side", "block", "median").groupBy("side").applyInPandas(run, "side string, shape double, standard_error double, score double, points double, low_block double, high_block double")


def evt_shape_variants(spark: SparkSession, sf: str) -> DataFrame:
    """The tail under the shape of greatest likelihood and under the block-maxima shape, with the scale refitted to it; neither
    stands in for the other."""

    def fit(row, excess):
        from ..operators.numerics import gpd_fit, gpd_quantiles, gpd_scale

        xi = float(np.clip(gpd_fit(excess)[0] if row.job == "plain_mle" else row["shape"], -0.5, 0.5))
        scale, inside = gpd_scale(excess, xi)
        var, es = gpd_quantiles(row.u, xi, scale, len(excess) / row.n, 0.99)
        return {"side": row.side, "variant": row.job, "xi": xi, "scale": scale, "status": "ok" if inside else "support_violation", "var": var, "es": es}

    schema = "side string, variant string, xi double, scale double, status string, var double, es double"
    return _over(spark, sf, {"q": 0.9}, schema, fit, ["plain_mle", "unibm"], block_maxima_shape(spark, sf).select("side", "shape"))


def gas_pot_tail(spark: SparkSession, sf: str) -> DataFrame:
    """The score-driven scale with a generalised Pareto tail on the losses over it."""

    def rows(side, fit, ahead):
        var, es = ahead["gas_t_evt"]
        return [{"side": side, "var": var, "es": es, "exceedances": fit.extra["exceedances"], "scale_next": (var - fit.params[0]) / fit.extra["evt_var"]}]

    return _fits(spark, sf, ["score"], "side string, var double, es double, exceedances long, scale_next double", rows)


def gas_t_fit(spark: SparkSession, sf: str) -> DataFrame:
    def rows(side, fit, ahead):
        return [{"side": side, "var": ahead["gas_t"][0], "es": ahead["gas_t"][1], "nu": fit.extra["nu"], "loss": fit.value}]

    return _fits(spark, sf, ["score"], "side string, var double, es double, nu double, loss double", rows)


def origins(spark: SparkSession, sf: str, models: list[str] | None = None) -> DataFrame:
    """d, side, model, refit, loss, var, es, status: forecasts of fitted models, refitted each month in jobs of their own."""
    from ..operators import origins as O

    return O.forecasts(V.losses(spark, sf), ["side"], "d", "loss", models, V.LEVEL)


def rolling_origin_forecasts(spark: SparkSession, sf: str) -> DataFrame:
    return origins(spark, sf).select(text("d").alias("d"), "side", "model", "refit", "loss", "var", "es", "status")


def rolling_origin_caviar(spark: SparkSession, sf: str) -> DataFrame:
    """One forecast a day: refitted at each month's first day, the state updated daily."""
    return origins(spark, sf, ["caviar_sav", "caviar_as"]).select(text("d").alias("d"), "side", "model", "loss", "var", "es", "status")


def _suites(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of the fitted models and of the closed-form ones, on the days that all have valid forecasts for."""
    from ..operators import evaluate as E

    fitted = origins(spark, sf).select("d", "side", "loss", "model", "var", "es")
    whole = materialise(E.scored(fitted.unionByName(V.forecasts(spark, sf)), V.LEVEL), "suites")
    return E.on_common_days(whole, ["side"], "model", "d", "fz_loss")


def rolling_origin_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Coverage, losses and severity of twelve models on their common days."""
    from ..operators import evaluate as E

    m = E.metrics(_suites(spark, sf), ["side", "model"], "d", V.LEVEL)
    return m.select("side", "model", "rows", "hits", *[r(c, 5).alias(c) for c in ("breach_rate", "mean_q", "mean_fz", "severity", "kupiec_lr", "christoffersen_lr")])


def cross_suite_dm(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of the twelve models on one common sample: mean difference of FZ losses, block-bootstrap p-values to both sides and
    joint exceptions."""
    from .evaluation import _pairs

    return _pairs(_suites(spark, sf), "fz_loss")


#: Expectile levels among which the one is sought whose breach rate comes nearest to the target.
TAUS = (0.9, 0.95, 0.97, 0.98, 0.99, 0.995)


def expectile_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Exact sample expectiles with their breach rates, and how far these are from the target."""
    e = expectiles(V.losses(spark, sf), ["side"], "loss", TAUS)
    return e.select("side", "tau", r("expectile").alias("expectile"), r("breach_rate").alias("breach_rate"), r(F.abs(S("breach_rate") - (1 - V.LEVEL))).alias("distance"))


def signature(spark: SparkSession, sf: str) -> DataFrame:
    return table_signature(V.table(spark, sf, "orders"))


def _place(spark: SparkSession, name: str) -> str:
    """A folder below the shared one that the session names."""
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = "/tmp/checkpoints"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def scan_partition_prune(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources import lake

    path = _place(spark, "orders")
    o = V.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"), "o_totalprice", "o_orderpriority")
    lake.write_months(o, path, "d")
    back = lake.scan(spark, path, "o_orderkey long, d date, o_totalprice double, o_orderpriority string, year int, month int")
    out = back.filter(lake.month_range("1996-03-01", "1996-06-30") & lake.in_range([S("d")], "1996-03-15", "1996-06-10") & S("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return out.groupBy("year", "month", "o_orderpriority").agg(F.count("*").alias("n"), r(F.sum("o_totalprice"), 2).alias("total")).select(S("year").cast("long").alias("year"), S("month").cast("long").alias("month"), S("o_orderpriority").alias("priority"), "n", "total")


def csv_alias_and_null_marker(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources import lake
    from ..sources.normalize import first_present

    path = _place(spark, "macro")
    m = V.macro(spark, sf)
    value = F.when(F.dayofyear("week") % 5 != 0, r("level", 2).cast("string")).otherwise(".")
    for k, name in enumerate(("CLOSE", "close_value")):
        m.filter(F.year("week") % 2 == k).select(text("week").alias("DATE"), value.alias(name)).write.option("header", True).csv(f"{path}/{k}")
    parts = [lake.read_series_csv(spark, f"{path}/{k}", []) for k in range(2)]
    rows = [p.select(S("DATE").alias("week"), first_present(p, ["close", "close_value", "last"]).cast("double").alias("level")) for p in parts]
    return rows[0].unionByName(rows[1]).select("week", "level")


def normalize_bars_rows(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.normalize import normalize_bars

    e = V.table(spark, sf, "events")
    raw = e.select(S("event_type").alias("ticker"), (F.unix_micros(S("ts").cast("timestamp")) / 1000).cast("long").alias("t"), S("value").alias("o"), (S("value") + 1).alias("h"), (S("value") - 50).alias("l"), S("value").alias("c"), F.lit(1.0).alias("v"))
    b = normalize_bars(raw, 5, "minute")
    return b.groupBy("ticker", text("bar_date").alias("bar_date")).agg(F.count("*").alias("n"), F.count_if("is_regular").alias("regular"), F.count("low").alias("positive_lows"), F.date_format(F.max("end_utc"), "yyyy-MM-dd HH:mm").alias("last_end"))


Q = {f.__name__: f for f in (
    black_scholes_iv, pot_gpd_tail, gpd_stability, evi_anchor, garch_t_tail, caviar_fit, gas_t_fit, gas_pot_tail, block_maxima_shape, evt_shape_variants, rolling_origin_caviar,
    rolling_origin_forecasts, rolling_origin_metrics, cross_suite_dm, expectile_grid,
    scan_partition_prune, csv_alias_and_null_marker, normalize_bars_rows,
)} | {"table_signature": signature}

SQL = {
    "expectile_grid": f"""WITH {V.LOSSES}, t AS (SELECT CAST(unnest({list(TAUS)}) AS DOUBLE) AS tau),
      w AS (SELECT side, loss AS v, lead(loss) OVER w AS nx, row_number() OVER w AS k, sum(loss) OVER (w ROWS UNBOUNDED PRECEDING) AS s, count(*) OVER (PARTITION BY side) AS n,
        sum(loss) OVER (PARTITION BY side) AS total FROM losses WINDOW w AS (PARTITION BY side ORDER BY loss)),
      e AS (SELECT *, (tau * (total - s) + (1 - tau) * s) / (tau * (n - k) + (1 - tau) * k) AS e FROM w, t),
      b AS (SELECT side, tau, e FROM e QUALIFY row_number() OVER (PARTITION BY side, tau ORDER BY greatest(v - e, coalesce(e - nx, 0), 0), v DESC) = 1),
      g AS (SELECT side, tau, e, avg(CASE WHEN loss > e THEN 1.0 ELSE 0.0 END) AS rate FROM b JOIN losses USING (side) GROUP BY 1, 2, 3)
      SELECT side, tau, round(e, 6) AS expectile, round(rate, 6) AS breach_rate, round(abs(rate - {1 - V.LEVEL}), 6) AS distance FROM g""",
    "scan_partition_prune": """WITH o AS (SELECT CAST(o_orderdate AS DATE) AS d, o_totalprice, o_orderpriority FROM orders)
      SELECT year(d) AS year, month(d) AS month, o_orderpriority AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM o WHERE d BETWEEN DATE '1996-03-15' AND DATE '1996-06-10' AND o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1, 2, 3""",
    "csv_alias_and_null_marker": f"WITH {V.MACRO} SELECT CAST(week AS VARCHAR) AS week, CASE WHEN dayofyear(week) % 5 <> 0 THEN round(level, 2) END AS level FROM macro",
    "normalize_bars_rows": """WITH e AS (SELECT event_type AS ticker, date_trunc('milliseconds', ts) AS ts, value FROM events), l AS (SELECT *, timezone('America/New_York', timezone('UTC', ts)) AS lt FROM e)
      SELECT ticker, CAST(CAST(lt AS DATE) AS VARCHAR) AS bar_date, count(*) AS n, count(*) FILTER (WHERE strftime(lt, '%H:%M') >= '09:30' AND strftime(lt + INTERVAL 5 MINUTE, '%H:%M') <= '16:00') AS regular,
        count(*) FILTER (WHERE value - 50 > 0) AS positive_lows, strftime(max(ts + INTERVAL 5 MINUTE), '%Y-%m-%d %H:%M') AS last_end FROM l GROUP BY 1, 2""",
}
