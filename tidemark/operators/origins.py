"""Rolling-origin forecasts: each refit of each model is a job of its own.

A refit takes place on the first day of each month and sees the rows before that day; each row
of a series is dealt to the refits that it belongs to, as history or as a day to forecast,
so that a job has its own stretch of the series and nothing else.  The first refit of each
year is searched for from scratch; the others of the year start from its parameters.  Both
steps are hundreds of independent groups that Spark spreads over tasks.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import boosting, tails
from .blocks import positions
from .store import materialise

#: Rows that a first fit sees.
LEAST_ROWS = 1000


def refit_days(series: DataFrame, keys: Sequence[str], day: str, least: int = LEAST_ROWS) -> DataFrame:
    """keys, refit (1, 2, ...), first, stop: the positions that each refit forecasts, a month's or what is left of it; anchor: the first of its year."""
    months = series.filter(F.col("pos") >= least).groupBy(*keys, F.trunc(day, "MM").alias("month")).agg(F.min("pos").alias("first"), (F.max("pos") + 1).alias("stop"))
    by = Window.partitionBy(*keys).orderBy("month")
    year = F.year("month")
    return months.withColumns({"refit": F.row_number().over(by), "anchor": F.min(F.struct("month", "first")).over(Window.partitionBy(*keys, year))["first"]})


def jobs(series: DataFrame, refits: DataFrame, keys: Sequence[str], day: str, loss: str, more: Sequence[str] = ()) -> DataFrame:
    """keys, refit, first, anchor, pos, day, loss and `more`: each row once for each refit that sees or forecasts it."""
    spans = refits.select(*[F.col(k).alias(f"__{k}") for k in keys], "refit", "first", "stop", "anchor")
    own = refits.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("month").alias("__month"), F.col("refit").alias("__own"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    last = refits.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max("refit").alias("__last"))
    dealt = series.join(own, [*same, F.trunc(day, "MM") == F.col("__month"), F.col("pos") >= 0], "left").drop(*[f"__{k}" for k in keys])
    dealt = dealt.join(last, same).drop(*[f"__{k}" for k in keys])
    # rows of the first month before its first forecast are history of that month's refit already
    dealt = dealt.withColumn("refit", F.explode(F.sequence(F.coalesce("__own", F.lit(1)), F.col("__last")))).withColumnRenamed("refit", "__refit")
    out = dealt.join(spans, [*same, F.col("__refit") == F.col("refit")])
    return out.select(*keys, "refit", "first", "anchor", "pos", F.col(day).alias("day"), F.col(loss).cast("double").alias("loss"), *more)


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array, int]:
    """Losses before the refit, losses of its days, these days, and the refit's position."""
    order = np.argsort(table.column("pos").to_numpy())
    table = table.take(pa.array(order))
    first = table.column("first")[0].as_py()
    cut = int(np.searchsorted(table.column("pos").to_numpy(), first))
    x = table.column("loss").to_numpy()
    return x[:cut], x[cut:], table.column("day").combine_chunks()[cut:], first


def forecasts(series: DataFrame, keys: Sequence[str], day: str, loss: str, models: Sequence[str] | None = None, level: float = 0.95, least: int = LEAST_ROWS, only: Sequence[int] | None = None) -> DataFrame:
    """keys, day, model, refit, loss, var, es, status of each day from position `least` on; `models` are those of tails.MODELS.

    status: ok; step_limit (the search ended at its number of steps; the forecast stands); few_exceedances (VaR without ES, or neither);
    no_valid_parameters, no_variation, failed: ... (neither); not_finite.  `only` keeps some refits: each one's rows stay what they are.
    """
    models = list(models or tails.MODELS)
    placed = positions(series.select(*keys, day, loss), keys, day)
    refits = refit_days(placed, keys, day, least)
    wanted = refits if only is None else refits.filter(F.col("refit").isin(list(only)))
    anchors = refits.filter("first = anchor").join(wanted.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("anchor").alias("__anchor")).distinct(), [*[F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.col("first") == F.col("__anchor")], "left_semi")
    kinds = dict(placed.dtypes)
    spread = 4 * series.sparkSession.sparkContext.defaultParallelism  # small tables that take long: not to be merged by their size
    by = [f"{k} {kinds[k]}" for k in keys]
    named = F.explode(F.array(*[F.lit(m) for m in models])).alias("model")

    def fit(table: pa.Table, model: str, first: np.ndarray | None, extra: dict[str, float]) -> tails.Fit:
        x, _, _, _ = _arrays(table)
        try:
            return tails.MODELS[model].fit(x, level, first, extra)
        except (ValueError, ArithmeticError, np.linalg.LinAlgError) as e:
            return tails.Fit(np.zeros(0), f"failed: {type(e).__name__}")

    def anchored(key: tuple, table: pa.Table) -> pa.Table:
        found = fit(table, key[len(keys)].as_py(), None, {})
        columns = {k: [v.as_py()] for k, v in zip(keys, key, strict=False)}
        columns |= {"model": [key[len(keys)].as_py()], "anchor": [table.column("first")[0].as_py()], "params": [found.params.tolist()], "extra": [json.dumps(found.extra)], "status": [found.status]}
        return pa.Table.from_pydict(columns, pa.schema([*[table.schema.field(k) for k in keys], ("model", pa.string()), ("anchor", pa.int64()), ("params", pa.list_(pa.float64())), ("extra", pa.string()), ("status", pa.string())]))

    full = jobs(placed, anchors, keys, day, loss).filter("pos < first").select("*", named)
    started = full.repartition(spread, *keys, "model", "refit").groupBy(*keys, "model", "refit").applyInArrow(anchored, ", ".join([*by, "model string, anchor long, params array<double>, extra string, status string"]))

    def monthly(key: tuple, table: pa.Table, start: pa.Table) -> pa.Table:
        model = key[len(keys)].as_py()
        x, month, days, _ = _arrays(table)
        params, extra = start.column("params")[0].as_py(), json.loads(start.column("extra")[0].as_py())
        found = fit(table, model, np.array(params) if start.column("status")[0].as_py() in ("ok", "step_limit") else None, extra)
        made = {name: (np.full(len(month), np.nan),) * 2 for name in tails.MODELS[model].names.values()}
        if found.status in ("ok", "step_limit"):
            made |= tails.MODELS[model].forecast(x, month, level, found)
        parts = []
        for name, (var, es) in made.items():
            whole = np.isfinite(var) & np.isfinite(es)
            why = found.status if found.status not in ("ok", "step_limit") else "few_exceedances" if np.isnan(es).all() else "not_finite"
            status = np.where(whole, found.status, why)
            n = len(month)
            columns = [pa.array([v.as_py()] * n, table.schema.field(k).type) for k, v in zip(keys, key, strict=False)]
            columns += [days, pa.array([name] * n), pa.array([key[len(keys) + 1].as_py()] * n, pa.int32()), pa.array(month)]
            columns += [pa.array(np.where(np.isfinite(v), v, np.nan), from_pandas=True) for v in (var, es)] + [pa.array(status.tolist(), pa.string())]
            parts.append(pa.Table.from_arrays(columns, [*keys, "day", "model", "refit", "loss", "var", "es", "status"]))
        return pa.concat_tables(parts)

    each = jobs(placed, refits, keys, day, loss)
    if only is not None:
        each = each.filter(F.col("refit").isin(list(only)))
    each = each.select("*", named).repartition(spread, *keys, "model", "refit")
    starts = wanted.select(*keys, "refit", F.col("anchor").alias("__anchor")).join(started.withColumnsRenamed({k: f"__{k}" for k in keys}), [*[F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.col("__anchor") == F.col("anchor")]).select(*keys, "model", "refit", "params", "extra", "status")
    starts = materialise(starts, "anchors")
    out = each.groupBy(*keys, "model", "refit").cogroup(starts.groupBy(*keys, "model", "refit")).applyInArrow(monthly, ", ".join([*by, f"day {kinds[day]}", "model string, refit int, loss double, var double, es double, status string"]))
    return out.withColumnRenamed("day", day) if day != "day" else out


def boosted(series: DataFrame, keys: Sequence[str], day: str, loss: str, sets: Mapping[str, Sequence[str]], method: str = "quantile", level: float = 0.95, least: int = LEAST_ROWS, only: Sequence[int] | None = None, **shape) -> DataFrame:
    """keys, day, infoset, model, refit, loss, var, es, status: boosted forecasts on the features of each information set, refitted each month.

    method "quantile" boosts VaR itself, with the mean excess over the fitted VaR as ES; "location_scale" boosts mean and log absolute
    residual, the latter brought back by the mean of |residual| / fitted scale, and takes the tail of standardised residuals;
    "robust" takes median_mad and median_iqr from boosted quartiles in order (1.4826 x the median absolute residual, or IQR / 1.349).  A job
    is one set and refit; `shape` goes to boosting.fit.
    """
    names = sorted({c for columns in sets.values() for c in columns})
    placed = positions(series.select(*keys, day, loss, F.array(*[F.col(c).cast("double") for c in names]).alias("__x")), keys, day)
    refits = refit_days(placed, keys, day, least)
    kinds = dict(placed.dtypes)
    by = [f"{k} {kinds[k]}" for k in keys]
    at = {name: [names.index(c) for c in columns] for name, columns in sets.items()}
    models = {"quantile": ["direct"], "location_scale": ["mean_scale"], "robust": ["median_mad", "median_iqr"]}[method]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("pos").to_numpy())
        table = table.take(pa.array(order))
        cut = int(np.searchsorted(table.column("pos").to_numpy(), table.column("first")[0].as_py()))
        lists = table.column("__x").combine_chunks()
        x = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(table), -1)[:, at[key[len(keys)].as_py()]]
        y = table.column("loss").to_numpy()
        made = _boosted(method, x[:cut], y[:cut], x[cut:], level, shape)
        parts, n = [], len(y) - cut
        for name in models:
            var, es, status = made[name]
            columns = [pa.array([v.as_py()] * n, table.schema.field(k).type) for k, v in zip(keys, key, strict=False)]
            columns += [table.column("day").combine_chunks()[cut:], pa.array([key[len(keys)].as_py()] * n), pa.array([name] * n), pa.array([key[len(keys) + 1].as_py()] * n, pa.int32()), pa.array(y[cut:])]
            columns += [pa.array(v, from_pandas=True) for v in (var, es)] + [pa.array([status] * n, pa.string())]
            parts.append(pa.Table.from_arrays(columns, [*keys, "day", "infoset", "model", "refit", "loss", "var", "es", "status"]))
        return pa.concat_tables(parts)

    each = jobs(placed, refits, keys, day, loss, ["__x"])
    if only is not None:
        each = each.filter(F.col("refit").isin(list(only)))
    each = each.select("*", F.explode(F.array(*[F.lit(s) for s in sets])).alias("infoset")).repartition(4 * series.sparkSession.sparkContext.defaultParallelism, *keys, "infoset", "refit")
    out = each.groupBy(*keys, "infoset", "refit").applyInArrow(run, ", ".join([*by, f"day {kinds[day]}", "infoset string, model string, refit int, loss double, var double, es double, status string"]))
    return out.withColumnRenamed("day", day) if day != "day" else out


def _tail(z: np.ndarray, level: float) -> tuple[float, float, str]:
    """Quantile, mean above it, and whether enough values lie there."""
    q = float(np.quantile(z, level))
    above = z[z > q]
    return (q, float(above.mean()), "ok") if len(above) >= tails.LEAST_EXCEEDANCES else (q, np.nan, "few_exceedances")


def _boosted(method: str, x: np.ndarray, y: np.ndarray, ahead: np.ndarray, level: float, shape: dict) -> dict[str, tuple[np.ndarray, np.ndarray, str]]:
    fitted = lambda target, q: (lambda m: (m.predict(x), m.predict(ahead)))(boosting.fit(x, target, q, **shape))
    if method == "quantile":
        inside, var = fitted(y, level)
        over = y - inside
        enough = (over > 0).sum() >= tails.LEAST_EXCEEDANCES
        return {"direct": (var, var + over[over > 0].mean() if enough else np.full(len(var), np.nan), "ok" if enough else "few_exceedances")}
    if method == "location_scale":
        mean, mean_ahead = fitted(y, None)
        size = np.abs(y - mean)
        scale, scale_ahead = (np.exp(v) for v in fitted(np.log(size + 1e-6), None))
        smear = float((size / scale).mean())
        floor = 1e-4
        q, s, status = _tail((y - mean) / np.maximum(scale * smear, floor), level)
        out = np.maximum(scale_ahead * smear, floor)
        return {"mean_scale": (mean_ahead + q * out, mean_ahead + s * out, status)}
    quarters = [fitted(y, q) for q in (0.25, 0.5, 0.75)]
    inside, outside = (np.sort(np.stack([q[k] for q in quarters]), 0) for k in (0, 1))
    deviation = 1.4826 * float(np.median(np.abs(y - inside[1])))
    made = {}
    for name, scale, scale_ahead in (("median_mad", np.full(len(y), deviation), np.full(len(ahead), deviation)), ("median_iqr", (inside[2] - inside[0]) / 1.349, (outside[2] - outside[0]) / 1.349)):
        scale, scale_ahead = np.maximum(scale, 1e-4), np.maximum(scale_ahead, 1e-4)
        q, s, status = _tail((y - inside[1]) / scale, level)
        made[name] = (outside[1] + q * scale_ahead, outside[1] + s * scale_ahead, status)
    return made
