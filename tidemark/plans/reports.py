"""Queries behind reports: statuses over tails, audits of samples, selections, job grids, charts and threshold diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import evaluate as E
from ..operators import reports as P
from ..operators.select import exceedances
from . import evaluation
from . import views as V
from .panel import S, r, text

HALF = "1998-06-01"
CHI2 = 3.841459
BAND = (0.045, 0.06)
MODELS = ("ewma", "historical", "rolling")
FAMILIES = ("ewma", "garch", "historical", "rolling")
THRESHOLDS = {"low": 0.85, "base": 0.90, "high": 0.925}
CAPACITIES = {"small": 10, "base": 20, "large": 40}
GRID = {"q80": 0.80, "q85": 0.85, "q90": 0.90, "q925": 0.925, "q95": 0.95}
POINTS = 500


def halves(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.scored(spark, sf).withColumn("half", F.when(S("d") < F.lit(HALF).cast("date"), "early").otherwise("late"))


def half_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return E.metrics(halves(spark, sf), ["half", "side", "model"], "d", V.LEVEL)


def _in_band() -> Column:
    return S("breach_rate").between(*BAND)


def tail_statuses(spark: SparkSession, sf: str) -> DataFrame:
    """Each model's status over both tails and halves."""
    status = F.when(~_in_band(), "common_sample_unstable").when(S("kupiec_lr") >= CHI2, "coverage_rejected").when(S("christoffersen_lr") >= CHI2, "dependence_rejected").otherwise("ok")
    return P.combined_status(half_metrics(spark, sf).withColumn("status", status), ["half", "model"], "status")


def sample_audits(spark: SparkSession, sf: str) -> DataFrame:
    """Common samples by half and side, where one model skips days and is missing from one of them."""
    s = halves(spark, sf).filter("model <> 'rolling' or (dayofyear(d) % 10 <> 0 and not (half = 'late' and side = 'right'))")
    out = P.sample_audit(s, ["half", "side"], "model", "d", MODELS)
    return out.select("half", "side", "entities_json", "missing_json", "common_n", text("date_start").alias("date_start"), text("date_end").alias("date_end"), "joint_exceptions", r("joint_rate").alias("joint_rate"), "metric_status", "test_status")


def standardised_losses(spark: SparkSession, sf: str) -> DataFrame:
    """Losses by the exponentially weighted filter's residuals on the left side; the right side has no filter and takes z-scores."""
    f = V.forecasts(spark, sf).filter("model = 'ewma' and side = 'left'").select("d", "side", "var", "es")
    sd = (S("es") - S("var")) / (X.PHI95 / (1 - V.LEVEL) - X.Z95)
    rows = V.losses(spark, sf).join(f, ["d", "side"], "left").withColumn("residual", -(S("loss") - (S("var") - sd * X.Z95)) / sd)
    return P.standardised(rows, ["side"], "loss", "residual").select("side", text("d").alias("d"), r("standardised", 5).alias("standardised"))


def publishable_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The metric rows that may be published: the early half is the primary sample, a model has to keep within the band."""
    m = half_metrics(spark, sf)
    m = m.withColumns({
        "sample_policy": F.when(S("half") == "early", "primary_common_sample").otherwise("restricted"),
        "common_sample_status": F.when(_in_band(), "ok").otherwise("common_sample_unstable"),
        "is_valid_forecast": S("mean_fz").isNotNull(),
    })
    return P.publishable(m).select("side", "model", "rows", "hits", r("mean_q").alias("mean_q"), r("severity").alias("severity"))


def severity_range(spark: SparkSession, sf: str) -> DataFrame:
    whole = E.metrics(evaluation.scored(spark, sf), ["side", "model"], "d", V.LEVEL)
    out = P.value_range([half_metrics(spark, sf), whole, V.gaps(spark, sf)], "severity")
    return out.select("n", r("low").alias("low"), r("high").alias("high"))


def inference_power(spark: SparkSession, sf: str) -> DataFrame:
    m = half_metrics(spark, sf)
    matrix = m.withColumn("power", F.when(S("hits") >= 30, "adequate").otherwise("insufficient_tail_events"))
    tests = m.filter("model <> 'historical'").withColumn("status", F.when(S("rows") < P.TEST_DAYS, "unavailable_few_common_days").when(S("hits") < P.TEST_EXCEPTIONS, "unavailable_few_joint_exceptions").otherwise("ok"))
    return P.power_counts(matrix, "power", tests, "status")


def _passing(spark: SparkSession, sf: str) -> DataFrame:
    return P.passing(half_metrics(spark, sf), "model", _in_band() & (S("rows") >= P.METRIC_DAYS), 4)


def passing_murphy_curves(spark: SparkSession, sf: str) -> DataFrame:
    """Murphy curves of the models that pass in both halves and tails, over one grid of their losses."""
    f = V.forecasts(spark, sf).join(_passing(spark, sf), "model", "left_semi")
    m = E.murphy(f, ["side", "model"], 25, V.LEVEL)
    return m.select("side", "model", S("point").cast("long").alias("point"), (r("theta") + 0.0).alias("theta"), (r("score") + 0.0).alias("score"))


def stress_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """Forecasts for one chart: the primary benchmark or its stand-in, then the other models in order."""
    out = P.overlay(V.forecasts(spark, sf), ["side"], "model", ["garch", "ewma"], ["rolling", "historical"], X.valid_forecast(S("var"), S("es")))
    return out.select("side", text("d").alias("d"), "plot_group", S("plot_order").cast("long").alias("plot_order"), r("var").alias("var"), r("es").alias("es"))


def plotted_losses(spark: SparkSession, sf: str) -> DataFrame:
    """The largest losses of both tails that one chart can show."""
    top = P.plot_rows(V.losses(spark, sf).withColumn("size", -r("loss", 9)), ["size", "d", "side"], POINTS)
    return top.select("side", text("d").alias("d"), r("loss").alias("loss"))


def sensitivity_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs of both sensitivity families: thresholds for each side, capacities for each side and order priority."""
    sides = V.losses(spark, sf).select("side")
    sets = V.table(spark, sf, "orders").select(S("o_orderpriority").alias("information_set")).distinct()
    a = P.job_grid(sides.select("side", F.lit("").alias("information_set")), ["pot_gpd", "gjr_garch_evt"], "evt_threshold", THRESHOLDS, V.LEVEL)
    b = P.job_grid(sides.distinct().join(sets, how="cross"), ["gbm_quantile"], "gbm_capacity", CAPACITIES)  # two sides and five sets
    return a.unionByName(b)


def sensitivity_selection(spark: SparkSession, sf: str) -> DataFrame:
    """For each registered family whether it passed and may be used; one that did not blocks the run."""
    families = spark.createDataFrame([(f,) for f in FAMILIES], "model string")
    seen = half_metrics(spark, sf).select("model").distinct().withColumn("seen", F.lit(True))
    f = families.join(seen, "model", "left").join(_passing(spark, sf).withColumn("passed", F.lit(True)), "model", "left")
    return f.select("model", F.when(S("passed"), "selected").when(S("seen"), "failed_checks").otherwise("no_metrics").alias("status"))


def threshold_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """By side and threshold: exceedances, mean excess, Hill estimate over the threshold, moment shape of the excesses, and a gate."""
    e = exceedances(V.losses(spark, sf), ["side"], "loss", GRID).withColumn("excess", S("loss") - S("u"))
    g = e.groupBy("side", "q", "u", "n").agg(F.count("*").alias("exceedances"), F.avg("excess").alias("mean_excess"), F.var_samp("excess").alias("v"), F.avg(F.log(S("loss") / S("u"))).alias("hill"))
    shape = (1 - S("mean_excess") * S("mean_excess") / S("v")) / 2
    gate = F.when(S("exceedances") < 50, "few_exceedances").when(shape >= 0.5, "heavy_tail").otherwise("ok")
    return g.select("side", "q", r("u").alias("threshold"), "exceedances", r(S("exceedances") / S("n")).alias("share"), r("mean_excess").alias("mean_excess"), r("hill", 5).alias("hill"), r(shape, 4).alias("moment_shape"), gate.alias("gate"))


Q = {f.__name__: f for f in (
    tail_statuses, sample_audits, standardised_losses, publishable_metrics, severity_range, inference_power, passing_murphy_curves, stress_overlay, plotted_losses,
    sensitivity_jobs, sensitivity_selection, threshold_diagnostics,
)}

HM = f"{evaluation.HALVES.replace('1998-06-01', HALF)}, {evaluation._metric_sql('halves', 'half, side, model', 'hm')}"
IN_BAND = f"breach_rate BETWEEN {BAND[0]} AND {BAND[1]}"
PASS = f"pass AS (SELECT model FROM hm GROUP BY 1 HAVING count(*) FILTER (WHERE {IN_BAND} AND rows >= {P.METRIC_DAYS}) = 4 AND count(*) = 4)"
_LOST = "len(missing) > 0 THEN 'unavailable_missing_model'"
_JSON = "'[' || list_aggregate(list_transform({0}, lambda m: '\"' || m || '\"'), 'string_agg', ',') || ']'"


def _jobs(source: str, models: list[str], family: str, settings: dict[str, float]) -> str:
    cells = ", ".join(f"('{m}', '{k}', CAST({float(v)} AS DOUBLE))" for m in models for k, v in settings.items())
    return f"""SELECT side, information_set, model, config, setting, '{family}' AS family, FALSE AS primary_claim_allowed,
      substr(sha256('{family}|' || side || '|' || information_set || '|' || model || '|' || config), 1, 16) AS job FROM ({source}), (VALUES {cells}) t(model, config, setting)"""


SQL = {
    "tail_statuses": f"""WITH {HM}, s AS (SELECT half, model, CASE WHEN NOT ({IN_BAND}) THEN 'common_sample_unstable' WHEN kupiec_lr >= {CHI2} THEN 'coverage_rejected'
        WHEN christoffersen_lr >= {CHI2} THEN 'dependence_rejected' ELSE 'ok' END AS status FROM hm)
      SELECT half, model, CASE WHEN bool_or(status = 'common_sample_unstable') THEN 'common_sample_unstable' ELSE string_agg(DISTINCT status, ',' ORDER BY status) END AS combined_status FROM s GROUP BY 1, 2""",
    "sample_audits": f"""WITH {evaluation.HALVES}, s AS (SELECT * FROM halves WHERE model <> 'rolling' OR (dayofyear(d) % 10 <> 0 AND NOT (half = 'late' AND side = 'right'))),
      m AS (SELECT half, side, list(DISTINCT model ORDER BY model) AS entities FROM s GROUP BY 1, 2),
      c AS (SELECT half, side, d, bool_or(hit) AS hit FROM s JOIN m USING (half, side) GROUP BY half, side, d, entities HAVING count(DISTINCT model) = len(entities)),
      g AS (SELECT half, side, count(*) AS n, min(d) AS a, max(d) AS b, count(*) FILTER (WHERE hit) AS joint FROM c GROUP BY 1, 2),
      o AS (SELECT half, side, entities, list_filter({list(MODELS)}, lambda x: NOT list_contains(entities, x)) AS missing, coalesce(n, 0) AS n, a, b, coalesce(joint, 0) AS joint FROM m LEFT JOIN g USING (half, side))
      SELECT half, side, {_JSON.format('entities')} AS entities_json, coalesce({_JSON.format('missing')}, '[]') AS missing_json, n AS common_n, CAST(a AS VARCHAR) AS date_start, CAST(b AS VARCHAR) AS date_end,
        joint AS joint_exceptions, round(CASE WHEN n > 0 THEN joint / n END, 6) AS joint_rate,
        CASE WHEN {_LOST} WHEN n < {P.METRIC_DAYS} THEN 'unavailable_few_common_days' ELSE 'ok' END AS metric_status,
        CASE WHEN {_LOST} WHEN n < {P.TEST_DAYS} THEN 'unavailable_few_common_days' WHEN joint < {P.TEST_EXCEPTIONS} THEN 'unavailable_few_joint_exceptions' ELSE 'ok' END AS test_status FROM o""",
    "standardised_losses": f"""WITH {V.FORECASTS}, z AS (SELECT side, avg(loss) AS m, stddev_samp(loss) AS s FROM losses GROUP BY 1)
      SELECT side, CAST(d AS VARCHAR) AS d, round((loss - mean) / sd, 5) AS standardised FROM state WHERE side = 'left'
      UNION ALL SELECT side, CAST(d AS VARCHAR), round((loss - m) / s, 5) FROM losses JOIN z USING (side) WHERE side = 'right'""",
    "publishable_metrics": f"WITH {HM} SELECT side, model, rows, hits, round(mean_q, 6) AS mean_q, round(severity, 6) AS severity FROM hm WHERE half = 'early' AND {IN_BAND} AND mean_fz IS NOT NULL",
    "severity_range": f"""WITH {HM}, {evaluation._metric_sql('scored', 'side, model', 'metrics')}, v AS (SELECT severity FROM hm UNION ALL SELECT severity FROM metrics)
      SELECT count(severity) AS n, round(min(severity), 6) AS low, round(max(severity), 6) AS high FROM v""",
    "inference_power": f"""WITH {HM} SELECT count(*) FILTER (WHERE hits < 30) AS low_power_rows, count(*) FILTER (WHERE model <> 'historical' AND (rows < {P.TEST_DAYS} OR hits < {P.TEST_EXCEPTIONS})) AS unavailable_tests,
      count(*) FILTER (WHERE model <> 'historical') AS tests FROM hm""",
    "passing_murphy_curves": f"""WITH {HM}, {PASS}, f AS (SELECT * FROM forecasts WHERE model IN (SELECT model FROM pass)), e AS (SELECT quantile_cont(loss, 0.01) AS lo, quantile_cont(loss, 0.99) AS hi FROM f),
      t AS (SELECT point, lo + (hi - lo) * point / 24 AS theta FROM e, (SELECT unnest(range(25)) AS point))
      SELECT side, model, point, round(theta, 6) + 0.0 AS theta, round(avg(CASE WHEN var > theta THEN (CASE WHEN loss > theta THEN 1.0 ELSE 0.0 END - {1 - V.LEVEL}) * (var - theta) ELSE 0.0 END), 6) + 0.0 AS score FROM f, t GROUP BY side, model, point, theta""",
    "stress_overlay": f"""WITH {V.FORECASTS} SELECT side, CAST(d AS VARCHAR) AS d, model AS plot_group, CASE model WHEN 'ewma' THEN 0 WHEN 'rolling' THEN 1 ELSE 2 END AS plot_order, round(var, 6) AS var, round(es, 6) AS es
      FROM forecasts WHERE es > 0 AND es >= var""",
    "plotted_losses": f"WITH {V.LOSSES} SELECT side, CAST(d AS VARCHAR) AS d, round(loss, 6) AS loss FROM losses ORDER BY round(loss, 9) DESC, losses.d, side LIMIT {POINTS}",
    "sensitivity_jobs": "WITH " + V.LOSSES + ", s AS (SELECT DISTINCT side FROM losses) " + _jobs("SELECT side, '' AS information_set FROM s", ["pot_gpd", "gjr_garch_evt"], "evt_threshold", THRESHOLDS)
      + " UNION ALL " + _jobs("SELECT side, o_orderpriority AS information_set FROM s, (SELECT DISTINCT o_orderpriority FROM orders)", ["gbm_quantile"], "gbm_capacity", CAPACITIES),
    "sensitivity_selection": f"""WITH {HM}, {PASS} SELECT model, CASE WHEN model IN (SELECT model FROM pass) THEN 'selected' WHEN model IN (SELECT model FROM hm) THEN 'failed_checks' ELSE 'no_metrics' END AS status
      FROM (SELECT unnest({list(FAMILIES)}) AS model)""",
    "threshold_diagnostics": f"""WITH {V.LOSSES}, t AS (SELECT unnest({list(GRID.values())}) AS q), u AS (SELECT side, list(loss ORDER BY loss) AS h, count(*) AS n FROM losses GROUP BY 1),
      c AS (SELECT side, CAST(q AS DOUBLE) AS q, n, (n - 1) * CAST(q AS DOUBLE) AS p, h FROM u, t),
      v AS (SELECT side, q, n, h[CAST(floor(p) AS INTEGER) + 1] + (p - floor(p)) * (h[CAST(ceil(p) AS INTEGER) + 1] - h[CAST(floor(p) AS INTEGER) + 1]) AS u FROM c),
      g AS (SELECT side, q, u, n, count(*) AS k, avg(loss - u) AS m, var_samp(loss - u) AS v, avg(ln(loss / u)) AS hill FROM losses JOIN v USING (side) WHERE loss > u GROUP BY ALL)
      SELECT side, q, round(u, 6) AS threshold, k AS exceedances, round(k / n, 6) AS share, round(m, 6) AS mean_excess, round(hill, 5) AS hill, round((1 - m * m / v) / 2, 4) AS moment_shape,
        CASE WHEN k < 50 THEN 'few_exceedances' WHEN (1 - m * m / v) / 2 >= 0.5 THEN 'heavy_tail' ELSE 'ok' END AS gate FROM g""",
}
