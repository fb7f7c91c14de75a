"""Queries over forecasts: losses, coverage, common samples, comparisons and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import blocks as B
from ..operators import evaluate as E
from ..operators import rolling as R
from . import views as V
from .panel import S, r, text

KEY = ["side", "model"]
TESTS = ("kupiec", "christoffersen")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return E.scored(V.forecasts(spark, sf), V.LEVEL)


def _one(model: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        f = V.forecasts(spark, sf).filter(S("model") == model)
        return f.select(text("d").alias("d"), "side", r("var").alias("var"), r("es").alias("es"))

    return run


def forecast_loss_matrix(spark: SparkSession, sf: str) -> DataFrame:
    s = scored(spark, sf)
    return s.select(text("d").alias("d"), "side", "model", r("q_loss").alias("q_loss"), r("fz_loss", 5).alias("fz_loss"), "hit", X.validity_reason(S("var"), S("es")).alias("reason"))


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    return E.metrics(scored(spark, sf), KEY, "d", V.LEVEL)


def forecast_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = _metrics(spark, sf)
    return m.select(*KEY, "rows", "hits", "n00", "n01", "n10", "n11", *[r(c, 5).alias(c) for c in ("breach_rate", "mean_q", "mean_fz", "severity", "kupiec_lr", "christoffersen_lr")])


def forecast_pvalues(spark: SparkSession, sf: str) -> DataFrame:
    m = _metrics(spark, sf)
    return m.select(*KEY, "rows", *[r(f"{t}_lr", 5).alias(f"{t}_lr") for t in TESTS], *[r(X.chi2_1_sf(S(f"{t}_lr")), 5).alias(f"{t}_p") for t in TESTS])


def common_sample_eviction(spark: SparkSession, sf: str) -> DataFrame:
    # the rolling model skips some days, so that overlap differs
    s = scored(spark, sf).filter("model <> 'rolling' or dayofyear(d) % 10 <> 0")
    status, days = E.common_sample(s, ["side"], "model", "d", "historical", 0.95)
    n = days.groupBy("side").agg(F.count("*").alias("common_days"))
    return status.join(n, "side").select("side", "model", "overlap", "anchor_days", "kept", "common_days")


def result_matrix_metrics(spark: SparkSession, sf: str) -> DataFrame:
    s = scored(spark, sf).withColumn("half", F.when(S("d") < F.lit("1998-06-01").cast("date"), "early").otherwise("late"))
    g = s.groupBy("half", *KEY).agg(F.count("*").alias("rows"), F.count_if("hit").alias("tail_events"), F.avg("q_loss").alias("mean_q"), F.avg("fz_loss").alias("mean_fz"))
    gate = F.when(S("rows") < 120, "short_sample").when(S("tail_events") < 10, "few_tail_events").otherwise("ok")
    return g.select("half", *KEY, "rows", "tail_events", r("mean_q").alias("mean_q"), r("mean_fz", 5).alias("mean_fz"), gate.alias("gate"), F.when(S("tail_events") >= 30, "adequate").otherwise("low").alias("power"))


def joint_exceptions(spark: SparkSession, sf: str) -> DataFrame:
    j = E.joint_hits(scored(spark, sf), "d")
    return j.select(text("d").alias("d"), "hits")


def incremental_information(spark: SparkSession, sf: str) -> DataFrame:
    p = E.paired(scored(spark, sf), ["side"], "model", "d", "historical", "q_loss")
    return p.groupBy("side", "model").agg(F.count("*").alias("pairs"), r(F.avg(-S("diff"))).alias("gain"), F.count_if(S("diff") < -1e-9).alias("wins"))


def dm_block_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """Each model against the historical quantile: mean difference of FZ losses and its one-sided p-value by a block bootstrap."""
    p = E.paired(scored(spark, sf), ["side"], "model", "d", "historical", "fz_loss")
    out = E.one_sided(E.bootstrap_sums(p, KEY, "d", "diff"), KEY)
    return out.select(*KEY, "pairs", r("mean", 5).alias("mean_diff"), r("p_less", 4).alias("p_value"), "block")


def pairwise_dm(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of models on the days that all of them have: mean difference of losses, p-values to both sides, joint exceptions."""
    s = E.on_common_days(scored(spark, sf), ["side"], "model", "d", "q_loss")
    return _pairs(s, "q_loss")


def _pairs(s: DataFrame, loss: str) -> DataFrame:
    tested = E.one_sided(E.all_pairs(E.bootstrap_sums(s, KEY, "d", loss), ["side"], "model"), ["side", "a_model", "b_model"])
    hits = s.filter("hit").select("side", "model", "d")
    both = hits.withColumnRenamed("model", "a_model").join(hits.withColumnRenamed("model", "b_model"), ["side", "d"]).filter("a_model < b_model")
    both = both.groupBy("side", "a_model", "b_model").agg(F.count("*").alias("joint"))
    out = tested.join(both, ["side", "a_model", "b_model"], "left")
    return out.select("side", "a_model", "b_model", S("pairs").alias("days"), r("mean").alias("mean_difference"), r("p_less", 4).alias("p_less"), r("p_greater", 4).alias("p_greater"), "block", F.coalesce("joint", F.lit(0)).alias("joint_exceptions"))


def murphy_curves(spark: SparkSession, sf: str) -> DataFrame:
    m = E.murphy(V.forecasts(spark, sf), KEY, 50, V.LEVEL)
    return m.select(*KEY, S("point").cast("long").alias("point"), r("theta").alias("theta"), (r("score") + 0.0).alias("score"))


def stress_windows(spark: SparkSession, sf: str) -> DataFrame:
    s = scored(spark, sf)
    cut = s.filter("model = 'historical'").groupBy("side").agg(F.percentile("loss", F.lit(0.9)).alias("cut"))
    return s.join(F.broadcast(cut), "side").filter("loss >= cut").groupBy(*KEY).agg(F.count("*").alias("rows"), F.count_if("hit").alias("hits"), r(F.avg("q_loss")).alias("mean_q"), r(F.avg("fz_loss"), 5).alias("mean_fz"))


def admissibility_screen(spark: SparkSession, sf: str) -> DataFrame:
    """Which models pass in every scenario: relational division over side x half."""
    s = scored(spark, sf).withColumn("half", F.when(S("d") < F.lit("1998-06-01").cast("date"), "early").otherwise("late"))
    m = E.metrics(s, ["half", *KEY], "d", V.LEVEL)
    ok = (S("breach_rate").between(0.03, 0.07)) & (S("kupiec_lr") < 3.841459) & (S("christoffersen_lr") < 3.841459)
    return m.groupBy("model").agg(F.count("*").alias("scenarios"), F.count_if(ok).alias("passes"), F.count_if(S("breach_rate").between(0.03, 0.07)).alias("band_passes"), F.count_if(S("kupiec_lr") >= 3.841459).alias("kupiec_fails")).withColumn("admissible", S("passes") == S("scenarios"))


def sensitivity_compare(spark: SparkSession, sf: str) -> DataFrame:
    m = _metrics(spark, sf).select(*KEY, "mean_q", "breach_rate")
    shifted = scored(spark, sf).withColumns({"var": S("var") * 1.1, "es": S("es") * 1.1})
    alt = E.metrics(E.scored(shifted, V.LEVEL), KEY, "d", V.LEVEL).select(*KEY, S("mean_q").alias("alt_q"), S("breach_rate").alias("alt_breach"))
    ratio = X.deterioration(S("alt_q"), S("mean_q"))
    label = F.when(ratio <= 0.02, "robust").when(ratio <= 0.1, "moderate").otherwise("fragile")
    breach = F.when(S("alt_breach") < 0.03, "conservative").when(S("alt_breach") > 0.07, "aggressive").otherwise("in_band")
    return m.join(alt, KEY).select(*KEY, r("mean_q").alias("mean_q"), r("alt_q").alias("alt_q"), r(ratio, 4).alias("deterioration"), label.alias("label"), breach.alias("breach_class"))


def cumulative_gain(spark: SparkSession, sf: str) -> DataFrame:
    p = E.paired(scored(spark, sf).filter("model <> 'rolling'"), ["side"], "model", "d", "historical", "q_loss")
    return p.select("side", text("d").alias("d"), r(-F.sum("diff").over(R.series(["side"], "d").rowsBetween(Window.unboundedPreceding, 0)), 5).alias("gain"))


def forward_fill_overlay(spark: SparkSession, sf: str) -> DataFrame:
    f = V.forecasts(spark, sf).filter("model = 'ewma' and side = 'left' and dayofweek(d) = 2").select("d", "var")
    w = R.series([], "d").rowsBetween(Window.unboundedPreceding, 0)
    return V.daily(spark, sf).join(f, "d", "left").select(text("d").alias("d"), r(F.last("var", ignorenulls=True).over(w)).alias("var"), S("var").isNotNull().alias("fresh"))


def averaged_carry(spark: SparkSession, sf: str) -> DataFrame:
    """Missing values become the mean of the previous filled value and a second model's value of the day.

    In a run of missing values after a known one x0, the i-th is (x0 + sum of a_j 2**(j-1), j up to i) / 2**i.
    """
    w = R.series([], "d")
    anchor = F.avg("gap").over(R.prior(w, 20))
    g = V.gaps(spark, sf).select("d", F.when(F.dayofmonth("d") % 3 == 0, S("gap")).alias("x"), anchor.alias("a"))
    g = g.withColumn("run", F.count("x").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy("run").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    i = F.row_number().over(Window.partitionBy("run").orderBy("d")) - 1
    g = g.withColumns({"i": i, "x0": F.max("x").over(within)})
    g = g.withColumn("sums", F.sum(F.when(S("i") > 0, S("a") * F.pow(F.lit(2.0), S("i") - 1)).otherwise(0.0)).over(within))
    filled = (S("x0") + S("sums")) / F.pow(F.lit(2.0), S("i"))
    return g.select(text("d").alias("d"), r(filled).alias("filled"), r("x0").alias("last"))


def model_comparison_mean_sd(spark: SparkSession, sf: str) -> DataFrame:
    m = _metrics(spark, sf)
    labels = F.create_map(*[F.lit(x) for p in (("historical", "Historical quantile"), ("rolling", "Rolling quantile"), ("ewma", "EWMA")) for x in p])
    return m.groupBy(F.coalesce(labels[S("model")], S("model")).alias("label")).agg(r(F.avg("mean_q")).alias("mean_q"), r(F.stddev_samp("mean_q")).alias("sd_q"), r(F.avg("breach_rate"), 5).alias("mean_breach"), r(F.stddev_samp("breach_rate"), 5).alias("sd_breach"))


def block_summaries(spark: SparkSession, sf: str) -> DataFrame:
    from .panel import feature_coverage

    c = feature_coverage(spark, sf)
    return c.groupBy("source").agg(F.count("*").alias("features"), r(F.percentile("missing_rate", F.lit(0.5)), 5).alias("median_missing"), F.max("missing_rate").alias("max_missing"), F.sum("non_missing").alias("values"), F.countDistinct("first_valid").alias("starts"))


def saturation_ladder(spark: SparkSession, sf: str) -> DataFrame:
    years = scored(spark, sf).groupBy(F.year("d").cast("long").alias("year"), "model").agg(F.avg("q_loss").alias("q"))
    best = years.groupBy("year").agg(F.min("q").alias("best"))
    w = Window.orderBy("year")
    return best.select("year", r("best").alias("best"), r(S("best") - F.lag("best").over(w)).alias("step"), F.coalesce(S("best") < F.lag("best").over(w), F.lit(False)).alias("improved"))


def severity_vs_anchor(spark: SparkSession, sf: str) -> DataFrame:
    m = _metrics(spark, sf)
    rank = F.when(S("model") == "historical", 0).when(S("model") == "rolling", 1).otherwise(2)
    w = Window.partitionBy("side").orderBy(rank)
    first = F.first("severity").over(w)
    return m.select(*KEY, r("severity").alias("severity"), r(S("severity") - first).alias("delta"))


def diagonal_union(spark: SparkSession, sf: str) -> DataFrame:
    m = _metrics(spark, sf)
    a = m.select(*KEY, S("rows").cast("double").alias("rows")).withColumn("suite", F.lit("a"))
    b = m.select("model", "side", r("mean_q").alias("mean_q")).filter("model <> 'ewma'").withColumn("suite", F.lit("b"))
    return a.unionByName(b, allowMissingColumns=True)


def reason_explode(spark: SparkSession, sf: str) -> DataFrame:
    from .panel import target_missing_reasons

    t = target_missing_reasons(spark, sf).filter("missing_reasons <> ''").select("ticker", "d", F.explode(F.split("missing_reasons", ";")).alias("reason"))
    return t.groupBy("reason").agg(F.count("*").alias("n"), F.countDistinct("d").alias("days"), F.min("d").alias("first"), F.array_join(F.array_sort(F.collect_set("ticker")), ",").alias("tickers"))


def status_histogram_by_group(spark: SparkSession, sf: str) -> DataFrame:
    s = scored(spark, sf)
    status = F.when(S("fz_loss").isNull(), "invalid").when(S("hit"), "ok_hit").otherwise("ok")
    return s.groupBy(*KEY, status.alias("status")).agg(F.count("*").alias("n"), F.count_if(status.startswith("ok")).alias("n_ok"))


def rank_export(spark: SparkSession, sf: str) -> DataFrame:
    m = _metrics(spark, sf)
    w = Window.partitionBy("side").orderBy("mean_fz")
    return m.select("side", F.row_number().over(w).cast("long").alias("rank"), "model", r("mean_fz", 5).alias("mean_fz"), F.concat_ws("__", "side", "model", F.lit("0.95")).alias("shard")).orderBy("side", "rank")


def es_companions(spark: SparkSession, sf: str) -> DataFrame:
    """ES beside a given VaR from the exceedances before each day: by their mean excess, and by their mean ratio where there are ten."""
    f = B.positions(V.forecasts(spark, sf).filter("model = 'ewma'"), ["side"], "d")
    hit = S("loss") > S("var")
    past = {"hits": hit.cast("double"), "excess": F.when(hit, S("loss") - S("var")).otherwise(0.0), "ratio": F.when(hit, S("loss") / S("var")).otherwise(0.0)}
    f = B.running_sums(f, ["side"], past)
    excess = S("var") + F.when(S("hits") > 0, S("excess") / S("hits")).otherwise(0.0)
    ratio = F.when(S("hits") >= 10, S("var") * S("ratio") / S("hits"))
    return f.select(text("d").alias("d"), "side", r(excess, 5).alias("excess_es"), r(ratio, 5).alias("ratio_es"))


def caviar_filter(spark: SparkSession, sf: str) -> DataFrame:
    """The symmetric-absolute-value recursion with fixed parameters: each day's VaR, known before the day's loss."""
    p = B.positions(V.losses(spark, sf), ["side"], "d")
    f = B.linear_filter(p, ["side"], {"var": 0.05 + 0.25 * F.abs("loss")}, 0.8, 0.5)
    return f.select(text("d").alias("d"), "side", r("var").alias("var"))


def oof_folds(spark: SparkSession, sf: str) -> DataFrame:
    rn = F.row_number().over(R.series(["side"], "d")) - 1
    b = V.losses(spark, sf).withColumn("fold", F.when(rn >= V.MIN_TRAIN, F.floor((rn - V.MIN_TRAIN) / 200)))
    return b.filter("fold is not null").groupBy("side", S("fold").cast("long").alias("fold")).agg(F.count("*").alias("n"), F.min("d").cast("string").alias("first"), F.max("d").cast("string").alias("last"), r(F.avg("loss")).alias("mean"))


def bins_and_labels(spark: SparkSession, sf: str) -> DataFrame:
    b = V.losses(spark, sf).filter("side = 'left'")
    label = F.when(S("loss") < -1, "deep_gain").when(S("loss") < 0, "gain").when(S("loss") < 1, "loss").otherwise("deep_loss")
    return b.groupBy(label.alias("bin")).agg(F.count("*").alias("n"), r(F.avg("loss")).alias("mean"))


def status_classifier(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.normalize import classify_vendor_error

    e = V.table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    status = F.element_at(F.array(*[F.lit(s) for s in (200, 401, 403, 404, 429, 500, 418)]), (S("k") % 7 + 1).cast("int"))
    e = e.withColumns({"status": status, "message": F.when(S("k") % 2 == 0, "Your plan lacks this").otherwise("no"), "rows": S("k") % 3})
    return e.groupBy(classify_vendor_error(S("status"), S("message"), S("rows")).alias("class")).agg(F.count("*").alias("n"))


def sessionize_events(spark: SparkSession, sf: str) -> DataFrame:
    e = V.table(spark, sf, "events").select("user_id", S("ts").cast("timestamp").alias("ts"), "value")
    s = e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("events"), r(F.sum("value"), 3).alias("value"))
    return s.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "events", "value")


def exclusion_flow(spark: SparkSession, sf: str) -> DataFrame:
    g = V.gaps(spark, sf)
    reason = F.when(S("d") < F.lit("1995-06-01").cast("date"), "before_start").when(S("gap").isNull(), "not_clean").when(F.abs("gap") > 3, "mapping").otherwise("kept")
    return g.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.min("d").cast("string").alias("first"))


Q = {f.__name__: f for f in (
    forecast_loss_matrix, forecast_metrics, forecast_pvalues, common_sample_eviction, result_matrix_metrics, joint_exceptions, incremental_information,
    dm_block_bootstrap, pairwise_dm, murphy_curves, stress_windows, admissibility_screen, sensitivity_compare, cumulative_gain, forward_fill_overlay, averaged_carry,
    model_comparison_mean_sd, block_summaries, saturation_ladder, severity_vs_anchor, diagonal_union, reason_explode, status_histogram_by_group,
    rank_export, es_companions, caviar_filter, oof_folds, bins_and_labels, status_classifier, sessionize_events, exclusion_flow,
)} | {f"var_es_{m}": _one(m) for m in ("historical", "rolling", "ewma")}

D = "CAST(d AS VARCHAR) AS d"
LL = "(CASE WHEN {h} > 0 THEN {h} * ln({h} / ({h} + {m})) ELSE 0 END + CASE WHEN {m} > 0 THEN {m} * ln({m} / ({h} + {m})) ELSE 0 END)"


def _ll(h: str, m: str) -> str:
    return LL.format(h=h, m=m)


def _metric_sql(source: str, keys: str, name: str) -> str:
    return f"""{name}_t AS (SELECT *, lag(hit) OVER (PARTITION BY {keys} ORDER BY d) AS was FROM {source}),
{name}_g AS (SELECT {keys}, count(*) AS rows, count(*) FILTER (WHERE hit) AS hits, avg(q_loss) AS mean_q, avg(fz_loss) AS mean_fz, avg(loss - var) FILTER (WHERE hit) AS severity,
  count(*) FILTER (WHERE NOT was AND NOT hit) AS n00, count(*) FILTER (WHERE NOT was AND hit) AS n01, count(*) FILTER (WHERE was AND NOT hit) AS n10, count(*) FILTER (WHERE was AND hit) AS n11 FROM {name}_t GROUP BY {keys}),
{name} AS (SELECT *, hits / rows AS breach_rate, -2 * (hits * ln(0.05) + (rows - hits) * ln(0.95) - {_ll('hits', '(rows - hits)')}) AS kupiec_lr,
  -2 * ({_ll('(n01 + n11)', '(n00 + n10)')} - {_ll('n01', 'n00')} - {_ll('n11', 'n10')}) AS christoffersen_lr FROM {name}_g)"""


METRICS = f"{V.SCORED}, {_metric_sql('scored', 'side, model', 'metrics')}"
HALVES = f"{V.SCORED}, halves AS (SELECT *, CASE WHEN d < DATE '1998-06-01' THEN 'early' ELSE 'late' END AS half FROM scored)"
PAIRS = "pairs AS (SELECT b.side, b.model, b.d, b.q_loss - a.q_loss AS diff FROM scored b JOIN scored a ON a.side = b.side AND a.d = b.d AND a.model = 'historical' WHERE b.model <> 'historical')"


def _bootstrap_sql(source: str, keys: str, value: str, draws: int = 999, seed: int = 225) -> str:
    """z: keys, n, total, block, draw, drawn, by running sums."""
    return f"""z_p AS (SELECT {keys}, row_number() OVER w - 1 AS pos, coalesce(sum({value}) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, {value} AS v FROM {source} WHERE {value} IS NOT NULL WINDOW w AS (PARTITION BY {keys} ORDER BY d)),
      z_n AS (SELECT {keys}, count(*) AS n, arg_max(before + v, pos) AS total, least(count(*), greatest(5, CAST(round(pow(count(*), 1 / 3)) AS BIGINT))) AS block FROM z_p GROUP BY {keys}),
      z_b AS (SELECT *, unnest(range(CAST(ceil(n / block) AS BIGINT))) AS k FROM (SELECT *, unnest(range(1, {draws + 1})) AS draw FROM z_n)),
      z_s AS (SELECT *, CAST('0x' || substr(md5('{seed}:' || draw || ':' || k), 1, 8) AS BIGINT) % n AS start, least(block, n - k * block) AS size FROM z_b),
      z AS (SELECT {keys}, z_s.n, total, block, draw, sum(b.before - a.before + CASE WHEN start + size >= z_s.n THEN total ELSE 0 END) AS drawn
        FROM z_s JOIN z_p a USING ({keys}) JOIN z_p b USING ({keys}) WHERE a.pos = start AND b.pos = (start + size) % z_s.n GROUP BY ALL)"""


def _p(side: str) -> str:
    return f"round((count(*) FILTER (WHERE drawn / n - total / n {side} total / n) + 1) / (count(*) + 1), 4)"


def _reasons() -> str:
    from .panel import SQL as P

    return P["target_missing_reasons"]


def _coverage() -> str:
    from .panel import COVER

    return COVER


SQL = {
    **{f"var_es_{m}": f"WITH {V.FORECASTS} SELECT {D}, side, round(var, 6) AS var, round(es, 6) AS es FROM forecasts WHERE model = '{m}'" for m in ("historical", "rolling", "ewma")},
    "forecast_loss_matrix": f"WITH {V.SCORED} SELECT {D}, side, model, round(q_loss, 6) AS q_loss, round(fz_loss, 5) AS fz_loss, hit, CASE WHEN es <= 0 THEN 'invalid_nonpositive_es' WHEN es < var THEN 'invalid_es_below_var' ELSE 'ok' END AS reason FROM scored",
    "forecast_metrics": f"WITH {METRICS} SELECT side, model, rows, hits, n00, n01, n10, n11, {', '.join(f'round({c}, 5) AS {c}' for c in ('breach_rate', 'mean_q', 'mean_fz', 'severity', 'kupiec_lr', 'christoffersen_lr'))} FROM metrics",
    "forecast_pvalues": f"WITH {METRICS}, g AS (SELECT list(lgamma(n + 1.5) ORDER BY n) AS g FROM (SELECT unnest(range(120)) AS n)) SELECT side, model, rows, "
    + ", ".join(f"round({t}_lr, 5) AS {t}_lr, round(CASE WHEN {t}_lr > 0 THEN greatest(0, 1 - list_sum(list_transform(g, lambda v, n: exp((n - 0.5) * ln({t}_lr / 2) - {t}_lr / 2 - v)))) ELSE 1 END, 5) AS {t}_p" for t in TESTS)
    + " FROM metrics, g",
    "common_sample_eviction": f"""WITH {V.SCORED}, v AS (SELECT DISTINCT side, model, d FROM scored WHERE fz_loss IS NOT NULL AND (model <> 'rolling' OR dayofyear(d) % 10 <> 0)),
      a AS (SELECT side, d FROM v WHERE model = 'historical'), n AS (SELECT side, count(*) AS anchor_days FROM a GROUP BY 1), o AS (SELECT side, model, count(*) AS overlap FROM v JOIN a USING (side, d) GROUP BY 1, 2),
      s AS (SELECT *, overlap >= 0.95 * anchor_days AS kept FROM o JOIN n USING (side)), k AS (SELECT side, count(*) AS k FROM s WHERE kept GROUP BY 1),
      c AS (SELECT side, count(*) AS common_days FROM (SELECT v.side, v.d FROM v JOIN s ON s.side = v.side AND s.model = v.model AND s.kept JOIN k ON k.side = v.side GROUP BY v.side, v.d, k.k HAVING count(*) = k.k) GROUP BY 1)
      SELECT side, model, overlap, anchor_days, kept, common_days FROM s JOIN c USING (side)""",
    "result_matrix_metrics": f"""WITH {HALVES} SELECT half, side, model, count(*) AS rows, count(*) FILTER (WHERE hit) AS tail_events, round(avg(q_loss), 6) AS mean_q, round(avg(fz_loss), 5) AS mean_fz,
      CASE WHEN count(*) < 120 THEN 'short_sample' WHEN count(*) FILTER (WHERE hit) < 10 THEN 'few_tail_events' ELSE 'ok' END AS gate, CASE WHEN count(*) FILTER (WHERE hit) >= 30 THEN 'adequate' ELSE 'low' END AS power FROM halves GROUP BY 1, 2, 3""",
    "joint_exceptions": f"WITH {V.SCORED} SELECT {D}, count(*) FILTER (WHERE hit) AS hits FROM scored GROUP BY scored.d HAVING bool_or(hit)",
    "incremental_information": f"WITH {V.SCORED}, {PAIRS} SELECT side, model, count(*) AS pairs, round(avg(-diff), 6) AS gain, count(*) FILTER (WHERE diff < -1e-9) AS wins FROM pairs GROUP BY 1, 2",
    "dm_block_bootstrap": f"""WITH {V.SCORED}, diffs AS (SELECT b.side, b.model, b.d, b.fz_loss - a.fz_loss AS diff FROM scored b JOIN scored a ON a.side = b.side AND a.d = b.d AND a.model = 'historical' WHERE b.model <> 'historical'),
      {_bootstrap_sql("diffs", "side, model", "diff")} SELECT side, model, n AS pairs, round(total / n, 5) AS mean_diff, {_p("<=")} AS p_value, block FROM z GROUP BY side, model, n, total, block""",
    "pairwise_dm": f"""WITH {V.SCORED}, c AS (SELECT side, d FROM scored WHERE q_loss IS NOT NULL GROUP BY 1, 2 HAVING count(*) = (SELECT count(DISTINCT model) FROM scored)), s AS (SELECT scored.* FROM scored JOIN c USING (side, d)),
      {_bootstrap_sql("s", "side, model", "q_loss")}, h AS (SELECT a.side, a.model AS a_model, b.model AS b_model, count(*) AS joint FROM s a JOIN s b ON a.side = b.side AND a.d = b.d AND a.model < b.model AND a.hit AND b.hit GROUP BY ALL),
      y AS (SELECT a.side, a.model AS a_model, b.model AS b_model, a.n, a.block, a.total - b.total AS total, a.drawn - b.drawn AS drawn FROM z a JOIN z b ON a.side = b.side AND a.draw = b.draw AND a.model < b.model)
      SELECT side, a_model, b_model, n AS days, round(total / n, 6) AS mean_difference, {_p("<=")} AS p_less, {_p(">=")} AS p_greater, block, coalesce(any_value(joint), 0) AS joint_exceptions
      FROM y LEFT JOIN h USING (side, a_model, b_model) GROUP BY side, a_model, b_model, n, total, block""",
    "murphy_curves": f"""WITH {V.FORECASTS}, e AS (SELECT quantile_cont(loss, 0.01) AS lo, quantile_cont(loss, 0.99) AS hi FROM forecasts), g AS (SELECT k AS point, lo + (hi - lo) * k / 49 AS theta FROM e, (SELECT unnest(range(50)) AS k))
      SELECT side, model, point, round(theta, 6) AS theta, round(avg(CASE WHEN var > theta THEN (CASE WHEN loss > theta THEN 1.0 ELSE 0.0 END - 0.05) * (var - theta) ELSE 0 END), 6) + 0 AS score FROM forecasts, g GROUP BY side, model, point, theta""",
    "stress_windows": f"""WITH {V.SCORED}, c AS (SELECT side, quantile_cont(loss, 0.9) AS cut FROM scored WHERE model = 'historical' GROUP BY 1)
      SELECT side, model, count(*) AS rows, count(*) FILTER (WHERE hit) AS hits, round(avg(q_loss), 6) AS mean_q, round(avg(fz_loss), 5) AS mean_fz FROM scored JOIN c USING (side) WHERE loss >= cut GROUP BY 1, 2""",
    "admissibility_screen": f"""WITH {HALVES}, {_metric_sql('halves', 'half, side, model', 'm')} SELECT model, count(*) AS scenarios,
      count(*) FILTER (WHERE breach_rate BETWEEN 0.03 AND 0.07 AND kupiec_lr < 3.841459 AND christoffersen_lr < 3.841459) AS passes, count(*) FILTER (WHERE breach_rate BETWEEN 0.03 AND 0.07) AS band_passes,
      count(*) FILTER (WHERE kupiec_lr >= 3.841459) AS kupiec_fails, count(*) = count(*) FILTER (WHERE breach_rate BETWEEN 0.03 AND 0.07 AND kupiec_lr < 3.841459 AND christoffersen_lr < 3.841459) AS admissible FROM m GROUP BY model""",
    "sensitivity_compare": f"""WITH {METRICS}, alt AS (SELECT side, model, avg((CASE WHEN loss > var * 1.1 THEN 1.0 ELSE 0.0 END - 0.05) * (loss - var * 1.1)) AS alt_q, avg(CASE WHEN loss > var * 1.1 THEN 1.0 ELSE 0.0 END) AS alt_b FROM forecasts GROUP BY 1, 2),
      j AS (SELECT *, (alt_q - mean_q) / greatest(abs(mean_q), 1e-12) AS x FROM metrics JOIN alt USING (side, model))
      SELECT side, model, round(mean_q, 6) AS mean_q, round(alt_q, 6) AS alt_q, round(x, 4) AS deterioration, CASE WHEN x <= 0.02 THEN 'robust' WHEN x <= 0.1 THEN 'moderate' ELSE 'fragile' END AS label,
        CASE WHEN alt_b < 0.03 THEN 'conservative' WHEN alt_b > 0.07 THEN 'aggressive' ELSE 'in_band' END AS breach_class FROM j""",
    "cumulative_gain": f"WITH {V.SCORED}, {PAIRS} SELECT side, {D}, round(-sum(diff) OVER (PARTITION BY side ORDER BY d ROWS UNBOUNDED PRECEDING), 5) AS gain FROM pairs WHERE model = 'ewma'",
    "forward_fill_overlay": f"""WITH {V.FORECASTS}, f AS (SELECT d, var FROM forecasts WHERE model = 'ewma' AND side = 'left' AND dayofweek(d) = 1), j AS (SELECT daily.d, var FROM daily LEFT JOIN f ON f.d = daily.d)
      SELECT {D}, round(last_value(var IGNORE NULLS) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING), 6) AS var, var IS NOT NULL AS fresh FROM j""",
    "model_comparison_mean_sd": f"""WITH {METRICS} SELECT CASE model WHEN 'historical' THEN 'Historical quantile' WHEN 'rolling' THEN 'Rolling quantile' WHEN 'ewma' THEN 'EWMA' ELSE model END AS label,
      round(avg(mean_q), 6) AS mean_q, round(stddev_samp(mean_q), 6) AS sd_q, round(avg(breach_rate), 5) AS mean_breach, round(stddev_samp(breach_rate), 5) AS sd_breach FROM metrics GROUP BY 1""",
    "block_summaries": f"WITH {_coverage()} SELECT source, count(*) AS features, round(quantile_cont(missing_rate, 0.5), 5) AS median_missing, max(missing_rate) AS max_missing, CAST(sum(non_missing) AS BIGINT) AS values, count(DISTINCT first_valid) AS starts FROM cover GROUP BY source",
    "saturation_ladder": f"""WITH {V.SCORED}, y AS (SELECT year(d) AS year, model, avg(q_loss) AS q FROM scored GROUP BY 1, 2), b AS (SELECT year, min(q) AS best FROM y GROUP BY 1)
      SELECT year, round(best, 6) AS best, round(best - lag(best) OVER (ORDER BY year), 6) AS step, coalesce(best < lag(best) OVER (ORDER BY year), FALSE) AS improved FROM b""",
    "severity_vs_anchor": f"WITH {METRICS} SELECT m.side, m.model, round(m.severity, 6) AS severity, round(m.severity - a.severity, 6) AS delta FROM metrics m JOIN metrics a ON a.side = m.side AND a.model = 'historical'",
    "diagonal_union": f"WITH {METRICS} SELECT side, model, CAST(rows AS DOUBLE) AS rows, 'a' AS suite, CAST(NULL AS DOUBLE) AS mean_q FROM metrics UNION ALL SELECT side, model, NULL, 'b', round(mean_q, 6) FROM metrics WHERE model <> 'ewma'",
    "reason_explode": f"""WITH r AS ({_reasons()}), x AS (SELECT ticker, d, unnest(string_split(missing_reasons, ';')) AS reason FROM r WHERE missing_reasons <> '')
      SELECT reason, count(*) AS n, count(DISTINCT d) AS days, min(d) AS first, array_to_string(list(DISTINCT ticker ORDER BY ticker), ',') AS tickers FROM x GROUP BY reason""",
    "status_histogram_by_group": f"""WITH {V.SCORED}, s AS (SELECT side, model, CASE WHEN fz_loss IS NULL THEN 'invalid' WHEN hit THEN 'ok_hit' ELSE 'ok' END AS status FROM scored)
      SELECT side, model, status, count(*) AS n, count(*) FILTER (WHERE status LIKE 'ok%') AS n_ok FROM s GROUP BY 1, 2, 3""",
    "rank_export": f"WITH {METRICS} SELECT side, row_number() OVER (PARTITION BY side ORDER BY mean_fz) AS rank, model, round(mean_fz, 5) AS mean_fz, side || '__' || model || '__0.95' AS shard FROM metrics",
    "es_companions": f"""WITH {V.FORECASTS}, h AS (SELECT d, side, var, coalesce(list(loss) OVER w, []) AS hl, coalesce(list(var) OVER w, []) AS hv FROM forecasts WHERE model = 'ewma' WINDOW w AS (PARTITION BY side ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      z AS (SELECT *, list_filter(list_transform(range(1, len(hl) + 1), lambda i: hl[i] - hv[i]), lambda e: e > 0) AS ex, list_filter(list_transform(range(1, len(hl) + 1), lambda i: CASE WHEN hl[i] > hv[i] THEN hl[i] / hv[i] END), lambda e: e IS NOT NULL) AS ra FROM h)
      SELECT {D}, side, round(CASE WHEN len(ex) = 0 THEN var ELSE var + list_avg(ex) END, 5) AS excess_es, round(CASE WHEN len(ra) >= 10 THEN var * list_avg(ra) END, 5) AS ratio_es FROM z""",
    "averaged_carry": f"""WITH RECURSIVE {V.GAPS}, g AS (SELECT d, CASE WHEN day(d) % 3 = 0 THEN gap END AS x, avg(gap) OVER (ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS a, row_number() OVER (ORDER BY d) AS k FROM gaps),
      f AS (SELECT d, k, x AS filled, x AS last FROM g WHERE k = 1 UNION ALL SELECT g.d, g.k, coalesce(g.x, (f.filled + g.a) / 2), coalesce(g.x, f.last) FROM f JOIN g ON g.k = f.k + 1)
      SELECT CAST(d AS VARCHAR) AS d, round(filled, 6) AS filled, round(last, 6) AS last FROM f""",
    "caviar_filter": f"""WITH {V.LOSSES}, h AS (SELECT d, side, coalesce(list(loss) OVER (PARTITION BY side ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS h FROM losses)
      SELECT {D}, side, round(list_reduce(list_prepend(CAST(0.5 AS DOUBLE), h), lambda v, x: 0.05 + 0.8 * v + 0.25 * abs(x)), 6) AS var FROM h""",
    "oof_folds": f"""WITH {V.LOSSES}, k AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY d) - 1 AS rn FROM losses) SELECT side, CAST(floor((rn - {V.MIN_TRAIN}) / 200) AS BIGINT) AS fold, count(*) AS n, CAST(min(d) AS VARCHAR) AS first, CAST(max(d) AS VARCHAR) AS last, round(avg(loss), 6) AS mean
      FROM k WHERE rn >= {V.MIN_TRAIN} GROUP BY 1, 2""",
    "bins_and_labels": f"WITH {V.LOSSES} SELECT CASE WHEN loss < -1 THEN 'deep_gain' WHEN loss < 0 THEN 'gain' WHEN loss < 1 THEN 'loss' ELSE 'deep_loss' END AS bin, count(*) AS n, round(avg(loss), 6) AS mean FROM losses WHERE side = 'left' GROUP BY 1",
    "status_classifier": """WITH e AS (SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events), s AS (SELECT (([200, 401, 403, 404, 429, 500, 418])[k % 7 + 1]) AS status, k % 2 = 0 AS plan, k % 3 AS rows FROM e)
      SELECT CASE WHEN status IN (401, 403) THEN CASE WHEN plan THEN 'entitlement' ELSE 'auth' END WHEN status = 404 THEN 'not_found' WHEN status = 429 THEN 'rate_limited' WHEN status >= 500 THEN 'server_error' WHEN status >= 400 THEN 'client_error' WHEN rows = 0 THEN 'empty' ELSE 'ok' END AS class, count(*) AS n FROM s GROUP BY 1""",
    "sessionize_events": """WITH e AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM events), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
      SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS events, round(sum(value), 3) AS value FROM s GROUP BY user_id, k""",
    "exclusion_flow": f"WITH {V.GAPS} SELECT CASE WHEN d < DATE '1995-06-01' THEN 'before_start' WHEN gap IS NULL THEN 'not_clean' WHEN abs(gap) > 3 THEN 'mapping' ELSE 'kept' END AS reason, count(*) AS n, CAST(min(d) AS VARCHAR) AS first FROM gaps GROUP BY 1",
}
