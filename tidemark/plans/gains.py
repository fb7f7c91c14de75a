"""What further information adds: gains with p-values, saturation over nested sets, stress regimes of two kinds, the combined start."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import reports as P
from ..operators.asof import asof_join
from ..operators.select import order_statistics
from . import evaluation, panel
from . import views as V
from .panel import S, r

#: Nested information sets, smallest first: the models that each may use.
LADDER = {"A": ["historical"], "B": ["historical", "rolling"], "C": ["historical", "rolling", "ewma"]}
#: A set that lowers the loss by less than this share adds nothing.
LEAST_GAIN = 0.002
INDEX_TICKER = "2-HIGH"
DECILE = 0.9
#: A source without any coverage starts here.
FALLBACK = "1992-06-01"
SOURCES = ("bars", "macro", "options", "events")


def information_gains(spark: SparkSession, sf: str) -> DataFrame:
    """Mean gain in quantile loss over the baseline on the days that both have, its share of the baseline's loss, how often it wins,
    and the one-sided p-value of a block bootstrap; too few days or exceptions give a status instead of a claim."""
    s = evaluation.scored(spark, sf)
    p = E.paired(s, ["side"], "model", "d", "historical", "q_loss")
    tested = E.one_sided(E.bootstrap_sums(p, evaluation.KEY, "d", "diff"), evaluation.KEY).select(*evaluation.KEY, "p_less", "block")
    base = s.filter("model = 'historical'").select("side", "d", S("q_loss").alias("base_loss"), S("hit").alias("base_hit"))
    hits = s.filter("model <> 'historical'").select("side", "model", "d", "hit")
    joined = p.select("side", "model", "d", "diff").join(base, ["side", "d"]).join(hits, ["side", "model", "d"])
    g = joined.groupBy("side", "model").agg(
        F.count("*").alias("days"), F.avg(-S("diff")).alias("gain"), F.avg("base_loss").alias("base"), F.count_if(S("diff") < -1e-9).alias("wins"), F.count_if(S("hit") | S("base_hit")).alias("exceptions")
    )
    status = F.when(S("days") < P.TEST_DAYS, "unavailable_few_common_days").when(S("exceptions") < P.TEST_EXCEPTIONS, "unavailable_few_joint_exceptions").otherwise("ok")
    out = g.join(tested, evaluation.KEY).withColumn("status", status)
    return out.select("side", "model", "days", r("gain").alias("gain"), r(S("gain") / S("base"), 4).alias("relative_gain"), "wins", "exceptions", "status", F.when(S("status") == "ok", r("p_less", 4)).alias("p_value"), "block")


def information_saturation(spark: SparkSession, sf: str) -> DataFrame:
    """The least loss of each nested set by side, the step to the set before, and whether the ladder is saturated there: neither this set nor
    a larger one lowers the loss."""
    m = E.metrics(evaluation.scored(spark, sf), evaluation.KEY, "d", V.LEVEL)
    sets = F.array(*[F.when(S("model").isin(*models), F.lit(name)) for name, models in LADDER.items()])
    best = m.select("side", "mean_q", F.explode(F.array_compact(sets)).alias("information_set")).groupBy("side", "information_set").agg(F.min("mean_q").alias("best"))
    w = Window.partitionBy("side").orderBy("information_set")
    out = best.withColumn("before", F.lag("best").over(w))
    out = out.withColumn("gain", 1 - S("best") / S("before"))
    later = F.max("gain").over(w.rowsBetween(0, Window.unboundedFollowing))
    saturated = S("before").isNotNull() & (later < LEAST_GAIN)
    return out.select("side", "information_set", r("best").alias("best"), r("gain", 5).alias("gain"), saturated.alias("saturated"))


def stress_regimes(spark: SparkSession, sf: str) -> DataFrame:
    """Scores on days in the top decile of losses, on days that begin with the volatility index in its top decile, and on days of both.

    The index of a day is its newest close from before that day; both cuts are exact quantiles over the scored days of a side."""
    s = evaluation.scored(spark, sf)
    index = V.bars(spark, sf).filter(S("ticker") == INDEX_TICKER).select(S("d").alias("index_day"), S("close").alias("index"))
    days = s.filter("model = 'historical'").select("side", "d", "loss")
    days = asof_join(days, index, "d", "index_day", columns=["index"], strict=True)
    cuts = order_statistics(days, ["side"], "loss", {"loss_cut": DECILE}).drop("n").join(order_statistics(days, ["side"], "index", {"index_cut": DECILE}).drop("n"), "side")
    on = days.join(cuts, "side").select("side", "d", (S("loss") >= S("loss_cut")).alias("a"), F.coalesce(S("index") >= S("index_cut"), F.lit(False)).alias("b")).filter("a or b")
    kinds = F.array_compact(F.array(F.when(S("a"), "loss"), F.when(S("b"), "index"), F.when(S("a") & S("b"), "both")))
    met = s.join(on.select("side", "d", F.explode(kinds).alias("regime")), ["side", "d"])
    g = met.groupBy("side", "regime", "model").agg(F.count("*").alias("rows"), F.count_if("hit").alias("hits"), F.avg("q_loss").alias("q"), F.avg("fz_loss").alias("fz"), F.avg(F.when(S("hit"), S("loss") - S("var"))).alias("severity"))
    return g.select("side", "regime", "model", "rows", "hits", r(S("hits") / S("rows")).alias("breach_rate"), r("q").alias("mean_q"), r("fz", 5).alias("mean_fz"), r("severity").alias("severity"))


def combined_start(spark: SparkSession, sf: str) -> DataFrame:
    """The day from which every source is covered: the latest of the sources' starts, the stated day for a source without any; and which
    source binds, the first in name if several do."""
    c = panel.feature_coverage(spark, sf).groupBy("source").agg(F.max("first_valid").alias("start"))
    wanted = spark.createDataFrame([(name,) for name in SOURCES], "source string")
    starts = wanted.join(c, "source", "left").withColumn("used", F.coalesce("start", F.lit(FALLBACK)))
    latest = F.max(F.struct("used")).alias("latest")
    binding = F.min_by("source", F.struct(-F.unix_date(S("used").cast("date")), "source")).alias("binding")
    return starts.agg(latest, binding, F.count_if(S("start").isNull()).alias("fallbacks")).select(S("latest.used").alias("clean_start"), "binding", "fallbacks")


Q = {f.__name__: f for f in (information_gains, information_saturation, stress_regimes, combined_start)}

SETS = ", ".join(f"('{name}', '{m}')" for name, models in LADDER.items() for m in models)
SQL = {
    "information_gains": f"""WITH {V.SCORED}, diffs AS (SELECT b.side, b.model, b.d, b.q_loss - a.q_loss AS diff, a.q_loss AS base, a.hit OR b.hit AS hit FROM scored b JOIN scored a ON a.side = b.side AND a.d = b.d AND a.model = 'historical' WHERE b.model <> 'historical'),
      {evaluation._bootstrap_sql("diffs", "side, model", "diff")}, p AS (SELECT side, model, {evaluation._p("<=")} AS p, block FROM z GROUP BY side, model, n, total, block),
      g AS (SELECT side, model, count(*) AS days, avg(-diff) AS gain, avg(base) AS base, count(*) FILTER (WHERE diff < -1e-9) AS wins, count(*) FILTER (WHERE hit) AS exceptions FROM diffs GROUP BY 1, 2),
      s AS (SELECT *, CASE WHEN days < {P.TEST_DAYS} THEN 'unavailable_few_common_days' WHEN exceptions < {P.TEST_EXCEPTIONS} THEN 'unavailable_few_joint_exceptions' ELSE 'ok' END AS status FROM g)
      SELECT side, model, days, round(gain, 6) AS gain, round(gain / base, 4) AS relative_gain, wins, exceptions, status, CASE WHEN status = 'ok' THEN p END AS p_value, block FROM s JOIN p USING (side, model)""",
    "information_saturation": f"""WITH {evaluation.METRICS}, b AS (SELECT side, information_set, min(mean_q) AS best FROM metrics JOIN (VALUES {SETS}) t(information_set, model) USING (model) GROUP BY 1, 2),
      g AS (SELECT *, 1 - best / lag(best) OVER w AS gain, lag(best) OVER w AS before FROM b WINDOW w AS (PARTITION BY side ORDER BY information_set))
      SELECT side, information_set, round(best, 6) AS best, round(gain, 5) AS gain, before IS NOT NULL AND max(gain) OVER (PARTITION BY side ORDER BY information_set ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) < {LEAST_GAIN} AS saturated FROM g""",
    "stress_regimes": f"""WITH {V.SCORED}, {V.BARS}, i AS (SELECT d AS index_day, close AS index FROM bars WHERE ticker = '{INDEX_TICKER}'),
      days AS (SELECT side, s.d, loss, index FROM scored s ASOF LEFT JOIN i ON s.d > i.index_day WHERE model = 'historical'),
      c AS (SELECT side, quantile_cont(loss, {DECILE}) AS lc, quantile_cont(index, {DECILE}) AS ic FROM days GROUP BY 1),
      o AS (SELECT side, d, loss >= lc AS a, coalesce(index >= ic, FALSE) AS b FROM days JOIN c USING (side)),
      k AS (SELECT side, d, unnest(['loss', 'index', 'both']) AS regime, unnest([a, b, a AND b]) AS is_in FROM o)
      SELECT side, regime, model, count(*) AS rows, count(*) FILTER (WHERE hit) AS hits, round(count(*) FILTER (WHERE hit) / count(*), 6) AS breach_rate, round(avg(q_loss), 6) AS mean_q, round(avg(fz_loss), 5) AS mean_fz,
        round(avg(loss - var) FILTER (WHERE hit), 6) AS severity FROM scored JOIN k USING (side, d) WHERE is_in GROUP BY 1, 2, 3""",
    "combined_start": f"""WITH {panel.COVER}, c AS (SELECT source, max(first_valid) AS start FROM cover GROUP BY 1), s AS (SELECT w.source, start, coalesce(start, '{FALLBACK}') AS used FROM (SELECT unnest({list(SOURCES)}) AS source) w LEFT JOIN c USING (source))
      SELECT max(used) AS clean_start, arg_min(source, (-epoch(CAST(used AS DATE)), source)) AS binding, count(*) FILTER (WHERE start IS NULL) AS fallbacks FROM s""",
}
