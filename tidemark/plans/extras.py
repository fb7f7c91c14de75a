"""Further queries: out-of-fold standardisation, rearranged quantiles, ladders, fallbacks and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import rolling as R
from . import views as V
from .panel import S, r, text


def _folds(spark: SparkSession, sf: str) -> DataFrame:
    rn = F.row_number().over(R.series(["side"], "d")) - 1
    return V.losses(spark, sf).withColumn("fold", F.when(rn >= V.MIN_TRAIN, F.floor((rn - V.MIN_TRAIN) / 200)).otherwise(-1).cast("int"))


def oof_standardisation(spark: SparkSession, sf: str) -> DataFrame:
    """Losses of each fold by mean and deviation, median and MAD, and median and IQR of all folds before it.

    The folds are few and fixed blocks of days; each fold's history is aggregated once.
    """
    f = _folds(spark, sf)
    ends = f.filter("fold >= 0").select("side", S("fold").alias("target")).distinct()
    history = f.join(F.broadcast(ends), "side").filter(S("fold") < S("target"))
    q = lambda p: F.percentile("loss", F.lit(p))
    base = history.groupBy("side", "target").agg(F.avg("loss").alias("mean"), F.stddev_samp("loss").alias("sd"), q(0.5).alias("med"), (q(0.75) - q(0.25)).alias("iqr"))
    mad = history.join(F.broadcast(base.select("side", "target", "med")), ["side", "target"]).groupBy("side", "target").agg(F.percentile(F.abs(S("loss") - S("med")), F.lit(0.5)).alias("mad"))
    stats = base.join(mad, ["side", "target"]).withColumnRenamed("target", "fold")
    z = f.filter("fold >= 0").join(F.broadcast(stats), ["side", "fold"])
    return z.select("side", text("d").alias("d"), r((S("loss") - S("mean")) / S("sd")).alias("z_mean"), r((S("loss") - S("med")) / F.greatest(S("mad") * 1.4826, F.lit(1e-4))).alias("z_mad"), r((S("loss") - S("med")) / F.greatest(S("iqr") / 1.349, F.lit(1e-4))).alias("z_iqr"))


def quantile_rearrangement(spark: SparkSession, sf: str) -> DataFrame:
    """Rolling quartiles over different windows cross; sorting them restores the order, and the rate of crossing is kept."""
    w = R.series(["side"], "d")
    q = lambda p, n: F.percentile("loss", F.lit(p)).over(R.prior(w, n))
    b = V.losses(spark, sf).withColumns({"a": q(0.4, 10), "b": q(0.5, 60), "c": q(0.6, 20)}).filter("c is not null")
    s = b.withColumn("s", F.array_sort(F.array("a", "b", "c")))
    crossed = (S("a") > S("b")) | (S("b") > S("c"))
    return s.groupBy("side").agg(F.count("*").alias("n"), F.count_if(crossed).alias("crossed"), *[r(F.avg(F.get("s", F.lit(k))), 5).alias(f"mean_{k}") for k in range(3)])


def mean_excess_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Mean excess over a grid of quantiles of the positive losses, where at least eight lie above."""
    x = V.losses(spark, sf).filter("loss > 0")
    cuts = x.groupBy("side").agg(F.percentile("loss", F.array(*[F.lit(k / 20) for k in range(10, 20)])).alias("q")).select("side", F.posexplode("q").alias("k", "u"))
    out = x.join(F.broadcast(cuts), "side").filter("loss > u").groupBy("side", "k").agg(F.count("*").alias("n"), F.avg(S("loss") - S("u")).alias("e")).filter("n >= 8")
    return out.select("side", S("k").cast("long").alias("k"), "n", r("e").alias("mean_excess"))


def infoset_ladder(spark: SparkSession, sf: str) -> DataFrame:
    """Days on which all features of nested information sets have values, and days common to all sets."""
    from .panel import _features

    f = _features(spark, sf).filter("value is not null")
    ladder = {"A": S("feature").startswith("bar_"), "B": S("feature").startswith("bar_") | S("feature").startswith("macro_"), "C": F.lit(True)}
    out = None
    for name, keep in ladder.items():
        k = f.filter(keep).select("feature").distinct().count()
        days = f.filter(keep).groupBy("d").agg(F.countDistinct("feature").alias("k")).filter(S("k") == k).select("d", F.lit(name).alias("infoset"))
        out = days if out is None else out.unionByName(days)
    both = out.groupBy("d").agg(F.count("*").alias("sets"))
    return out.join(both, "d").groupBy("infoset").agg(F.count("*").alias("days"), F.count_if(S("sets") == len(ladder)).alias("common_days"), F.min("d").cast("string").alias("first"))


def fallback_model(spark: SparkSession, sf: str) -> DataFrame:
    """The first model in order of preference that has a forecast on the day."""
    f = V.forecasts(spark, sf).filter("model <> 'ewma' or dayofweek(d) not in (2, 3)").filter("model <> 'rolling' or dayofweek(d) <> 2")
    rank = F.when(S("model") == "ewma", 0).when(S("model") == "rolling", 1).otherwise(2)
    return f.groupBy("side", "d").agg(F.min_by("model", rank).alias("chosen")).groupBy("side", "chosen").agg(F.count("*").alias("days"))


def dropped_feature_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Gate decisions written as JSON per group and exploded again."""
    from .panel import training_gate

    g = training_gate(spark, sf).withColumn("grp", F.substring("feature", 1, 3))
    packed = g.groupBy("grp").agg(F.to_json(F.sort_array(F.collect_list(F.struct("feature", "gate")))).alias("decisions"))
    rows = packed.select("grp", F.explode(F.from_json("decisions", "array<struct<feature:string,gate:string>>")).alias("x"))
    return rows.groupBy(S("x.gate").alias("gate")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("x.feature")), ",").alias("features"))


def value_counts(spark: SparkSession, sf: str) -> DataFrame:
    e = V.table(spark, sf, "events")
    w = Window.orderBy(F.desc("n"), "event_type")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users")).select("event_type", "n", "users", F.row_number().over(w).cast("long").alias("rank"))


Q = {f.__name__: f for f in (oof_standardisation, quantile_rearrangement, mean_excess_curve, infoset_ladder, fallback_model, dropped_feature_summary, value_counts)}


def _panel(name: str) -> str:
    from . import panel

    return getattr(panel, name)


D = "CAST(d AS VARCHAR) AS d"
FOLDS = f"{V.LOSSES}, f AS (SELECT *, CASE WHEN rn >= {V.MIN_TRAIN} THEN CAST(floor((rn - {V.MIN_TRAIN}) / 200) AS INTEGER) ELSE -1 END AS fold FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY d) - 1 AS rn FROM losses))"
SQL = {
    "oof_standardisation": f"""WITH {FOLDS}, e AS (SELECT DISTINCT side, fold AS target FROM f WHERE fold >= 0), h AS (SELECT f.side, target, loss FROM f JOIN e ON e.side = f.side AND f.fold < target),
      b AS (SELECT side, target, avg(loss) AS mean, stddev_samp(loss) AS sd, quantile_cont(loss, 0.5) AS med, quantile_cont(loss, 0.75) - quantile_cont(loss, 0.25) AS iqr FROM h GROUP BY 1, 2),
      m AS (SELECT side, target, quantile_cont(abs(loss - med), 0.5) AS mad FROM h JOIN b USING (side, target) GROUP BY 1, 2)
      SELECT f.side, {D}, round((loss - mean) / sd, 6) AS z_mean, round((loss - med) / greatest(mad * 1.4826, 1e-4), 6) AS z_mad, round((loss - med) / greatest(iqr / 1.349, 1e-4), 6) AS z_iqr
      FROM f JOIN b ON b.side = f.side AND b.target = f.fold JOIN m ON m.side = f.side AND m.target = f.fold""",
    "quantile_rearrangement": f"""WITH {V.LOSSES}, q AS (SELECT side, quantile_cont(loss, 0.4) OVER a AS a, quantile_cont(loss, 0.5) OVER b AS b, quantile_cont(loss, 0.6) OVER c AS c FROM losses
        WINDOW a AS (PARTITION BY side ORDER BY d ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY side ORDER BY d ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), c AS (PARTITION BY side ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
      s AS (SELECT *, list_sort([a, b, c]) AS s FROM q WHERE c IS NOT NULL)
      SELECT side, count(*) AS n, count(*) FILTER (WHERE a > b OR b > c) AS crossed, round(avg(s[1]), 5) AS mean_0, round(avg(s[2]), 5) AS mean_1, round(avg(s[3]), 5) AS mean_2 FROM s GROUP BY side""",
    "mean_excess_curve": f"""WITH {V.LOSSES}, x AS (SELECT * FROM losses WHERE loss > 0), c AS (SELECT side, unnest(range(10)) AS k, unnest(quantile_cont(loss, [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95])) AS u FROM x GROUP BY side)
      SELECT side, k, count(*) AS n, round(avg(loss - u), 6) AS mean_excess FROM x JOIN c USING (side) WHERE loss > u GROUP BY side, k HAVING count(*) >= 8""",
    "infoset_ladder": f"""WITH {_panel('FEATURES')}, l(infoset, pat) AS (VALUES ('A', '^bar_'), ('B', '^(bar|macro)_'), ('C', '.')), v AS (SELECT infoset, d, feature FROM features, l WHERE value IS NOT NULL AND regexp_matches(feature, pat)),
      k AS (SELECT infoset, count(DISTINCT feature) AS k FROM v GROUP BY 1), o AS (SELECT infoset, d FROM v JOIN k USING (infoset) GROUP BY infoset, d, k.k HAVING count(DISTINCT feature) = k.k), b AS (SELECT d, count(*) AS sets FROM o GROUP BY d)
      SELECT infoset, count(*) AS days, count(*) FILTER (WHERE sets = 3) AS common_days, CAST(min(d) AS VARCHAR) AS first FROM o JOIN b USING (d) GROUP BY infoset""",
    "fallback_model": f"""WITH {V.FORECASTS}, f AS (SELECT side, d, arg_min(model, CASE model WHEN 'ewma' THEN 0 WHEN 'rolling' THEN 1 ELSE 2 END) AS chosen FROM forecasts WHERE (model <> 'ewma' OR dayofweek(d) NOT IN (1, 2)) AND (model <> 'rolling' OR dayofweek(d) <> 1) GROUP BY 1, 2)
      SELECT side, chosen, count(*) AS days FROM f GROUP BY 1, 2""",
    "dropped_feature_summary": f"WITH g AS ({_panel('SQL')['training_gate']}) SELECT gate, count(*) AS n, string_agg(feature, ',' ORDER BY feature) AS features FROM g GROUP BY gate",
    "value_counts": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, row_number() OVER (ORDER BY count(*) DESC, event_type) AS rank FROM events GROUP BY event_type",
}
