"""Projections of scores, diagnostics and audits that reports are made from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Common days below which no metrics and no tests of differences are given, and joint exceptions below which no tests are.
METRIC_DAYS, TEST_DAYS, TEST_EXCEPTIONS = 120, 250, 20


def combined_status(rows: DataFrame, keys: Sequence[str], status: str, unstable: str = "common_sample_unstable") -> DataFrame:
    """One status for each key over its tails: the unstable one if any has it, ok if all are, else the distinct ones in order.

    Null statuses count as none; a key that has no status is unavailable.
    """
    met = F.array_sort(F.collect_set(status))
    g = rows.groupBy(*keys).agg(met.alias("__met"))
    one = (
        F.when(F.size("__met") == 0, "unavailable_empty_forecasts")
        .when(F.array_contains("__met", unstable), unstable)
        .otherwise(F.array_join("__met", ","))
    )
    return g.select(*keys, one.alias("combined_status"))


def sample_audit(scores: DataFrame, keys: Sequence[str], model: str, day: str, wanted: Sequence[str], hit: str = "hit") -> DataFrame:
    """One row for each key: how many days all wanted models have, from when to when, joint exceptions, which models are there and which are
    missing, and whether metrics and tests of differences may be given.

    A joint exception is a day on which a model breaches.  A model's repeated rows of a day count once.  Days are counted per key and day
    before they meet, so that no row holds a key's days; the lists are of models.
    """
    named = scores.filter(F.col(model).isin(*wanted))
    days = named.groupBy(*keys, day).agg(F.countDistinct(model).alias("__have"), F.coalesce(F.bool_or(hit), F.lit(False)).alias("__hit"))
    have = named.groupBy(*keys).agg(F.array_sort(F.collect_set(model)).alias("entities"))
    every = scores.select(*keys).distinct().join(have, list(keys), "left").withColumn("entities", F.coalesce("entities", F.array().cast("array<string>")))
    common = days.join(have.select(*keys, F.size("entities").alias("__all")), list(keys)).filter("__have = __all")
    g = common.groupBy(*keys).agg(F.count("*").alias("common_n"), F.min(day).alias("date_start"), F.max(day).alias("date_end"), F.count_if("__hit").alias("joint_exceptions"))
    out = every.join(g, list(keys), "left").fillna(0, ["common_n", "joint_exceptions"])
    missing = F.array_except(F.array(*[F.lit(m) for m in sorted(wanted)]), F.col("entities"))
    n, joint = F.col("common_n"), F.col("joint_exceptions")
    lost = F.when(F.size(missing) > 0, "unavailable_missing_model")
    metric = lost.when(n < METRIC_DAYS, "unavailable_few_common_days").otherwise("ok")
    test = lost.when(n < TEST_DAYS, "unavailable_few_common_days").when(joint < TEST_EXCEPTIONS, "unavailable_few_joint_exceptions").otherwise("ok")
    return out.select(
        *keys, F.to_json("entities").alias("entities_json"), F.to_json(missing).alias("missing_json"), "common_n", "date_start", "date_end", "joint_exceptions",
        F.when(n > 0, joint / n).alias("joint_rate"), metric.alias("metric_status"), test.alias("test_status"),
    )


def standardised(rows: DataFrame, keys: Sequence[str], x: str, residual: str) -> DataFrame:
    """`standardised` for each row: minus the fitted residual where the key has finite ones (rows without are left out), else x less its mean
    over its sample deviation, which is at least 1e-12.  One aggregation, joined back by key."""
    value, fitted = F.col(x).cast("double"), F.col(residual).cast("double")
    whole = fitted.isNotNull() & ~F.isnan(fitted) & (F.abs(fitted) < float("inf"))
    g = rows.groupBy(*keys).agg(F.count_if(whole).alias("__fitted"), F.avg(value).alias("__mean"), F.greatest(F.stddev_samp(value), F.lit(1e-12)).alias("__sd"))
    out = rows.join(g, list(keys)).filter((F.col("__fitted") == 0) | whole)
    own = F.when(F.col("__fitted") > 0, -fitted).otherwise((value - F.col("__mean")) / F.col("__sd"))
    return out.withColumn("standardised", own).drop("__fitted", "__mean", "__sd")


def publishable(rows: DataFrame, policy: str = "primary_common_sample") -> DataFrame:
    """The rows that a paper may show: of the primary sample, with status ok, and fitted and valid where the table has those columns.
    A table without sample policy or status has none."""
    have = set(rows.columns)
    if not {"sample_policy", "common_sample_status"} <= have:
        return rows.limit(0)
    keep = (F.col("sample_policy") == policy) & (F.col("common_sample_status") == "ok")
    if "fit_status" in have:
        keep = keep & (F.col("fit_status") == "ok")
    if "is_valid_forecast" in have:
        keep = keep & F.col("is_valid_forecast")
    return rows.filter(keep)


def value_range(frames: Sequence[DataFrame], column: str) -> DataFrame:
    """n, low, high of a column over the union of the frames that have it; nulls and NaN are left out.  Always one row."""
    parts = [f.select(F.col(column).cast("double").alias("v")) for f in frames if column in f.columns]
    if not parts:
        return frames[0].select(F.lit(None).cast("double").alias("v")).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.filter("v is not null and not isnan(v)").agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))


def power_counts(matrix: DataFrame, power: str, inference: DataFrame, status: str) -> DataFrame:
    """How many rows of the matrix lack tail events, and how many of the tests could not be made; one row."""
    a = matrix.agg(F.count_if(F.col(power).contains("insufficient")).alias("low_power_rows"))
    b = inference.agg(F.count_if(F.col(status).contains("unavailable")).alias("unavailable_tests"), F.count("*").alias("tests"))
    return a.crossJoin(b)  # one row each


def passing(checks: DataFrame, model: str, ok: Column, scenarios: int) -> DataFrame:
    """Models that pass in each of the scenarios; a missing scenario or a null check is a failure."""
    return checks.groupBy(model).agg(F.count_if(ok).alias("__ok"), F.count("*").alias("__n")).filter((F.col("__ok") == F.col("__n")) & (F.col("__n") == scenarios)).select(model)


def job_grid(keys: DataFrame, models: Sequence[str], family: str, settings: dict[str, float], level: float | None = None) -> DataFrame:
    """One job for each key, model and setting, with a label, an id that names all of it, and no claim to the primary result.
    With a level, each setting is a threshold and has to lie below it."""
    if level is not None and any(v >= level for v in settings.values()):
        raise ValueError(f"thresholds must lie below the level {level}: {settings}")
    cells = [F.struct(F.lit(m).alias("model"), F.lit(k).alias("config"), F.lit(float(v)).alias("setting")) for m in models for k, v in settings.items()]
    out = keys.distinct().select("*", F.explode(F.array(*cells)).alias("c")).select(*keys.columns, "c.*")
    named = F.concat_ws("|", F.lit(family), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in [*keys.columns, "model", "config"]])
    return out.select("*", F.lit(family).alias("family"), F.lit(False).alias("primary_claim_allowed"), F.substring(F.sha2(named, 256), 1, 16).alias("job"))


def overlay(forecasts: DataFrame, keys: Sequence[str], model: str, first: Sequence[str], others: Sequence[str], valid: Column) -> DataFrame:
    """Valid rows for one chart: of `first` (a model and its stand-ins) each key's first one there is, as group 0, then each of the others
    in its order.  plot_group is the model's name, plot_order its place."""
    order = F.array_position(F.array(*[F.lit(m) for m in [*first, *others]]), F.col(model))
    rows = forecasts.filter(F.col(model).isin(*first, *others)).withColumn("__rank", order.cast("int"))
    head = rows.filter(F.col("__rank") <= len(first)).groupBy(*keys).agg(F.min("__rank").alias("__head"))
    rows = rows.join(head, list(keys), "left").filter((F.col("__rank") > len(first)) | (F.col("__rank") == F.col("__head")))
    place = F.greatest(F.col("__rank") - len(first), F.lit(0))
    return rows.filter(valid).withColumns({"plot_group": F.col(model), "plot_order": place}).drop("__rank", "__head")


def plot_rows(rows: DataFrame, order: Sequence[str], most: int) -> DataFrame:
    """The first rows in an order; the limit is the feature, ties are decided by the columns named."""
    return rows.orderBy(*order).limit(most)


def expectiles(rows: DataFrame, keys: Sequence[str], x: str, taus: Sequence[float], buckets: int = 64) -> DataFrame:
    """keys, tau, expectile, breach_rate: exact sample expectiles.

    Between two neighbouring values both sides' sums are linear in the expectile, so it is a quotient of sums below and above the
    right one.  Equal values are counted first and running sums are carried over ranges of values, so that a key may hold any
    share of the rows: no task sees more than a range's distinct values.  Nulls and NaN are left out.
    """
    value = F.col(x).cast("double")
    counts = rows.filter(value.isNotNull() & ~F.isnan(value)).groupBy(*keys, value.alias("__v")).agg(F.count("*").alias("__n"))
    edges = counts.groupBy(*keys).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.sum("__n").alias("__all"), F.sum(F.col("__n") * F.col("__v")).alias("__total"))
    part = F.when(F.col("__hi") > F.col("__lo"), F.floor((F.col("__v") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * buckets)).otherwise(0)
    counts = counts.join(edges, list(keys)).withColumn("__part", part)
    sums = counts.groupBy(*keys, "__part").agg(F.sum("__n").alias("__pn"), F.sum(F.col("__n") * F.col("__v")).alias("__ps"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    after = F.min("__first").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(1, 1))
    starts = counts.groupBy(*keys, "__part").agg(F.min("__v").alias("__first")).withColumn("__following", after)
    sums = sums.withColumns({"__bn": F.coalesce(F.sum("__pn").over(before), F.lit(0)), "__bs": F.coalesce(F.sum("__ps").over(before), F.lit(0.0))})
    inside = Window.partitionBy(*keys, "__part").orderBy("__v")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    w = counts.join(sums.join(starts, [*keys, "__part"]), [*keys, "__part"]).withColumns({
        "__k": F.col("__bn") + F.sum("__n").over(upto),
        "__s": F.col("__bs") + F.sum(F.col("__n") * F.col("__v")).over(upto),
        "__next": F.coalesce(F.lead("__v").over(inside), F.col("__following")),
    })
    t = F.explode(F.array(*[F.lit(float(v)) for v in taus]))
    w = w.select(*keys, "__v", "__next", "__k", "__s", "__all", "__total", t.alias("tau"))
    above, k, tau = F.col("__all") - F.col("__k"), F.col("__k"), F.col("tau")
    e = (tau * (F.col("__total") - F.col("__s")) + (1 - tau) * F.col("__s")) / (tau * above + (1 - tau) * k)
    w = w.withColumn("__e", e)
    # a segment holds e if e lies from its value up to the next; of two that meet at e the upper one counts, so that equal values are no breach
    away = F.greatest(F.col("__v") - F.col("__e"), F.coalesce(F.col("__e") - F.col("__next"), F.lit(0.0)), F.lit(0.0))
    best = w.groupBy(*keys, "tau").agg(F.min_by(F.struct("__e", (above / F.col("__all")).alias("rate")), F.struct(away, -F.col("__v"))).alias("__b"))
    return best.select(*keys, "tau", F.col("__b.__e").alias("expectile"), F.col("__b.rate").alias("breach_rate"))
