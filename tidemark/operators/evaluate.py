"""Scoring of VaR and ES forecasts: losses, coverage tests, common samples, inference inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from . import blocks as B
from .store import materialise


def scored(forecasts: DataFrame, level: float) -> DataFrame:
    """Forecasts (loss, var, es) with q_loss, fz_loss (null unless valid) and hit."""
    loss, var, es = F.col("loss"), F.col("var"), F.col("es")
    return forecasts.withColumns({"q_loss": X.quantile_loss(loss, var, level), "fz_loss": X.fz_loss(loss, var, es, level), "hit": loss > var})


def metrics(scores: DataFrame, keys: Sequence[str], day: str, level: float) -> DataFrame:
    """Per key: rows, hits, breach rate, mean losses, severity, Kupiec and Christoffersen statistics.

    Transitions follow the order of days; one window and one aggregation in all.
    """
    w = Window.partitionBy(*keys).orderBy(day)
    s = scores.withColumn("before", F.lag("hit").over(w))
    pair = lambda a, b: F.count_if((F.col("before") == a) & (F.col("hit") == b)).alias(f"n{int(a)}{int(b)}")
    g = s.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.count_if("hit").alias("hits"), F.avg("q_loss").alias("mean_q"), F.avg("fz_loss").alias("mean_fz"),
        F.avg(F.when(F.col("hit"), F.col("loss") - F.col("var"))).alias("severity"), *[pair(a, b) for a in (False, True) for b in (False, True)],
    )
    return g.withColumns({
        "breach_rate": F.col("hits") / F.col("rows"),
        "kupiec_lr": X.kupiec_lr(F.col("hits"), F.col("rows"), 1 - level),
        "christoffersen_lr": X.christoffersen_lr(F.col("n00"), F.col("n01"), F.col("n10"), F.col("n11")),
    })


def common_sample(scores: DataFrame, keys: Sequence[str], model: str, day: str, anchor: str, least_overlap: float) -> tuple[DataFrame, DataFrame]:
    """The models of each key that cover enough of the anchor's days, and the days that all of these have."""
    valid = scores.filter("fz_loss is not null").select(*keys, model, day).distinct()
    base = valid.filter(F.col(model) == anchor).select(*keys, day)
    sizes = base.groupBy(*keys).agg(F.count("*").alias("anchor_days"))
    overlap = valid.join(base, [*keys, day]).groupBy(*keys, model).agg(F.count("*").alias("overlap"))
    status = overlap.join(sizes, list(keys)).withColumn("kept", F.col("overlap") >= least_overlap * F.col("anchor_days"))
    kept = status.filter("kept").select(*keys, model)
    k = kept.groupBy(*keys).agg(F.count("*").alias("k"))
    days = valid.join(kept, [*keys, model]).groupBy(*keys, day).agg(F.count("*").alias("have")).join(k, list(keys)).filter("have = k").select(*keys, day)
    return status, days


def on_common_days(scores: DataFrame, keys: Sequence[str], model: str, day: str, value: str) -> DataFrame:
    """The rows of the days on which every model of the key has a value; a model has one row a day."""
    valid = scores.filter(F.col(value).isNotNull())
    models = valid.groupBy(*keys).agg(F.countDistinct(model).alias("__all"))
    days = valid.groupBy(*keys, day).agg(F.count("*").alias("__have")).join(models, list(keys)).filter("__have = __all").select(*keys, day)
    return valid.join(days, [*keys, day], "left_semi")


def murphy(scores: DataFrame, keys: Sequence[str], points: int, level: float) -> DataFrame:
    """Mean elementary score of each key over a grid between the 1 % and 99 % quantiles of all losses.

    The grid is a fixed number of points, so each forecast meets it in an explode.
    """
    edges = scores.agg(F.percentile("loss", F.lit(0.01)).alias("lo"), F.percentile("loss", F.lit(0.99)).alias("hi"))
    grid = edges.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")).select("point", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("point") / (points - 1)).alias("theta"))
    score = (F.when(F.col("loss") > F.col("theta"), 1.0).otherwise(0.0) - (1 - level)) * (F.col("var") - F.col("theta"))
    part = F.when(F.col("var") > F.col("theta"), score).otherwise(0.0)
    return scores.select(*keys, "loss", "var").crossJoin(F.broadcast(grid)).groupBy(*keys, "point").agg(F.avg(part).alias("score"), F.first("theta").alias("theta"))


def joint_hits(scores: DataFrame, day: str) -> DataFrame:
    """Days on which any of the entities breaches, and how many do."""
    return scores.groupBy(day).agg(F.bool_or("hit").alias("any_hit"), F.count_if("hit").alias("hits")).filter("any_hit")


def paired(scores: DataFrame, keys: Sequence[str], model: str, day: str, anchor: str, value: str) -> DataFrame:
    """Difference of `value` of every other model to the anchor on the days that both have."""
    a = scores.filter(F.col(model) == anchor).select(*keys, day, F.col(value).alias("anchor_value"))
    b = scores.filter(F.col(model) != anchor).select(*keys, model, day, F.col(value).alias("value"))
    return b.join(a, [*keys, day]).withColumn("diff", F.col("value") - F.col("anchor_value")).filter("diff is not null")


def bootstrap_sums(values: DataFrame, keys: Sequence[str], day: str, value: str, draws: int = 999, seed: int = 225) -> DataFrame:
    """keys, n, total, block, draw, drawn: of each series the sum of its values and of those in each draw of a circular moving-block bootstrap.

    A draw has n values in blocks of about the cube root of n (five at least), the last one cut short.  A block is the difference of two
    running sums, so that a draw costs two rows for each block, whatever the block's length; where blocks start follows from a hash
    of seed, draw and block, so that series of the same length are drawn alike.
    """
    placed = B.positions(values.select(*keys, day, value).filter(F.col(value).isNotNull()), keys, day, "__pos")
    sums = B.running_sums(placed, keys, {"__before": F.col(value)}, "__pos").select(*keys, "__pos", "__before", (F.col("__before") + F.col(value)).alias("__after"))
    sums = materialise(sums, "sums")
    n, block, k = F.col("n"), F.col("block"), F.col("__k")
    sizes = sums.groupBy(*keys).agg(F.count("*").alias("n"), F.max_by("__after", "__pos").alias("total"))
    sizes = sizes.withColumn("block", F.least(n, F.greatest(F.lit(5), F.round(F.pow(n.cast("double"), F.lit(1 / 3))).cast("long"))))
    blocks = sizes.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(n / block) - 1)))
    start = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "draw", "__k")), 1, 8), 16, 10).cast("long") % n
    blocks = blocks.withColumn("__start", start).withColumn("__stop", F.col("__start") + F.least(block, n - k * block))
    # a block is the sum before its stop without the sum before its start; at the end of the series it goes on from the beginning
    around = F.when(F.col("__stop") >= n, F.col("total")).otherwise(0.0)
    end = lambda at, sign, more: F.struct(at.alias("__at"), F.lit(sign).alias("__sign"), more.alias("__more"))
    ends = F.explode(F.array(end(F.col("__start"), -1.0, F.lit(0.0)), end(F.col("__stop") % n, 1.0, around)))
    looked = blocks.select(*keys, "n", "total", "block", "draw", ends.alias("__e")).select(*keys, "n", "total", "block", "draw", "__e.*")
    known = sums.select(*[F.col(c).alias(f"__r_{c}") for c in keys], F.col("__pos").alias("__r_at"), "__before")
    joined = looked.join(known, [*[F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in keys], F.col("__at") == F.col("__r_at")])
    return joined.groupBy(*keys, "n", "total", "block", "draw").agg(F.sum(F.col("__sign") * F.col("__before") + F.col("__more")).alias("drawn"))


def one_sided(drawn: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, pairs, mean, p_less, p_greater, block from drawn sums of differences: how often a draw of the centred differences is as low
    (as high) as their mean."""
    mean = F.col("total") / F.col("n")
    moved = F.col("drawn") / F.col("n") - mean
    draws = F.count("*")
    out = drawn.groupBy(*keys, F.col("n").alias("pairs"), mean.alias("mean"), "block").agg(
        ((F.count_if(moved <= mean) + 1) / (draws + 1)).alias("p_less"), ((F.count_if(moved >= mean) + 1) / (draws + 1)).alias("p_greater")
    )
    return out.select(*keys, "pairs", "mean", "p_less", "p_greater", "block")


def all_pairs(drawn: DataFrame, keys: Sequence[str], model: str) -> DataFrame:
    """Drawn sums of the difference of each pair of models of a key, which have the same days: sums are drawn once for each model, not for each pair."""
    a, b = (drawn.select(*keys, "draw", F.col(model).alias(f"{p}_model"), *[F.col(c).alias(f"{p}_{c}") for c in ("n", "total", "block", "drawn")]) for p in ("a", "b"))
    met = a.join(b, [*keys, "draw"]).filter("a_model < b_model and a_n = b_n")
    return met.select(*keys, "a_model", "b_model", "draw", F.col("a_n").alias("n"), F.col("a_block").alias("block"), (F.col("a_total") - F.col("b_total")).alias("total"), (F.col("a_drawn") - F.col("b_drawn")).alias("drawn"))
