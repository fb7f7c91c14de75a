"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit, boosted, chains, evaluation, extras, features, gains, models, panel, publication, refined, reports, streams

GROUPS = [panel, features, evaluation, models, extras, audit, boosted, publication, streams, refined, chains, reports, gains]


def entry(spark: SparkSession) -> DataFrame:
    """Coverage and losses of three forecast models over both tails, from orders to metrics."""
    return evaluation.forecast_metrics(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for group in GROUPS:
        out |= group.Q
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for group in GROUPS:
        out |= group.SQL
    return out
