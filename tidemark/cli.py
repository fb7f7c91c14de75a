"""Command line: run registered queries and the panel's standard jobs, writing Parquet or CSV.

    python -m tidemark.cli list
    python -m tidemark.cli run QUERY --data DIR --out DIR
    python -m tidemark.cli forecast --data DIR --out DIR [--models A,B] [--level L] [--wave N]
    python -m tidemark.cli status --out DIR
    python -m tidemark.cli snapshot --out DIR --to DIR
    python -m tidemark.cli build-panel|evaluate|sensitivity|leakage-check|feature-audit|calendar-build|contracts-build|export-tables --data DIR --out DIR
"""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import binding, evaluate, origins, tails
from .operators.blocks import positions
from .plans import publication, registry, views
from .sources.commit import Damaged, ShardTable, StaleConfig

JOBS = {
    "build-panel": ["pit_panel_long", "pit_panel_wide", "feature_coverage"],
    "evaluate": ["forecast_loss_matrix", "forecast_metrics", "forecast_pvalues", "common_sample_eviction", "dm_block_bootstrap", "murphy_curves", "stress_windows"],
    "sensitivity": ["sensitivity_compare", "gpd_stability", "admissibility_screen"],
    "leakage-check": ["leakage_audit", "leakage_status_counts"],
    "feature-audit": ["feature_coverage", "training_gate", "field_coverage_policy"],
    "calendar-build": ["calendar_dense_flags", "refit_calendar", "h10_release_calendar"],
    "contracts-build": ["contract_roll_table", "central_contract"],
    "export-tables": ["rank_export", "model_comparison_mean_sd", "block_summaries", "target_summary_jb"],
}

FORECASTS = "side string, refit int, model string, d date, loss double, var double, es double, status string"


def forecast_table(spark: SparkSession, out: str, config: dict) -> ShardTable:
    """The published forecasts: a shard for each side and refit."""
    return ShardTable(spark, f"{out}/forecasts", ["side", "refit"], FORECASTS, config)


def forecast(spark: SparkSession, data: str, out: str, models: list[str], level: float, wave: int, least: int = origins.LEAST_ROWS) -> int:
    """Publish the forecasts of every refit that is not there yet, `wave` shards at a time; how many were done.

    A table that other models, another level or other losses made is refused."""
    losses = views.losses(spark, data)
    series = binding.bind(losses.withColumn("t", F.lit("2000-01-01")), ["d", "side"], ["loss"], F.lit(0), "d", "t", "t").first()
    table = forecast_table(spark, out, {"models": sorted(models), "level": level, "least": least, "losses": series.h_loss, "days": series.rows})
    placed = positions(losses, ["side"], "d")
    jobs = origins.refit_days(placed, ["side"], "d", least).select("side", F.col("refit").cast("int").alias("refit"))

    def work(part: DataFrame) -> DataFrame:
        refits = [r.refit for r in part.select("refit").distinct().collect()]  # a wave at most
        made = origins.forecasts(losses, ["side"], "d", "loss", models, level, least, refits)
        return made.join(part, ["side", "refit"], "left_semi")

    return table.resume(jobs, work, wave)


def status(spark: SparkSession, out: str) -> list[str]:
    """What is published: version, configuration, shards by status, rows, and shards that are not what was signed."""
    table = forecast_table(spark, out, {})
    if not table.versions():
        return ["nothing is published"]
    m = table.manifest()
    lines = [f"version {table.versions()[-1]}", *[f"configuration {r.config[:12]}" for r in m.select("config").distinct().collect()]]
    lines += [f"{r.status}: {r.n} shards, {r.rows} rows" for r in m.groupBy("status").agg(F.count("*").alias("n"), F.sum("rows").alias("rows")).orderBy("status").collect()]
    return [*lines, f"damaged: {table.damaged().count()} shards"]


def snapshot(spark: SparkSession, out: str, to: str, level: float = views.LEVEL) -> None:
    """Write the metrics of the published forecasts and the manifest that they come from, as CSV; damaged shards are refused."""
    table = forecast_table(spark, out, {})
    table.require_whole()
    table.manifest().coalesce(1).write.mode("overwrite").option("header", True).csv(f"{to}/manifest")
    scores = evaluate.scored(table.read().filter("var is not null"), level)
    evaluate.metrics(scores, ["side", "model"], "d", level).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{to}/metrics")


def check_binding(spark: SparkSession, data: str, out: str, rebind: bool) -> int:
    """Bind the audit to the panel on the first run; later ones refuse a panel or calendar that has changed, and name what did."""
    now = publication.leakage_binding(spark, data)
    calendar = spark.createDataFrame([(binding.calendar_hash(views.daily(spark, data).select("d"), ["d"]),)], "hash string")
    try:
        bound, was = (None, None) if rebind else (spark.read.parquet(f"{out}/binding"), spark.read.parquet(f"{out}/calendar").first().hash)
    except AnalysisException:
        bound = None
    if bound is None:
        now.write.mode("overwrite").parquet(f"{out}/binding")
        calendar.write.mode("overwrite").parquet(f"{out}/calendar")
        bound, was = spark.read.parquet(f"{out}/binding"), calendar.first().hash
    try:
        binding.require_bound(bound, now, was, calendar.first().hash)
    except binding.StaleBinding as e:
        print(e, file=sys.stderr)
        return 1 if "failures" in str(e) else 3
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    for name in ("run", "forecast", "status", "snapshot", *JOBS):
        p = commands.add_parser(name)
        if name == "run":
            p.add_argument("query")
        if name not in ("status", "snapshot"):
            p.add_argument("--data", required=True)
        p.add_argument("--out", required=True)
        if name == "forecast":
            p.add_argument("--models", default=",".join(tails.MODELS))
            p.add_argument("--level", type=float, default=views.LEVEL)
            p.add_argument("--wave", type=int, default=24)
            p.add_argument("--least", type=int, default=origins.LEAST_ROWS)
        if name == "snapshot":
            p.add_argument("--to", required=True)
        if name == "leakage-check":
            p.add_argument("--rebind", action="store_true")
    args = parser.parse_args(argv)
    queries = registry.queries()
    if args.command == "list":
        print("\n".join(sorted(queries)))
        return 0
    session = lambda: SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "forecast":
        try:
            print(f"{forecast(session(), args.data, args.out, args.models.split(','), args.level, args.wave, args.least)} shards published")
        except StaleConfig as e:
            print(e, file=sys.stderr)
            return 3
        return 0
    if args.command == "status":
        print("\n".join(status(session(), args.out)))
        return 0
    if args.command == "snapshot":
        try:
            snapshot(session(), args.out, args.to)
        except Damaged as e:
            print(e, file=sys.stderr)
            return 3
        return 0
    names = [args.query] if args.command == "run" else JOBS[args.command]
    if unknown := [n for n in names if n not in queries]:
        print(f"unknown query: {', '.join(unknown)}", file=sys.stderr)
        return 2
    spark = session()
    for name in names:
        df = queries[name](spark, args.data)
        if args.command == "export-tables":
            df.write.mode("overwrite").option("header", True).csv(f"{args.out}/{name}")
        else:
            df.write.mode("overwrite").option("compression", "zstd").parquet(f"{args.out}/{name}")
    if args.command == "leakage-check":
        return check_binding(spark, args.data, args.out, args.rebind)
    return 0


if __name__ == "__main__":
    sys.exit(main())
