"""Queries over published shards and bound audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import binding
from ..operators.store import place
from ..sources.commit import ShardTable
from . import views as V
from .panel import FEATURES, S, _features, text


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """The long panel with values in millionths, whose text is the same everywhere."""
    return _features(spark, sf).select("d", "feature", F.round("value", 6).cast("decimal(28,6)").alias("value"), "available", "cutoff")


def leakage_binding(spark: SparkSession, sf: str) -> DataFrame:
    """The audit's binding: by month the panel's rows, bounds, failures and a hash of each column's cells."""
    out = binding.bind(panel(spark, sf), ["d", "feature"], ["value", "available"], F.trunc("d", "MM"), "d", "available", "cutoff")
    return out.withColumn("part", text("part"))


def leakage_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the panel that break the row-level rule: with a value, and without a time at or before the cutoff."""
    out = binding.row_invariant(panel(spark, sf), "available", "cutoff", ["value"])
    return out.groupBy("feature").agg(F.count("*").alias("n"), F.min(text("d")).alias("first"))


def shard_publication(spark: SparkSession, sf: str) -> DataFrame:
    """Orders in shards by year and priority: one year is published first, a second run does the others, and the result is read back by its manifest."""
    o = V.table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), S("o_orderpriority").alias("priority"), "o_orderkey", F.round(S("o_totalprice") * 100).cast("long").alias("cents"))
    t = ShardTable(spark, place(spark, "shards"), ["year", "priority"], "year int, priority string, o_orderkey long, cents long", {"source": "orders", "unit": "cents"})
    jobs = o.select("year", "priority").distinct()
    work = lambda part: o.join(part, ["year", "priority"], "left_semi")
    t.publish(work(jobs.filter("year = 1995")), jobs.filter("year = 1995"))
    t.resume(jobs, work, wave=100)
    met = t.manifest().groupBy("year", "priority").agg(F.sum("rows").alias("signed_rows"))
    back = t.read().groupBy("year", "priority").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))
    return back.join(met, ["year", "priority"]).select("year", "priority", "n", "cents", "signed_rows")


Q = {f.__name__: f for f in (leakage_binding, leakage_rows, shard_publication)}


def _hash(cells: list[str]) -> str:
    parts = ", ".join(f"coalesce('=' || CAST({c} AS VARCHAR), '-')" for c in cells)
    return f"CAST('0x' || substr(md5(array_to_string([{parts}], chr(31))), 1, 15) AS HUGEINT)"


PANEL = f"{FEATURES}, panel AS (SELECT d, feature, CAST(round(value, 6) AS DECIMAL(28, 6)) AS value, available FROM features)"
SQL = {
    "leakage_binding": f"""WITH {PANEL} SELECT CAST(CAST(date_trunc('month', d) AS DATE) AS VARCHAR) AS part, count(*) AS rows, CAST(min(d) AS VARCHAR) AS first_day, CAST(max(d) AS VARCHAR) AS last_day,
      count(*) FILTER (WHERE coalesce(available > d, TRUE)) AS failures, CAST(sum({_hash(["d", "feature", "value"])}) AS VARCHAR) AS h_value, CAST(sum({_hash(["d", "feature", "available"])}) AS VARCHAR) AS h_available FROM panel GROUP BY 1""",
    "leakage_rows": f"WITH {PANEL} SELECT feature, count(*) AS n, CAST(min(d) AS VARCHAR) AS first FROM panel WHERE value IS NOT NULL AND coalesce(available > d, TRUE) GROUP BY 1",
    "shard_publication": "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS priority, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS signed_rows FROM orders GROUP BY 1, 2",
}
