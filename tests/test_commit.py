from __future__ import annotations

import datetime as dt
import glob

import pytest
from pyspark.sql import functions as F

from tidemark.operators import binding
from tidemark.sources.commit import Damaged, ShardTable, StaleConfig, config_hash

SCHEMA = "model string, side string, k long, x double"


def shards(spark, n=4):
    return spark.createDataFrame([(f"m{k // 2}", "left" if k % 2 else None) for k in range(n)], "model string, side string")


def work(jobs):
    return jobs.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long")))).withColumn("x", F.when(F.col("k") > 1, F.col("k") / 3))


def table(spark, path, config=None):
    return ShardTable(spark, f"file://{path}/t", ["model", "side"], SCHEMA, config or {"level": 0.95, "nested": {"a": 1, "b": [2]}})


def test_versions_and_signatures(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.read().count() == 0 and t.manifest().count() == 0
    assert t.publish(work(shards(spark)).repartition(3)) == 1
    assert sorted(map(str, t.read().collect())) == sorted(map(str, work(shards(spark)).select("model", "side", "k", "x").collect()))
    one = {(r.model, r.side): r.signature for r in t.manifest().collect()}
    assert t.publish(work(shards(spark, 1)).coalesce(1).orderBy(F.desc("k"))) == 2
    assert {(r.model, r.side): r.signature for r in t.manifest().collect()} == one  # contents, not order or files, are signed
    t.publish(work(shards(spark, 1)).withColumn("x", F.col("x") * 2))
    assert t.read().filter("model = 'm0' and side is null and x > 3").count() == 1 and t.read().count() == 20
    assert t.read(1).filter("x > 3").count() == 0  # an earlier version stays as it was
    t.require_whole()
    assert t.fresh(3600) and not t.fresh(0)


def test_a_run_that_dies_leaves_the_old_version(spark, tmp_path):
    t = table(spark, tmp_path)
    t.publish(work(shards(spark, 2)))
    before = sorted(map(str, t.read().collect()))
    broken = work(shards(spark, 4)).withColumn("x", F.when(F.col("k") == 5, F.raise_error(F.lit("lost"))).otherwise(1.0))
    with pytest.raises(Exception, match="lost"):
        t.publish(broken)
    rename = ShardTable._publish
    ShardTable._publish = lambda self, manifest: (_ for _ in ()).throw(KeyboardInterrupt())
    try:
        with pytest.raises(KeyboardInterrupt):  # all is written, nothing published
            t.publish(work(shards(spark, 4)).withColumn("x", F.lit(9.0)))
    finally:
        ShardTable._publish = rename
    assert sorted(map(str, t.read().collect())) == before and t.versions() == [1]
    gone = t.collect_garbage()
    assert len([g for g in gone if g.startswith("data/")]) == 2 and sorted(map(str, t.read().collect())) == before


def test_resumed_runs_do_what_is_missing(spark, tmp_path):
    t = table(spark, tmp_path)
    done = []

    def counted(jobs):
        done.append(jobs.count())
        if len(done) == 2:
            raise RuntimeError("killed")
        return work(jobs).filter("model <> 'm3'")

    with pytest.raises(RuntimeError):
        t.resume(shards(spark, 8), counted, wave=3)
    have = t.manifest().count()
    assert have == done[0] and t.pending(shards(spark, 8)).count() == 8 - have
    assert t.resume(shards(spark, 8), counted, wave=3) == 8 - have
    assert t.manifest().filter("status = 'empty'").count() == 2  # m3 has no rows, and is not tried again
    assert t.resume(shards(spark, 8), counted, wave=3) == 0 and t.read().count() == 6 * 5
    assert t.resume(shards(spark, 9), counted) == 1


def test_other_configurations_are_refused(spark, tmp_path):
    assert config_hash({"a": 1, "b": {"c": 2, "d": 3}}) == config_hash({"b": {"d": 3, "c": 2}, "a": 1}) != config_hash({"a": 1})
    table(spark, tmp_path).publish(work(shards(spark)))
    other = table(spark, tmp_path, {"level": 0.99})
    for act in (lambda: other.publish(work(shards(spark))), lambda: other.resume(shards(spark), work)):
        with pytest.raises(StaleConfig):
            act()
    assert other.read().count() == 20
    other.reset()
    assert other.publish(work(shards(spark, 1))) == 3 and other.read().count() == 5


def test_damage_is_found_and_named(spark, tmp_path):
    t = table(spark, tmp_path)
    t.publish(work(shards(spark)))
    run = t.manifest().first().run
    folder = glob.glob(f"{tmp_path}/t/data/run={run}/model=m1/side=left")[0]
    spark.createDataFrame([(1, None), (2, 2 / 3), (3, 1.0), (4, 4 / 3), (5, 1.7)], "k long, x double").coalesce(1).write.mode("overwrite").parquet(f"file://{folder}")
    assert [(r.model, r.side, r.why) for r in t.damaged().collect()] == [("m1", "left", "contents")]
    with pytest.raises(Damaged):
        t.require_whole()


def panel(spark):
    rows = [(dt.date(2020, 1 + k // 20, 1 + k % 20), f, (k * 0.1 if (k + ord(f)) % 3 else None), dt.datetime(2020, 1 + k // 20, 1 + k % 20, 5)) for k in range(60) for f in "ab"]
    df = spark.createDataFrame(rows, "d date, feature string, value double, available timestamp")
    return df.withColumn("cutoff", F.col("d").cast("timestamp") + F.expr("interval 6 hours"))


def bound(df):
    return binding.bind(df, ["d", "feature"], ["value", "available"], F.trunc("d", "MM"), "d", "available", "cutoff")


def test_one_changed_cell_is_found_and_located(spark):
    p = panel(spark)
    first, days = bound(p).cache(), binding.calendar_hash(p.select("d").distinct(), ["d"])
    assert first.agg(F.sum("failures")).first()[0] == 0
    binding.require_bound(first, bound(p.repartition(7)), days, binding.calendar_hash(p.select("d").distinct().repartition(3), ["d"]))
    at = (F.col("d") == "2020-02-07") & (F.col("feature") == "b")
    changes = {"value": p.withColumn("value", F.when(at, 99.0).otherwise(F.col("value"))), "available": p.withColumn("available", F.when(at, F.col("available") + F.expr("interval 1 minute")).otherwise(F.col("available")))}
    for column, changed in changes.items():
        assert [(str(r.part), r.field) for r in binding.differences(first, bound(changed)).collect()] == [("2020-02-01", f"h_{column}")]
        with pytest.raises(binding.StaleBinding, match=f"2020, 2, 1.*h_{column}"):
            binding.require_bound(first, bound(changed), days, days)
    # two values that change places are a change too, and a month that goes is named
    swapped = p.withColumn("value", F.when(F.col("d") == "2020-01-02", 0.4).when(F.col("d") == "2020-01-05", 0.1).otherwise(F.col("value")))
    assert [r.field for r in binding.differences(first, bound(swapped)).collect()] == ["h_value"]
    assert [(str(r.part), r.field) for r in binding.differences(first, bound(p.filter("month(d) < 3"))).collect()] == [("2020-03-01", "part")]
    with pytest.raises(binding.StaleBinding, match="calendar"):
        binding.require_bound(first, first, days, "other")
    late = p.withColumn("available", F.when(at, F.col("cutoff") + F.expr("interval 1 second")).otherwise(F.col("available")))
    with pytest.raises(binding.StaleBinding, match="1 failures"):
        binding.require_bound(bound(late), bound(late), days, days)


def test_rows_without_feature_times_obey_the_row_rule(spark):
    p = panel(spark).withColumn("other", F.lit(None).cast("double"))
    assert binding.row_invariant(p, "available", "cutoff", ["value", "other"]).count() == 0
    p = p.withColumn("available", F.when(F.col("d") != "2020-01-03", F.col("available")))
    broken = binding.row_invariant(p, "available", "cutoff", ["value", "other"]).collect()
    assert broken and all(r.value is not None and str(r.d) == "2020-01-03" for r in broken)
