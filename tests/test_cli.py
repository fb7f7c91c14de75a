from __future__ import annotations

import glob
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.operators import origins

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="test tables are not here")


def test_forecasts_are_resumed_and_refused(spark, tmp_path, capsys, monkeypatch):
    args = ["forecast", "--data", str(SF), "--out", f"file://{tmp_path}", "--least", "500", "--wave", "2"]
    assert cli.main(["status", "--out", f"file://{tmp_path}"]) == 0 and "nothing" in capsys.readouterr().out
    calls = []

    def made(losses, keys, day, loss, models, level, least, refits):  # test_origins has the forecasts themselves
        rows = [(side, k, f"{models[0]}", None, 0.5, 1.0 + k, 2.0 + k, "ok") for side in ("left", "right") for k in refits]
        return spark.createDataFrame(rows, cli.FORECASTS)

    def dies(*a, **k):
        calls.append(a[7])
        if len(calls) == 2:
            raise RuntimeError("killed")
        return made(*a, **k)

    monkeypatch.setattr(origins, "forecasts", dies)
    with pytest.raises(RuntimeError):
        cli.main([*args, "--models", "pot"])
    table = cli.forecast_table(spark, f"file://{tmp_path}", {})
    have = table.manifest().count()
    assert have >= 1
    monkeypatch.setattr(origins, "forecasts", made)
    capsys.readouterr()
    assert cli.main([*args, "--models", "pot"]) == 0
    said = capsys.readouterr().out
    assert int(said.split()[0]) == table.manifest().count() - have > 0
    assert cli.main([*args, "--models", "pot"]) == 0 and capsys.readouterr().out.startswith("0 shards")
    assert cli.main([*args, "--models", "caviar_sav"]) == 3 and "configuration" in capsys.readouterr().err
    assert {(r.side, r.refit): (r["var"], r.model) for r in table.read().collect()} == {(r.side, r.refit): (1.0 + r.refit, "pot") for r in table.manifest().collect()}
    assert cli.main(["status", "--out", f"file://{tmp_path}"]) == 0 and "damaged: 0" in capsys.readouterr().out
    assert cli.main(["snapshot", "--out", f"file://{tmp_path}", "--to", f"file://{tmp_path}/snap"]) == 0
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/snap/metrics").count() == 2
    victim = glob.glob(f"{tmp_path}/forecasts/data/run=*/side=left/refit=*")[0]
    spark.createDataFrame([("x", None, 1.0, 1.0, 1.0, "ok")], "model string, d date, loss double, var double, es double, status string").write.mode("overwrite").parquet(f"file://{victim}")
    assert cli.main(["snapshot", "--out", f"file://{tmp_path}", "--to", f"file://{tmp_path}/snap"]) == 3


def test_leakage_check_binds_the_panel(spark, tmp_path, capsys):
    """The tables' own panel has late values; one without them passes until a cell changes."""
    data = f"file://{tmp_path}/data"
    for name in ("orders", "lineitem"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{data}/{name}.parquet")
    args = ["leakage-check", "--data", data, "--out", f"file://{tmp_path}/out"]
    first = cli.main(args)
    assert first == 1 and "failures" in capsys.readouterr().err
    o = spark.read.parquet(f"{SF}/orders.parquet")
    one = o.agg(F.min("o_orderkey")).first()[0]
    capsys.readouterr()
    o.withColumn("o_totalprice", F.when(F.col("o_orderkey") == one, 1.0).otherwise(F.col("o_totalprice"))).write.mode("overwrite").parquet(f"{data}/orders.parquet")
    assert cli.main(args) == 3 and "h_value" in capsys.readouterr().err
    assert cli.main([*args, "--rebind"]) == 1
