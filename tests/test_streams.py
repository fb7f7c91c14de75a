from __future__ import annotations

import datetime as dt
import os
import random

import pytest

from tidemark.streaming import availability, ordered

START = dt.datetime(2024, 1, 1)


def written(spark, folder, files, schema):
    """One file for each list of rows, to be read in this order."""
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{folder}/{k}")
        for part in os.listdir(f"{folder}/{k}"):
            if part.endswith(".parquet"):
                os.utime(f"{folder}/{k}/{part}", (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{folder}")


def run(spark, stream, folder, conf=()):
    for k, v in dict(conf).items():
        spark.conf.set(k, v)
    try:
        q = stream.writeStream.format("parquet").option("path", f"file://{folder}/out").option("checkpointLocation", f"file://{folder}/log").trigger(availableNow=True).start()
        q.awaitTermination(200)
    finally:
        for k in dict(conf):
            spark.conf.unset(k)
    return spark.read.schema(stream.schema).parquet(f"file://{folder}/out").collect(), ordered.dropped_rows(q)


def rows_of(n=90):
    rng = random.Random(1)
    return [("ab"[k % 2], START + dt.timedelta(minutes=k // 3, microseconds=rng.randrange(3)), k, rng.gauss(0, 2)) for k in range(n)]


def by_hand(rows, passed):
    out, v = {}, {}
    for key, ts, k, x in sorted(rows, key=lambda r: (r[1], r[2])):
        if ts <= passed:
            f = v.get(key, 0.5)
            out[k] = pytest.approx(f, abs=1e-12)
            v[key] = 0.05 + 0.8 * f + 0.25 * abs(x)
    return out


@pytest.mark.parametrize("layout", ["one", "shuffled", "reversed"])
def test_filters_do_not_depend_on_batches_or_arrival(spark, tmp_path, layout):
    """One batch, and rows that come up to nine minutes late over six batches, in any order within them."""
    rows = rows_of()
    files = [rows]
    if layout != "one":
        rng = random.Random(2)
        came = sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=rng.randrange(9)))
        files = [came[k : k + 15] for k in range(0, 90, 15)]
        files = [f[::-1] if layout == "reversed" else rng.sample(f, len(f)) for f in files]
    stream = written(spark, f"{tmp_path}/in", files, "k string, ts timestamp, id long, x double")
    got, _ = run(spark, ordered.filtered_quantile(stream, "k", "ts", "id", "x", "10 minutes"), tmp_path, ordered.PROVIDER)
    passed = max(r[1] for r in rows) - dt.timedelta(minutes=10)
    passed = passed.replace(microsecond=0)  # watermarks have milliseconds
    assert {r.id: r.forecast for r in got} == by_hand(rows, passed) and not any(r.late for r in got)


def test_rows_behind_the_watermark_get_no_forecast(spark, tmp_path):
    rows = rows_of(60)
    late = ("a", START, 999, 5.0)
    stream = written(spark, f"{tmp_path}/in", [rows[:40], rows[40:50], [*rows[50:], late]], "k string, ts timestamp, id long, x double")
    got, dropped = run(spark, ordered.filtered_quantile(stream, "k", "ts", "id", "x", "2 minutes"), tmp_path, ordered.PROVIDER)
    passed = (max(r[1] for r in rows) - dt.timedelta(minutes=2)).replace(microsecond=0)
    assert {r.id: r.forecast for r in got if not r.late} == by_hand(rows, passed)
    assert [(r.id, r.forecast) for r in got if r.late] == [(999, None)] or dropped == 1


def test_knowledge_joins_its_events_and_late_rows_are_counted(spark, tmp_path):
    minute = lambda k: START + dt.timedelta(minutes=k)
    events = [[(u, minute(10 * k + u), 10 * k + u) for k in range(6) for u in range(3)], [(0, minute(90), 90)], [(0, minute(1), 777), (1, minute(200), 200)]]
    knowledge = [[(0, minute(4), "x"), (0, minute(10), "y"), (1, minute(11), "z"), (2, minute(33), "w")], [(0, minute(95), "v")], [(1, minute(205), "u")]]
    a = written(spark, f"{tmp_path}/a", events, "user int, ts timestamp, id int")
    b = written(spark, f"{tmp_path}/b", knowledge, "user int, known timestamp, what string")
    got, dropped = run(spark, ordered.known_within(a, b, ["user"], "ts", "known", "5 minutes", "10 minutes"), tmp_path)
    found = {(r.id, r.what) for r in got}
    want = {(0, "x"), (10, "y"), (11, "z"), (32, "w"), (90, "v"), (200, "u")}
    alone = {(r[2], None) for f in events[:2] for r in f if r[2] not in {k for k, _ in want}}
    assert found == want | alone and len(got) == len(found)
    assert dropped == 1  # the row of the first minute, when the watermark stood an hour later


def test_windows_and_availability(spark, tmp_path):
    rows = [(k % 2, START + dt.timedelta(minutes=7 * k), START + dt.timedelta(minutes=7 * k + k % 5), float(k)) for k in range(40)]
    schema = "u int, ts timestamp, known timestamp, x double"
    stream = written(spark, f"{tmp_path}/in", [rows[:20], rows[20:]], schema)
    got, _ = run(spark, availability.available_only(stream, "ts", "known", 2, "1 hour"), f"{tmp_path}/1")
    assert sorted(r.x for r in got) == [r[3] for r in rows if int(r[3]) % 5 <= 2]
    sums, _ = run(spark, availability.sliding_sums(stream, ["u"], "ts", "x", "1 hour", "30 minutes", "10 minutes"), f"{tmp_path}/2")
    end = rows[-1][1] - dt.timedelta(minutes=10)
    want = {}
    for u, ts, _, x in rows:
        for back in (0, 1):
            first = START + dt.timedelta(minutes=30 * ((ts - START) // dt.timedelta(minutes=30) - back))
            if first + dt.timedelta(hours=1) <= end:
                want[u, first] = want.get((u, first), 0) + x
    assert {(r.u, r.w.start): r.total for r in sums} == want
    gaps = written(spark, f"{tmp_path}/gaps", [[(0, START, START, 1.0), (0, START + dt.timedelta(minutes=5), START, 1.0), (0, START + dt.timedelta(hours=2), START, 1.0), (1, START + dt.timedelta(hours=9), START, 1.0)]], schema)
    sessions, _ = run(spark, availability.session_clusters(gaps, ["u"], "ts", "30 minutes", "1 hour"), f"{tmp_path}/3")
    assert sorted((r.u, r.w.start, r.events) for r in sessions) == [(0, START, 2), (0, START + dt.timedelta(hours=2), 1)]


class Held:
    """The state of one key in memory."""

    def __init__(self):
        self.data, self.timers = {}, []

    def getValueState(self, *_):
        return self

    def getMapState(self, *_):
        return Held()

    getListState = getMapState
    exists = lambda self: "v" in self.data
    get = lambda self: self.data["v"]
    getValue = lambda self, k: self.data.get(k)
    removeKey = lambda self, k: self.data.pop(k)
    iterator = lambda self: iter(list(self.data.items()))
    listTimers = lambda self: iter(self.timers)

    def update(self, v):
        self.data["v"] = v

    def updateValue(self, k, v):
        self.data[k] = v

    def registerTimer(self, ms):
        self.timers.append(ms)


def test_waiting_rows_come_up_an_hour_at_a_time(monkeypatch):
    """A task never holds more of a key than the rows of one slot, and what it gives does not change."""
    import pandas as pd

    monkeypatch.setattr(ordered, "GATHERED", 50)
    rng = random.Random(3)
    us = [rng.randrange(40 * ordered.SLOT) for _ in range(400)]
    x = [rng.gauss(0, 2) for _ in us]
    at = lambda ms: type("Times", (), {"getCurrentWatermarkInMs": lambda self: ms})()
    state, f = Held(), ordered.OrderedFilter("k", (0.05, 0.8, 0.25), 0.5)
    f.init(state)
    frame = pd.DataFrame({"us": us, "id": range(400), "x": x})
    assert not list(f.handleInputRows(("a",), (frame[k : k + 20] for k in range(0, 400, 20)), at(-1)))
    end = 30 * ordered.SLOT // 1000 + 1_800_000
    out = [*f.handleExpiredTimer(("a",), at(end), None), *f.handleExpiredTimer(("a",), at(41 * ordered.SLOT // 1000), None)]
    assert len(out) > 30 and all(len(set(o.us // ordered.SLOT)) == 1 for o in out if len(o))
    got, v, want = pd.concat(out), 0.5, []
    for t, k in sorted(zip(us, range(400), strict=True)):
        want.append((t, k, v))
        v = 0.05 + 0.8 * v + 0.25 * abs(x[k])
    assert list(zip(got.us, got.id, got.forecast, strict=True)) == want
