"""Stateful filters in event order, and joins of event time with knowledge time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Where state of this kind is kept; set it before the query starts.
PROVIDER = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


#: Microseconds of event time whose waiting rows of a key lie together, and rows that a task gathers before it puts them there.
SLOT, GATHERED = 3_600_000_000, 200_000
ROW = [("us", "<i8"), ("id", "<i8"), ("x", "<f8")]


class OrderedFilter(StatefulProcessor):
    """v' = p0 + p1 v + p2 |x|, over the rows of a key in the order of (event time, id), whatever the order in which they come.

    Rows wait until the watermark has passed them; a timer at the earliest of them brings them up.  They wait by slots of an hour, so that a
    task holds the rows of one slot at a time, whatever a key has.  A row comes out with the forecast that was made before it.  Rows that come
    after the watermark has passed their time come out at once, without a forecast.
    """

    def __init__(self, key: str, p: tuple[float, float, float], start: float):
        self.key, self.p, self.start = key, p, start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.v = handle.getValueState("v", "v double")
        self.slots = handle.getMapState("slots", "slot long", "parts long, first long")
        self.parts = handle.getMapState("parts", "slot long, part long", "rows binary")

    def _out(self, key: tuple, rows: np.ndarray, forecast: list[float] | None):
        import pandas as pd

        v = pd.Series([None] * len(rows) if forecast is None else forecast, dtype="float64")
        return pd.DataFrame({self.key: [key[0]] * len(rows), "us": rows["us"], "id": rows["id"], "x": rows["x"], "forecast": v, "late": forecast is None})

    def _wait_for(self, first: int) -> None:
        self.handle.registerTimer(-(-first // 1000))

    def _put(self, gathered: list[np.ndarray]) -> None:
        rows = np.sort(np.concatenate(gathered), order=["us", "id"])
        slots, at = np.unique(rows["us"] // SLOT, return_index=True)
        for slot, some in zip(slots.tolist(), np.split(rows, at[1:]), strict=True):
            parts, first = self.slots.getValue((slot,)) or (0, int(some["us"][0]))
            self.parts.updateValue((slot, parts), (some.tobytes(),))
            self.slots.updateValue((slot,), (parts + 1, min(first, int(some["us"][0]))))
        first = int(rows["us"][0])
        if not any(t * 1000 <= first for t in self.handle.listTimers()):
            self._wait_for(first)

    def _take(self, slot: int, parts: int) -> np.ndarray:
        """The rows of a slot in order; they no longer wait."""
        rows = np.concatenate([np.frombuffer(self.parts.getValue((slot, k))[0], ROW) for k in range(parts)])
        for k in range(parts):
            self.parts.removeKey((slot, k))
        self.slots.removeKey((slot,))
        return np.sort(rows, order=["us", "id"])

    def handleInputRows(self, key: tuple, rows: Iterator, timerValues) -> Iterator:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = []
        for pdf in rows:
            pdf = pdf[pdf.us.notna()]
            new = np.empty(len(pdf), ROW)
            new["us"], new["id"], new["x"] = pdf.us.astype("int64"), pdf.id.astype("int64"), pdf.x
            late = new["us"] <= passed
            if late.any():
                yield self._out(key, np.sort(new[late], order=["us", "id"]), None)
            if not late.all():
                held.append(new[~late])
            if sum(map(len, held)) >= GATHERED:
                self._put(held)
                held = []
        if held:
            self._put(held)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        slots = sorted((k[0], v[0], v[1]) for k, v in self.slots.iterator())
        for slot, parts, first in slots:
            if first > passed:
                self._wait_for(first)  # the timer that has expired may still be listed
                break
            rows = self._take(slot, parts)
            due, rest = rows[rows["us"] <= passed], rows[rows["us"] > passed]
            v = self.v.get()[0] if self.v.exists() else self.start
            out = []
            for x in due["x"].tolist():
                out.append(v)
                v = self.p[0] + self.p[1] * v + self.p[2] * abs(x)
            self.v.update((v,))
            yield self._out(key, due, out)
            if len(rest):
                self.parts.updateValue((slot, 0), (rest.tobytes(),))
                self.slots.updateValue((slot,), (1, int(rest["us"][0])))
                self._wait_for(int(rest["us"][0]))
                break

    def close(self) -> None:
        pass


def filtered_quantile(stream: DataFrame, key: str, event: str, row_id: str, value: str, late: str, p: tuple[float, float, float] = (0.05, 0.8, 0.25), start: float = 0.5) -> DataFrame:
    """key, event time, id, value, forecast, late of each row, once the watermark (`late` behind the newest event) has passed it."""
    kind = dict(stream.dtypes)[key]
    rows = stream.withWatermark(event, late).select(key, event, F.unix_micros(F.col(event)).alias("us"), F.col(row_id).cast("long").alias("id"), F.col(value).cast("double").alias("x"))
    schema = f"`{key}` {kind}, us long, id long, x double, forecast double, late boolean"
    out = rows.groupBy(key).transformWithStateInPandas(OrderedFilter(key, p, start), schema, "append", "eventTime")
    return out.select(key, F.timestamp_micros("us").alias(event), F.col("id").alias(row_id), F.col("x").alias(value), "forecast", "late")


def known_within(events: DataFrame, knowledge: DataFrame, keys: list[str], event: str, known: str, within: str, late: str) -> DataFrame:
    """Each event with what became known of its keys from its time to `within` later; an event of which nothing did comes out once, with nulls,
    when the watermark shows that nothing can come any more.  Both streams are kept only as far back as that."""
    a = events.withWatermark(event, late)
    b = knowledge.withColumnsRenamed({k: f"__{k}" for k in keys}).withWatermark(known, late)
    same = None
    for k in keys:
        same = (F.col(k) == F.col(f"__{k}")) if same is None else same & (F.col(k) == F.col(f"__{k}"))
    return a.join(b, same & (F.col(known) >= F.col(event)) & (F.col(known) <= F.col(event) + F.expr(f"interval {within}")), "leftOuter").drop(*[f"__{k}" for k in keys])


def dropped_rows(query) -> int:
    """Rows that came too late for the state of a query, over its batches so far."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
