"""Mixing sources to target weights by Pfair scheduling.

The rows of a source form blocks.  With weight w, an exact fraction of the sum of all, its
j-th block of a phase has release time floor(j / w) and deadline ceil((j + 1) / w); each
time slot takes, among the released blocks, the one with the earliest deadline.  All
weights sum to one, so after any number of slots each source is less than one block away
from its target share.  When a source has no blocks left, a new phase begins with the
weights of the others scaled to sum to one; no row is dropped or repeated.

A schedule repeats after as many slots as the weights' common denominator.  The driver
works out one period for each phase, or the phase's own slots where they are fewer, and
at most one phase for each source; block numbers map to slots in closed form.  Weights
without a small common denominator cost it a step for each block.  Everything else is
distributed: rows are numbered inside their source however large it is.

Cases: a null source is a source of its own; null texts are rows like any others;
repeated rows take a place each; sources without a stated weight get the weight stated
for `rest`; sources of weight 0 come, evenly, when no other is left; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from fractions import Fraction
from heapq import heappop, heappush
from math import floor, gcd, lcm

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, numbered

BLOCK_ROWS = 16
#: Schedules up to this many rows are broadcast; longer ones are shuffled.
BROADCAST_TURNS = 100_000
#: Release and deadline slots that do not fit a long.
FAR = 1 << 61


def exact(weights: Mapping[str | None, float]) -> dict[str | None, int]:
    """Whole numbers in the proportion of the weights as they are stated in decimal; they add up to the period."""
    stated = {k: Fraction(str(w)) for k, w in weights.items()}
    if any(w < 0 for w in stated.values()):
        raise ValueError("weights must not be negative")
    if not any(stated.values()):
        return dict.fromkeys(stated, 1)
    whole = lcm(*[w.denominator for w in stated.values()])
    out = {k: int(w * whole) for k, w in stated.items()}
    common = gcd(*out.values())
    return {k: n // common for k, n in out.items()}


def shares(weights: Mapping[str | None, float], period: int) -> dict[str | None, int]:
    """Rounded weights: whole numbers of slots per period for each source, at least 1, by largest remainders."""
    period = max(period, len(weights))
    total = sum(map(Fraction, weights.values()))
    exact = {k: Fraction(v) / total * (period - len(weights)) for k, v in weights.items()}
    out = {k: 1 + floor(v) for k, v in exact.items()}
    rest = period - sum(out.values())
    for k in sorted(exact, key=lambda k: (floor(exact[k]) - exact[k], str(k)))[:rest]:
        out[k] += 1
    return out


def one_period(slots: Mapping[str | None, int], blocks: Mapping[str | None, int] | None = None) -> list[tuple[str | None, int, int, int]]:
    """(source, number in the period, release, deadline) for each slot of a period, earliest deadline first.

    With `blocks` it ends at the slot that takes the last block of any source.
    """
    period = sum(slots.values())
    waiting = [(0, str(k), k is None, k) for k, n in slots.items() if n]
    ready: list[tuple] = []
    taken = dict.fromkeys(slots, 0)
    out = []
    waiting.sort(key=lambda x: x[:3])
    for now in range(period):
        while waiting and waiting[0][0] <= now:
            _, name, null, source = heappop(waiting)
            heappush(ready, (-(-(taken[source] + 1) * period // slots[source]), name, null, source))
        deadline, name, null, source = heappop(ready)
        j, n = taken[source], slots[source]
        out.append((source, j, j * period // n, deadline))
        taken[source] = j + 1
        if blocks is not None and j + 1 == blocks[source]:
            break
        if j + 1 < n:
            heappush(waiting, ((j + 1) * period // n, name, null, source))
    return out


def plan(blocks: Mapping[str | None, int], weights: Mapping[str | None, float], period: int | None = None) -> tuple[list[dict], list[tuple]]:
    """(spans, turns) from the numbers of blocks: a span for each phase and source, a turn for each block of a period.

    Block b of a span's source, when first <= b < stop, has slot, release and deadline equal to
    start + (b - first) // per * period + those of the turn (source, phase, (b - first) % per, at,
    release, deadline).  With `period` the weights are first rounded to its parts.
    """
    left, done, start, phase, spans, turns = dict(blocks), dict.fromkeys(blocks, 0), 0, 0, [], []
    while left := {k: n for k, n in left.items() if n > 0}:
        wanted = {k: weights[k] for k in left}
        slots = {k: n for k, n in (shares(wanted, period) if period else exact(wanted)).items() if n}
        order = one_period(slots, left)
        size, stop = len(order), len(order)
        per = dict.fromkeys(slots, 0)
        where = {}
        for t, (source, j, _, _) in enumerate(order):
            where[source, j] = t
            per[source] += 1
        if size == sum(slots.values()):  # a whole period: the slot of each source's last block, if the phase went on until then
            stop = 1 + min((n - 1) // per[k] * size + where[k, (n - 1) % per[k]] for k, n in left.items() if k in slots)
        full, part = divmod(stop, size)
        used = {k: full * n for k, n in per.items()}
        for source, *_ in order[:part]:
            used[source] += 1
        spans += [{"source": k, "phase": phase, "per": per[k], "period": size, "start": start, "first": done[k], "stop": done[k] + used[k]} for k in slots if used[k]]
        turns += [(source, phase, j, t, min(release, FAR), min(deadline, FAR)) for t, (source, j, release, deadline) in enumerate(order)]
        for k, n in used.items():
            left[k] -= n
            done[k] += n
        start += stop
        phase += 1
    return spans, turns


def short_blocks(rows: Mapping[str | None, int], block_rows: int, spans: list[dict], turns: list[tuple]) -> list[tuple[int, int]]:
    """(slot, rows that it lacks) of the sources' last blocks that are not full."""
    ends = {k: -(-n // block_rows) for k, n in rows.items()}
    last = {s["source"]: s for s in spans if s["stop"] == ends[s["source"]]}
    keys = {(k, s["phase"], (ends[k] - 1 - s["first"]) % s["per"]): k for k, s in last.items()}
    out = []
    for source, phase, j, t, _, _ in turns:
        if (k := (source, phase, j)) in keys and (lack := ends[source] * block_rows - rows[source]):
            s = last[source]
            out.append((s["start"] + (ends[source] - 1 - s["first"]) // s["per"] * s["period"] + t, lack))
    return sorted(out)


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, rest: float = 1.0, block_rows: int = BLOCK_ROWS, period: int | None = None) -> DataFrame:
    """doc_id, source, source_row, block, phase, slot, release_slot, deadline_slot, position of each document.

    `position` is the row's place in the mixture, gapless from 0.  Sources, which have stated
    weights, are few; only their counts and the schedule come to the driver.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), F.crc32(F.coalesce("text", F.lit(""))).alias("tie"))
    ranked = materialise(numbered(narrow, "source", ["doc_id", "tie"], "source_row"), "ranked")
    rows = {r["source"]: r["n"] for r in ranked.groupBy("source").agg(F.count("*").alias("n")).toLocalIterator()}
    blocks = {k: -(-n // block_rows) for k, n in rows.items()}
    wanted = {k: (weights or {}).get(k, rest) for k in rows}
    phases, order = plan(blocks, wanted, period)
    # the last block of a source may be short; later slots start that much earlier
    total, cases = 0, F.lit(0)
    for slot, lack in short_blocks(rows, block_rows, phases, order):
        total += lack
        cases = F.when(F.col("slot") > slot, F.lit(total)).otherwise(cases)
    spans = spark.createDataFrame([tuple(s.values()) for s in phases], "p_source string, phase int, per long, period long, start long, first long, stop long")
    kinds = [("t_source", pa.string()), ("t_phase", pa.int32()), ("t_number", pa.int64()), ("at", pa.int64()), ("release", pa.int64()), ("deadline", pa.int64())]
    turns = spark.createDataFrame(pa.table({name: pa.array([t[k] for t in order], kind) for k, (name, kind) in enumerate(kinds)}))
    numbers = ranked.withColumn("block", F.floor(F.col("source_row") / block_rows).cast("long"))
    inside = F.col("source").eqNullSafe(F.col("p_source")) & (F.col("block") >= F.col("first")) & (F.col("block") < F.col("stop"))
    placed = numbers.join(F.broadcast(spans), inside).withColumns({"number": (F.col("block") - F.col("first")) % F.col("per"), "round": F.floor((F.col("block") - F.col("first")) / F.col("per"))})
    match = F.col("source").eqNullSafe(F.col("t_source")) & (F.col("phase") == F.col("t_phase")) & (F.col("number") == F.col("t_number"))
    joined = placed.join(F.broadcast(turns) if len(order) <= BROADCAST_TURNS else turns, match)
    at = F.col("start") + F.col("round") * F.col("period")
    out = joined.withColumns({"slot": (at + F.col("at")).cast("long"), "release_slot": (at + F.col("release")).cast("long"), "deadline_slot": (at + F.col("deadline")).cast("long")})
    out = out.withColumn("position", (F.col("slot") * block_rows + F.col("source_row") % block_rows - cases).cast("long"))
    return out.select("doc_id", "source", "source_row", "block", "phase", "slot", "release_slot", "deadline_slot", "position", "tie")


def arranged(docs: DataFrame, spots: DataFrame, added: list[str], rows_per_part: int = 5000) -> DataFrame:
    """The rows of `docs` in the order of `place`, with the columns `added`: part k of the result holds the k-th run
    of places, sorted.  `spots` has doc_id, tie, place (gapless from 0) and `added` of each row, as mix() gives them.
    Texts move twice, to meet their place and to go to their part."""
    nth = Window.partitionBy("__tm_id", "__tm_tie").orderBy("__tm_order")
    narrow = spots.select(F.col("doc_id").alias("__tm_id"), F.col("tie").alias("__tm_tie"), F.col("place").alias("__tm_place"), *[F.col(c).alias(f"__tm_add_{c}") for c in added], F.col("place").alias("__tm_order"))
    narrow = materialise(narrow.withColumn("__tm_nth", F.row_number().over(nth)).drop("__tm_order"), "spots")
    total = narrow.count()
    parts = max(1, -(-total // rows_per_part))
    rows = docs.withColumns({"__tm_id": F.col("doc_id"), "__tm_tie": F.crc32(F.coalesce("text", F.lit(""))), "__tm_order": F.lit(1)})
    rows = rows.withColumn("__tm_nth", F.row_number().over(nth)).drop("__tm_order")
    there = narrow.withColumnsRenamed({"__tm_id": "__tm_id2", "__tm_tie": "__tm_tie2", "__tm_nth": "__tm_nth2"})
    match = F.col("__tm_id").eqNullSafe(F.col("__tm_id2")) & (F.col("__tm_tie") == F.col("__tm_tie2")) & (F.col("__tm_nth") == F.col("__tm_nth2"))
    placed = rows.join(there, match)
    part = F.floor(F.col("__tm_place") * parts / F.lit(max(1, total))).cast("int")
    kept = [c for c in docs.columns if c not in added]
    return placed.repartitionById(parts, part).sortWithinPartitions("__tm_place").select(*kept, *[F.col(f"__tm_add_{c}").alias(c) for c in added])


def in_order(docs: DataFrame, weights: Mapping[str | None, float] | None = None, rest: float = 1.0, rows_per_part: int = 5000) -> DataFrame:
    """The rows of `docs`, all columns as they are, in the order of the mixture."""
    return arranged(docs, mix(docs, weights, rest).withColumnRenamed("position", "place"), [], rows_per_part)
