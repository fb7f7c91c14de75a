"""Removal of repeated word windows, with a count-min prefilter.

A window is SIZE consecutive words of one document; a word goes if a window over it has the
same words as a window that starts anywhere else, in the same document or another.

Three passes.  (1) Each task sketches its windows, the tasks' sketches are added up to one
count-min sketch.  A window is counted through its anchor, the GRAM consecutive words in it
with the least hash: equal windows have equal anchors at equal offsets, and neighbouring
windows mostly share theirs, so a sketch holds about a tenth as many entries as there are
windows.  The estimate for the anchor is never below the count of the window.  (2) Only
windows estimated as repeated are grouped, exactly: by 64 bits of the anchor and 64 bits of
all words.  (3) Each text meets the marks of its repeated windows and loses the words they
cover.

The sketch has a fixed size (ROWS x CELLS counters, 2 bits each once they are merged), so
what is broadcast does not grow with the input.  Beyond some 10^8 windows more of them
pass to the second pass than need to; none is lost, and `cells` can be raised.  An anchor
that occurs very often (HOT, and more where the sketch is full) is not grouped as a whole:
each of its windows goes by its own hash, and a task sends no more than two places of a
window; later ones are decided where they are.

Cases: null and blank texts have no words; texts of fewer than SIZE words lose nothing;
texts that occur more than once lose everything from SIZE words up; repeated rows, rows with
equal or null doc_id are documents of their own; very long texts are used whole; further
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .shared import materialise, release

SIZE = 35
GRAM = 18
ROWS = 2
#: Counters in each row of the sketch, a power of two.
CELLS = 1 << 26
#: Counters in one part of the sketch, which is merged by one task.
PART = 1 << 20
#: Anchors that a task gathers before it passes its counts on.
FLUSH = 1 << 20
#: An anchor with so many occurrences, and HOT_LOAD times the mean of all cells, is dealt by its windows.
HOT = 64
HOT_LOAD = 8
#: A task adds at most so much to one counter; it is above HOT, so that merged counts tell hot anchors apart.
MOST = 200
#: Hot windows that a task remembers.
SEEN = 300_000

_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def sequences(hashes: np.ndarray, size: int, which: int) -> np.ndarray:
    """A hash of the `size` words from each place."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * T.powers(_BASES[which], n), out=total[1:])
    return T.mix((total[size:] - total[:-size]) * T.powers(_INVERSES[which], n)[: n - size + 1])


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of `width` values from each place, the first of equal ones."""
    low, first, span = values, np.arange(len(values)), 1
    while span * 2 <= width:
        later = low[span:] < low[:-span]
        low, first = np.where(later, low[span:], low[:-span]), np.where(later, first[span:], first[:-span])
        span *= 2
    if width > span:
        more, n = width - span, len(values) - width + 1
        later = low[more : more + n] < low[:n]
        first = np.where(later, first[more : more + n], first[:n])
    return first


def anchored(raw: np.ndarray, offs: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each window inside a document: its document, its first word (from 0 in that document), the word at
    which its anchor begins (in all words), the anchor's hash and the window's hash."""
    starts, stops, doc = T.words(raw, offs, T.NONSPACE)
    none = np.zeros(0, np.int64)
    if len(starts) < size:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    words = T.span_hashes(raw, starts, stops)
    grams = sequences(words, gram, 0)
    anchor = least_of(grams, size - gram + 1)
    at = np.flatnonzero(doc[: len(doc) - size + 1] == doc[size - 1 :])
    first = np.searchsorted(doc, np.arange(len(offs)))
    return doc[at], at - first[doc[at]], anchor[at], grams[anchor[at]], sequences(words, size, 1)[at]


def cells_of(grams: np.ndarray, cells: int) -> list[np.ndarray]:
    """The counter of each anchor in each row of the sketch."""
    bits = np.uint64(64 - (cells.bit_length() - 1))
    return [(g >> bits).astype(np.int64) + k * cells for k, g in enumerate((grams, T.mix(grams * _SPREAD)))]


def sketch(docs: DataFrame, size: int, gram: int, cells: int) -> np.ndarray:
    """Two bits for each counter: 0 seen once at most, 1 seen more often, 3 very often; four counters in a byte.

    Tasks pass on the numbers of the counters they raise, sorted, two bytes each; each part of the sketch is added up by one task.
    """
    part, parts = min(PART, cells), ROWS * cells // min(PART, cells)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def passed() -> pa.RecordBatch:
            hit = np.sort(np.concatenate([c for g in held for c in cells_of(g, cells)]))
            hit = hit[np.append(np.ones(MOST, bool)[: len(hit)], hit[MOST:] != hit[:-MOST])]
            edges = np.searchsorted(hit, np.arange(0, ROWS * cells + 1, min(part, 1 << 16)))
            low = (hit & 0xFFFF).astype(np.uint16)
            each = max(1, part >> 16)
            rows = [(k, edges[k * each], edges[(k + 1) * each]) for k in range(parts) if edges[k * each] < edges[(k + 1) * each]]
            heads = [np.diff(edges[k * each : (k + 1) * each + 1]).astype(np.uint32).tobytes() for k, _, _ in rows]
            body = [low[a:b].tobytes() for _, a, b in rows]
            return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in rows], pa.int32()), pa.array(heads, pa.binary()), pa.array(body, pa.binary())], ["part", "head", "body"])

        for batch in T.chunks(batches):
            _, _, place, grams, _ = anchored(*T.flatten(batch.column(0)), size, gram)
            if len(place):
                held.append(grams[np.append(True, place[1:] != place[:-1])])
                n += len(held[-1])
            if n >= FLUSH:
                yield passed()
                held, n = [], 0
        if n:
            yield passed()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, head, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                edges = np.frombuffer(head, np.uint32)
                at = np.frombuffer(body, np.uint16).astype(np.int64) + np.repeat(np.arange(len(edges)) << 16, edges)
                total = sums.setdefault(k, np.zeros(part, np.int32))
                np.minimum(total + np.bincount(at, minlength=part), 1 << 30, out=total, casting="unsafe")
        for k, total in sums.items():
            hot = total >= HOT + HOT_LOAD * total.mean()
            kind = ((total >= 2).astype(np.uint8) + 2 * hot.astype(np.uint8)).reshape(-1, 4)
            packed = kind[:, 0] | kind[:, 1] << 2 | kind[:, 2] << 4 | kind[:, 3] << 6
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([packed.tobytes()], pa.binary())], ["part", "bits"])

    raised = docs.select("text").mapInArrow(count, "part int, head binary, body binary")
    out = np.zeros(ROWS * cells // 4, np.uint8)
    for row in raised.repartition("part").mapInArrow(merge, "part int, bits binary").toLocalIterator():  # a fixed size in all
        out[row["part"] * part // 4 : (row["part"] + 1) * part // 4] = np.frombuffer(row["bits"], np.uint8)
    return out


def estimates(bits: np.ndarray, grams: np.ndarray, cells: int) -> np.ndarray:
    """0: not repeated for sure; 1: maybe; 3: maybe very often."""
    low = None
    for at in cells_of(grams, cells):
        kind = bits[at >> 2] >> ((at & 3) << 1).astype(np.uint8) & 3
        low = kind if low is None else low & kind
    return low


def _bits(groups: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row of each group of equal neighbours, and the bits of its rows together."""
    first = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
    return first, np.bitwise_or.reduceat(np.left_shift(np.int64(1), bit), first)


def candidates(docs: DataFrame, bits: np.ndarray, size: int, gram: int, cells: int) -> DataFrame:
    """(key, c1, c2, lo, mask, vals): places of windows that may be repeated.

    An anchor's windows in a text are one row, with the first of them in `lo` and a hash of each in `vals`; windows of
    hot anchors are rows of their own.  Places that are decided already have their bits in `mask` and no `vals`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    span = size - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        texts: set[tuple[int, int]] = set()
        seen: dict[int, int] = {}

        def batch_of(key, owner, lo, mask, vals, counts) -> pa.RecordBatch:
            offs = np.append(0, np.cumsum(counts * 8)).astype(np.int32)
            body = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(np.ascontiguousarray(vals).tobytes())])
            ints = [np.ascontiguousarray(x).view(np.int64) for x in (key, c1[owner], c2[owner])]
            return pa.RecordBatch.from_arrays([*map(pa.array, ints), pa.array(lo.astype(np.int32)), pa.array(mask.astype(np.int32)), body], ["key", "c1", "c2", "lo", "mask", "vals"])

        for batch in T.chunks(batches):
            c1, c2 = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            fresh = np.zeros(batch.num_rows, bool)
            for k, pair in enumerate(zip(c1.tolist(), c2.tolist(), strict=True)):
                if pair not in texts:
                    texts.add(pair)
                    fresh[k] = True
            c1, c2 = c1[fresh], c2[fresh]
            doc, word, place, grams, whole = anchored(*T.flatten(batch.column(0).filter(pa.array(fresh))), size, gram)
            if not len(doc):
                continue
            kind = estimates(bits, grams, cells)
            cold = kind == 1
            if cold.any():
                d, w, p, g, v = (x[cold] for x in (doc, word, place, grams, whole))
                first = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (w[1:] != w[:-1] + 1)))
                counts = np.diff(np.append(first, len(p)))
                yield batch_of(g[first], d[first], w[first], np.zeros(len(first), np.int64), v, counts)
            if (hot := kind == 3).any():
                d, w, g, v = (x[hot] for x in (doc, word, grams, whole))
                order = np.argsort(v, kind="stable")
                first = np.flatnonzero(np.append(True, v[order][1:] != v[order][:-1]))
                counts = np.diff(np.append(first, len(v)))
                before = np.array([seen.get(x, 0) for x in v[order][first].tolist()], np.int64)
                for x, n in zip(v[order][first].tolist(), (before + counts).tolist(), strict=True):
                    if x in seen or len(seen) < SEEN:
                        seen[x] = min(n, 2)
                rank = np.empty(len(v), np.int64)
                rank[order] = np.arange(len(v)) - np.repeat(first, counts) + np.repeat(before, counts)
                send = rank < 2
                n = int(send.sum())
                yield batch_of(v[send], d[send], w[send], np.zeros(n, np.int64), g[send], np.ones(n, np.int64))
                d, w = d[~send], w[~send]
                if len(d):
                    lo = w // span * span
                    first, mask = _bits(d << 40 | lo, w - lo)
                    key = T.mix(c1[d[first]].view(np.uint64) + lo[first].astype(np.uint64))
                    yield batch_of(key, d[first], lo[first], mask, np.zeros(0, np.uint64), np.zeros(len(first), np.int64))

    return docs.select("text", _first(), _second()).mapInArrow(run, "key long, c1 long, c2 long, lo int, mask int, vals binary")


def _first() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("c1")


def _second() -> Column:
    """Further 64 bits that name a text."""
    return F.xxhash64(F.lit(1), F.coalesce("text", F.lit(""))).alias("c2")


def repeated(places: DataFrame) -> DataFrame:
    """(c1, c2, code): exactly the windows whose words start at two places or more; code is the first word << 20 | one bit for
    each window from there on."""

    def decide(table: pa.Table) -> pa.RecordBatch:
        key, lo, mask = (table.column(k).to_numpy() for k in ("key", "lo", "mask"))
        column = table.column("vals").combine_chunks()
        raw, offs = T.flatten(column)
        val, counts = raw.view(np.uint64), np.diff(offs) // 8
        row = np.repeat(np.arange(len(key)), counts)
        bit = np.arange(len(val)) - np.repeat(offs[:-1] // 8, counts)
        order = np.lexsort((val, key[row]))
        k, v = key[row][order], val[order]
        same = (k[1:] == k[:-1]) & (v[1:] == v[:-1])
        more = np.zeros(len(v), bool)
        more[order] = np.append(same, False)[: len(v)] | np.append(False, same)[: len(v)]
        mask = mask.astype(np.int64)
        if more.any():
            first, found = _bits(row[more], bit[more])
            mask[row[more][first]] |= found
        keep = mask > 0
        code = (lo.astype(np.int64) << 20 | mask)[keep]
        return pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks().filter(pa.array(keep)) for c in ("c1", "c2")), pa.array(code)], ["c1", "c2", "code"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rest.append(batch)
            held += batch.num_rows
            keys = batch.column(0).to_numpy()
            if held >= 20_000 and keys[0] != keys[-1]:
                cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1
                rest[-1] = batch.slice(0, cut)
                yield decide(pa.Table.from_batches(rest))
                rest, held = [batch.slice(cut)], batch.num_rows - cut
        if rest:
            yield decide(pa.Table.from_batches(rest))
        T.give_back()

    dealt = places.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "c1 long, c2 long, code long").distinct()


def marks(docs: DataFrame, size: int = SIZE, gram: int = GRAM, cells: int = CELLS) -> DataFrame:
    """(c1, c2, copies, codes): texts with repeated windows, and texts that occur more than once."""
    found = repeated(candidates(docs, sketch(docs, size, gram, cells), size, gram, cells))
    codes = found.groupBy("c1", "c2").agg(F.collect_list("code").alias("codes"))  # bounded by the text's length
    copies = docs.groupBy(_first(), _second()).agg(F.count("*").alias("copies")).filter("copies > 1")
    both = copies.join(codes, ["c1", "c2"], "full_outer").select("c1", "c2", F.coalesce("copies", F.lit(1)).alias("copies"), "codes")
    return materialise(both, "marks")


def remove_windows(docs: DataFrame, size: int = SIZE, gram: int | None = None, cells: int = CELLS) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the remaining words joined by one space) of each document."""
    gram = gram or (size + 1) // 2
    if not 1 <= gram <= size or size - gram > 19:
        raise ValueError("an anchor has 1 to `size` words, and at most 19 fewer than a window")
    docs = docs.select("doc_id", "text")
    marked = marks(docs, size, gram, cells)
    release(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.chunks(batches):
            raw, offs = T.flatten(batch.column(1))
            starts, stops, doc = T.words(raw, offs, T.NONSPACE)
            first = T.segment_ids(doc, batch.num_rows)
            cover = np.zeros(len(starts) + 1, np.int64)
            copies = batch.column(2).fill_null(1).to_numpy(zero_copy_only=False)
            lists = batch.column(3)
            codes = lists.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            for k in range(size - gram + 1):
                chosen = codes >> k & 1 == 1
                at = np.unique(first[owner[chosen]] + (codes[chosen] >> 20) + k)
                cover[at] += 1
                cover[at + size] -= 1
            n_words = np.diff(first)
            whole = np.flatnonzero((copies > 1) & (n_words >= size))
            np.add.at(cover, first[whole], 1)
            np.add.at(cover, first[whole + 1], -1)
            gone = np.cumsum(cover[:-1]) > 0
            removed = np.append(0, np.cumsum(gone))[first]
            keep = np.flatnonzero(~gone)
            last = np.append(doc[keep][1:] != doc[keep][:-1], True)[: len(keep)]
            stay = np.zeros(len(raw) + 1, np.int8)
            stop = stops[keep] + ~last  # the white space after a word stays as its separator
            stay[starts[keep]] += 1
            np.subtract.at(stay, stop, 1)
            inside = np.cumsum(stay[:-1]) > 0
            body = raw.copy()
            body[stops[keep][~last]] = 32
            kept_offs = np.append(0, np.cumsum(inside))[offs].astype(np.int32)
            kept = pa.Array.from_buffers(pa.string(), batch.num_rows, [None, pa.py_buffer(kept_offs.tobytes()), pa.py_buffer(body[inside].tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(np.diff(removed)), kept], ["doc_id", "n_words", "n_removed", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.withColumns({"c1": _first(), "c2": _second()})
    met = texts.join(marked, ["c1", "c2"], "left").select("doc_id", "text", "copies", "codes")
    return met.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept string")
