"""Removal of byte strings that repeat across documents, by external induced sorting.

A string of LENGTH bytes counts as a repeat if it also starts in a document with a smaller
id.  Sorting every suffix of a corpus is avoided by sampling: each window of LENGTH bytes
picks one GRAM-byte anchor inside it by content alone (mod-minimisers), so equal windows
pick equal anchors at equal offsets.  Anchors that only one text has are dropped; the
others carry suffix tuples (anchor, bytes to the right, bytes to the left, document,
place).  A task that has seen a tuple's bytes in a smaller document decides it at once, so
that a passage that very many documents share moves about one tuple for each task.  The others are sorted on disk by Spark's external sorter, which merges spilled runs
through a priority queue.  From the order of the suffixes at the anchors the order of the
suffixes one byte to the left is induced by the preceding byte, again and again, and with
it the common-prefix values; neighbours that share LENGTH bytes are equal windows.
An anchor with more tuples than fit in memory is induced through queues on disk.

Equal texts are resolved as wholes first.  Texts are moved twice: to meet their shared
anchors, and to meet their removal spans.

Cases: null text is empty; texts below LENGTH bytes lose nothing; rows with equal doc_id
never remove each other; rows with null doc_id neither lose bytes nor cost others any;
very long texts are used whole; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import pickle
import tempfile
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as T
from .shared import materialise, release

LENGTH = 50
GRAM = 32
STRIDE = LENGTH - GRAM + 1
SMALL = GRAM % STRIDE
SIDE = LENGTH - GRAM
#: Suffix tuples of one anchor that are induced in memory.
MEMORY_ROWS = 400_000
BATCH_ROWS = 200_000
#: Tuples whose bytes a task remembers while it reads texts.
SEEN_ROWS = 200_000
#: A bit for each window that holds an anchor.
ALL_SHIFTS = (1 << (SIDE + 1)) - 1
CHUNK_BYTES = 1 << 19


def _rolling(raw: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` bytes from each place."""
    n = len(raw)
    if n < size:
        return np.zeros(0, np.uint64)
    at = np.arange(n - size + 1)
    return T.span_hashes(raw, at, at + size)


def anchors(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, document and hash of the anchors of all windows that lie inside one document."""
    none = np.zeros(0, np.int64)
    small = _rolling(raw, SMALL)
    windows = len(raw) - LENGTH + 1
    if windows <= 0:
        return none, none, none.astype(np.uint64)
    width = LENGTH - SMALL + 1
    # the place of the least hash, the first of equal ones, in each window: of content alone
    low, first, span = small, np.arange(len(small), dtype=np.int32), 1
    while span * 2 <= width:
        later = low[span:] < low[:-span]
        low, first = np.where(later, low[span:], low[:-span]), np.where(later, first[span:], first[:-span])
        span *= 2
    more = width - span
    later = low[more : more + windows] < low[:windows]
    first = np.where(later, first[more : more + windows], first[:windows]).astype(np.int64)
    start = np.arange(windows)
    doc = np.searchsorted(offs, start, "right") - 1
    inside = start + LENGTH <= offs[doc + 1]
    place = np.unique((start + (first - start) % STRIDE)[inside])
    return place, np.searchsorted(offs, place, "right") - 1, _rolling(raw, GRAM)[place]


def text_class() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def second_class() -> Column:
    """Further 64 bits that name a text."""
    return F.xxhash64(F.lit(1), F.coalesce("text", F.lit("")))


def shared_anchors(docs: DataFrame) -> DataFrame:
    """(cls, gram) of the anchors that two different texts have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in T.chunks(batches, limit=CHUNK_BYTES):
            cls = np.array(batch.column(1).to_pylist(), np.int64)
            fresh = np.zeros(len(cls), bool)
            for k, c in enumerate(cls.tolist()):
                if c not in seen:
                    seen.add(c)
                    fresh[k] = True
            part = batch.column(0).filter(pa.array(fresh))
            _, doc, gram = anchors(*T.flatten(part))
            cls = cls[fresh]
            pair = np.unique(np.stack([doc.astype(np.uint64), gram], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 1].view(np.int64) if len(pair) else pair[:, 1].astype(np.int64)), pa.array(cls[pair[:, 0].astype(np.int64)])], ["gram", "cls"])

    rows = docs.filter("doc_id is not null").select("text", text_class().alias("cls")).mapInArrow(run, "gram long, cls long")
    group = Window.partitionBy("gram")
    found = rows.select("gram", "cls", F.min("cls").over(group).alias("lo"), F.max("cls").over(group).alias("hi"))
    return materialise(found.filter("lo < hi").select("cls", "gram"), "anchors")


def suffix_tuples(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, doc, place, left, right, mask): shared anchors with SIDE bytes to each side, fewer at the ends of a text.

    A tuple whose bytes the task has met in a smaller document is decided: its mask is set, and it has no sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in T.chunks(batches, limit=CHUNK_BYTES):
            raw, offs = T.flatten(batch.column(1))
            place, doc, gram = anchors(raw, offs)
            lists = batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            owner = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
            have = T.mix(lists.flatten().to_numpy().view(np.uint64) + owner * np.uint64(0x9E3779B97F4A7C15))
            keep = np.isin(T.mix(gram + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), have)
            place, doc, gram = place[keep], doc[keep], gram[keep]
            body = raw.tobytes()
            lo, hi = offs[doc], offs[doc + 1]
            begin, end = np.maximum(lo, place - SIDE), np.minimum(hi, place + LENGTH)
            whole = (end - begin == SIDE + LENGTH).tolist()
            ids = batch.column(0).take(pa.array(doc)).to_pylist()
            decided = np.zeros(len(place), bool)
            for k, (a, b) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
                if whole[k]:
                    least = seen.setdefault(body[a:b], ids[k])
                    if least < ids[k]:
                        decided[k] = True
                    elif least > ids[k]:
                        seen[body[a:b]] = ids[k]
            if len(seen) > SEEN_ROWS:  # what is forgotten is only decided later
                seen.clear()
            at = (place - lo).astype(np.int32)
            left = [None if d else body[a:b] for a, b, d in zip(begin.tolist(), place.tolist(), decided.tolist(), strict=True)]
            right = [None if d else body[a:b] for a, b, d in zip((place + GRAM).tolist(), end.tolist(), decided.tolist(), strict=True)]
            # decided tuples go anywhere
            key = np.where(decided, T.mix(gram + at.astype(np.uint64) + doc.astype(np.uint64)), gram)
            mask = pa.array(np.full(len(at), ALL_SHIFTS, np.int32), mask=~decided)
            columns = [pa.array(key.view(np.int64)), pa.array(ids, pa.int64()), pa.array(at), pa.array(left, pa.binary()), pa.array(right, pa.binary()), mask]
            yield pa.RecordBatch.from_arrays(columns, ["gram", "doc", "place", "left", "right", "mask"])

    texts = docs.select("doc_id", text_class().alias("cls"), F.coalesce("text", F.lit("")).alias("text"))
    met = texts.join(wanted, ["doc_id", "cls"]).select("doc_id", "text", "grams")
    return met.mapInArrow(run, "gram long, doc long, place int, left binary, right binary, mask int")


class DiskQueue:
    """A priority queue of tuples: sorted runs on local disk, merged as they are read; removed when closed."""

    def __init__(self, limit: int = MEMORY_ROWS):
        self.limit, self.held, self.runs = limit, [], []

    def push(self, item: tuple) -> None:
        self.held.append(item)
        if len(self.held) >= self.limit:
            self.held.sort()
            run = tempfile.TemporaryFile()
            for k in range(0, len(self.held), 1000):
                pickle.dump(self.held[k : k + 1000], run)
            run.seek(0)
            self.runs.append(run)
            self.held = []

    def __iter__(self) -> Iterator[tuple]:
        def read(run) -> Iterator[tuple]:
            while True:
                try:
                    yield from pickle.load(run)
                except EOFError:
                    return

        self.held.sort()
        return heapq.merge(*map(read, self.runs), self.held)

    def close(self) -> None:
        for run in self.runs:
            run.close()
        self.runs, self.held = [], []


def induce(doc: np.ndarray, left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For suffix tuples of several anchors, a bit for each shift o: the window that starts o bytes before
    the anchor also starts in a document with a smaller id.

    `left` holds the preceding bytes from the nearest on, `right` the following ones.
    """
    n = len(doc)
    mask = np.zeros(n, np.int64)
    order = np.lexsort([doc, *[right[:, k] for k in range(SIDE - 1, -1, -1)], group])
    # common prefix of neighbours beyond the anchor, -1 across anchors
    same = right[order[1:]] == right[order[:-1]]
    prefix = np.where(same.all(1), SIDE, np.argmin(same, 1))
    prefix = np.append(-1, np.where(group[order[1:]] == group[order[:-1]], prefix, -1)).astype(np.int64)
    for shift in range(SIDE + 1):
        if shift:
            byte = left[order, shift - 1]
            by = np.lexsort((byte, group[order]))
            # the common prefix with the neighbour in the new order is one more than the least
            # value between the two in the old order; a sparse table answers range minima
            new = order[by]
            lo, hi = by[:-1] + 1, by[1:]
            value = np.where((byte[by[1:]] == byte[by[:-1]]) & (group[new[1:]] == group[new[:-1]]), _range_min(prefix, lo, hi) + 1, -1)
            order, prefix = new, np.append(-1, value)
            prefix[1:][group[order[1:]] != group[order[:-1]]] = -1
        fits = (n_left >= shift) & (n_right >= SIDE - shift)
        equal = prefix >= SIDE
        equal[0] = False
        run = np.cumsum(~equal) - 1
        usable = fits[order]
        least = np.full(run[-1] + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, run[usable], doc[order][usable])
        hit = usable & (doc[order] > least[run])
        mask[order[hit]] |= 1 << shift
    return mask


def _range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of values[lo..hi] (inclusive) where lo <= hi, else -1."""
    out = np.full(len(lo), -1, np.int64)
    ok = np.flatnonzero(lo <= hi)
    if not len(ok):
        return out
    size = hi[ok] - lo[ok] + 1
    level = np.frexp(size.astype(np.float64))[1] - 1
    table, k = values, 0
    for k in range(int(level.max()) + 1):
        mine = level == k
        at = ok[mine]
        out[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << k) + 1])
        if k < int(level.max()):
            table = np.minimum(table[: -(1 << k)], table[1 << k :])
    return out


def induce_on_disk(rows: Iterable[tuple[int, int, bytes, bytes]]) -> Iterator[tuple[int, int, int]]:
    """The same for one anchor with any number of tuples (doc, place, left, right); yields (doc, place, bits).

    Each round pops the suffixes of one shift in order, marks equal windows, and pushes them with one more
    preceding byte for the next round.
    """
    queue = DiskQueue()
    for doc, place, left, right in rows:
        queue.push((b"", right, doc, place, left))
    for shift in range(SIDE + 1):
        after = DiskQueue()
        for _, same in groupby(queue, key=lambda t: (t[0], t[1][: SIDE - shift])):
            least = None
            for head, right, doc, place, left in same:
                if len(right) >= SIDE - shift:
                    # inside a run of equal windows longer right sides mix the order of documents
                    least = doc if least is None else min(least, doc)
                if shift < SIDE and len(left) > shift:
                    after.push((left[len(left) - shift - 1 :], right[: SIDE - shift - 1], doc, place, left))
                if len(right) >= SIDE - shift and doc > least:
                    yield doc, place, 1 << shift
        queue.close()
        queue = after
    queue.close()


def repeats(tuples: DataFrame) -> DataFrame:
    """(doc, place, mask) of the suffix tuples with a window that is a repeat."""

    def rows_of(doc: np.ndarray, place: np.ndarray, mask: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc.astype(np.int64)), pa.array(place.astype(np.int32)), pa.array(mask.astype(np.int32))], ["doc", "place", "mask"])

    def padded(values: pa.Array, reverse: bool) -> tuple[np.ndarray, np.ndarray]:
        raw, offs = np.frombuffer(values.buffers()[2] or b"", np.uint8), np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
        size = np.diff(offs)
        out = np.zeros((len(values), SIDE), np.uint8)
        row = np.repeat(np.arange(len(values)), size)
        k = np.arange(offs[0], offs[-1]) - np.repeat(offs[:-1], size)
        out[row, np.repeat(size, size) - 1 - k if reverse else k] = raw[offs[0] : offs[-1]]
        return out, size

    def whole(part: pa.Table) -> pa.RecordBatch:
        table = part.combine_chunks()
        column = lambda k: table.column(k).chunk(0) if table.column(k).num_chunks else pa.array([], table.schema.field(k).type)
        gram, doc = column(0).to_numpy(), column(1).to_numpy()
        left, n_left = padded(column(3), True)
        right, n_right = padded(column(4), False)
        group = np.cumsum(np.append(0, gram[1:] != gram[:-1]))
        mask = induce(doc, left, right, n_left, n_right, group)
        return rows_of(doc[mask > 0], column(2).to_numpy()[mask > 0], mask[mask > 0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        done_before: list[pa.RecordBatch] = []

        def undecided() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                known = batch.column(5).is_valid()
                if known.true_count:
                    some = batch.filter(known)
                    done_before.append(pa.RecordBatch.from_arrays([some.column(k) for k in (1, 2, 5)], ["doc", "place", "mask"]))
                    batch = batch.filter(pc.invert(known))
                yield batch

        stream = undecided()
        for batch in stream:
            yield from done_before
            done_before.clear()
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < BATCH_ROWS:
                continue
            table = pa.Table.from_batches(held)
            gram = table.column(0).to_numpy()
            cut = int(np.searchsorted(np.cumsum(gram[::-1] != gram[-1]), 1))  # rows of the last anchor
            done = rows - cut
            if done:
                yield whole(table.slice(0, done))
                held, rows = table.slice(done).to_batches(), cut
            if rows >= MEMORY_ROWS:
                last = int(gram[-1])
                rest: list[pa.RecordBatch] = []

                def one_anchor(first=held, last=last, rest=rest) -> Iterator[tuple]:
                    for b in first:
                        yield from zip(*[b.column(k).to_pylist() for k in range(1, 5)], strict=True)
                    for b in stream:
                        n = int((b.column(0).to_numpy() == last).sum())
                        yield from zip(*[b.column(k).slice(0, n).to_pylist() for k in range(1, 5)], strict=True)
                        if n < b.num_rows:
                            rest.append(b.slice(n))
                            return

                out: list[tuple] = []
                for item in induce_on_disk(one_anchor()):
                    out.append(item)
                    if len(out) >= BATCH_ROWS:
                        yield _batch(out)
                        out = []
                if out:
                    yield _batch(out)
                held, rows = rest, sum(b.num_rows for b in rest)
            yield from done_before
            done_before.clear()
        if rows:
            yield whole(pa.Table.from_batches(held))

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        return rows_of(*map(np.array, zip(*out, strict=True)))

    spark = tuples.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return tuples.repartition(parts, "gram").sortWithinPartitions("gram").mapInArrow(run, "doc long, place int, mask int")


def removal_marks(docs: DataFrame) -> DataFrame:
    """(doc_id, cls, more, whole, places): texts to remove as wholes, and places with bits of repeated windows."""
    spark = docs.sparkSession
    named = docs.filter("doc_id is not null").select("doc_id", text_class().alias("cls"), second_class().alias("more"), F.octet_length(F.coalesce("text", F.lit(""))).alias("n"))
    firsts = materialise(named.groupBy("cls", "more", "n").agg(F.min("doc_id").alias("first")), "firsts")
    shared = shared_anchors(docs)
    release(spark)
    wanted = shared.join(firsts.select("cls", F.col("first").alias("doc_id")), "cls").groupBy("doc_id", "cls").agg(F.collect_list("gram").alias("grams"))
    found = materialise(repeats(suffix_tuples(docs, wanted)), "repeats")
    release(spark)
    # a text's places are as many as its length allows
    by_doc = found.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("place", "mask")).alias("places"))
    inner = firsts.select(F.col("first").alias("doc_id"), "cls", "more").join(by_doc, "doc_id").select("doc_id", "cls", "more", F.lit(False).alias("whole"), "places")
    copies = named.filter(F.col("n") >= LENGTH).join(firsts, ["cls", "more", "n"]).filter("doc_id > first").select("doc_id", "cls", "more", F.lit(True).alias("whole"), F.lit(None).cast("array<struct<place:int,mask:int>>").alias("places")).distinct()
    return materialise(inner.unionByName(copies), "marks")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) and spans (start, stop in bytes)."""
    marks = removal_marks(docs)
    release(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.chunks(batches):
            raw, offs = T.flatten(batch.column(1))
            body = raw.tobytes()
            whole = batch.column(2).to_pylist()
            n_bytes, n_removed, n_spans, kept, spans = [], [], [], [], []
            for d in range(batch.num_rows):
                text = body[offs[d] : offs[d + 1]]
                pieces = []
                if whole[d]:
                    pieces = [(0, len(text))]
                elif whole[d] is False:
                    items = batch.column(3)[d].values.flatten()
                    place, mask = items[0].to_numpy().astype(np.int64), items[1].to_numpy()
                    starts = np.unique(np.concatenate([place[(mask >> s) & 1 == 1] - s for s in range(SIDE + 1)]))
                    new = np.append(True, starts[1:] > starts[:-1] + LENGTH)
                    ends = starts[np.append(new[1:], True)] + LENGTH
                    pieces = list(zip(starts[new].tolist(), ends.tolist(), strict=True))
                rest, at = [], 0
                for a, b in pieces:
                    rest.append(text[at:a])
                    at = b
                rest.append(text[at:])
                kept.append(b"".join(rest))
                n_bytes.append(len(text))
                n_removed.append(sum(b - a for a, b in pieces))
                n_spans.append(len(pieces))
                spans.append([{"start": a, "stop": b} for a, b in pieces])
            arrays = [batch.column(0), *[pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)], pa.array(kept, pa.binary()), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_class().alias("cls"), second_class().alias("more"), F.coalesce("text", F.lit("")).alias("text"))
    met = texts.join(marks, ["doc_id", "cls", "more"], "left").select("doc_id", "text", "whole", "places")
    return met.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:int,stop:int>>")
