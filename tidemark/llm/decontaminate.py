"""Benchmark decontamination with one FM-index per training shard.

Each task gathers its documents into shards of about SHARD_BYTES of text.  The words
of a shard that occur in the benchmark are numbered; runs of them that are long enough
to hold a window form the shard's text, over which an FM-index is built: the
Burrows-Wheeler transform in a wavelet matrix for ranks, and suffix positions sampled
at every SAMPLE-th text position.  All benchmark windows are searched backwards at
once, their occurrences located through the samples, and the hit words merged into
removal spans.  No data moves between tasks.

Cases: null or empty text has no words; a null item text has no windows; null item
ids read as the string 'null'; repeated rows are kept as they are; empty tables give
no rows or no hits.  Columns other than the named ones are not looked at.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T

SHARD_BYTES = 4 << 20
SAMPLE = 16
#: Benchmark text in one broadcast; larger benchmarks become several, used one after the other.
BLOCK_BYTES = 8 << 20

SCHEMA = "doc_id long, n_words long, n_hit long, item_ids array<string>, spans array<struct<start:int,stop:int>>"
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("item_ids", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
    ]
)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of `s`, whose last symbol is a unique smallest one (prefix doubling)."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = s[order[1:]] != s[order[:-1]]
    head = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    step = 1
    while True:
        size_one = first & np.append(first[1:], True)
        open_rows = np.flatnonzero(~size_one)
        if not len(open_rows):
            return order
        at = order[open_rows]
        nxt = np.minimum(at + step, n - 1)
        group, second = rank[at], rank[nxt]
        by = np.argsort(group * n + second, kind="stable")
        order[open_rows] = at[by]
        group, second = group[by], second[by]
        new = np.empty(len(by), bool)
        new[0] = True
        new[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        first[open_rows] = new
        heads = np.maximum.accumulate(np.where(new, open_rows, 0))
        rank[order[open_rows]] = heads
        step *= 2


class WaveletMatrix:
    """Rank of any symbol below any position of a sequence, in one bit-vector rank per symbol bit."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        n = len(seq)
        for level in range(self.bits - 1, -1, -1):
            bit = ((seq >> level) & 1).astype(bool)
            padded = np.zeros((n + 64) // 64 * 64, bool)
            padded[:n] = bit
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            counts = np.zeros(len(packed) + 1, np.int64)
            np.cumsum(np.bitwise_count(packed), out=counts[1:])
            zeros = n - int(counts[-1])
            self.levels.append((packed, counts, zeros))
            seq = np.concatenate([seq[~bit], seq[bit]])
        symbols = np.arange(sigma)
        self.base = self._map(symbols, np.zeros(sigma, np.int64))

    def _map(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, (packed, counts, zeros) in enumerate(self.levels):
            word = i >> 6
            low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
            ones = counts[word] + np.bitwise_count(packed[np.minimum(word, len(packed) - 1)] & low)
            up = (symbol >> (self.bits - 1 - k)) & 1
            i = np.where(up == 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._map(symbol, i) - self.base[symbol]


class FMIndex:
    def __init__(self, s: np.ndarray, sigma: int, sample: int = SAMPLE):
        order = suffix_array(s)
        self.bwt = s[order - 1]
        self.wavelet = WaveletMatrix(self.bwt, sigma)
        counts = np.bincount(s, minlength=sigma)
        self.below = np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.n = len(s)
        self.position = np.where(order % sample == 0, order, -1)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals of the suffixes that start with each row of `patterns`."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, k]
            low[live] = self.below[c] + self.wavelet.rank(c, low[live])
            high[live] = self.below[c] + self.wavelet.rank(c, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back to the next sampled position and add the steps."""
        out = np.zeros(len(rows), np.int64)
        live, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(live):
            found = self.position[at]
            done = found >= 0
            out[live[done]] = found[done] + steps
            live, at = live[~done], at[~done]
            c = self.bwt[at]
            at = self.below[c] + self.wavelet.rank(c, at)
            steps += 1
        return out


class Windows:
    """The distinct windows of one block of benchmark items, by length, and the items of each."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        number: dict[int, int] = {}
        owners: dict[tuple[int, ...], set[int]] = defaultdict(set)
        self.ids = sorted({i for i, _ in items})
        place = {x: k for k, x in enumerate(self.ids)}
        for item, body in items:
            raw, offs = T.flatten(pa.array([body], pa.string()))
            hashes = T.word_hashes(raw, offs, T.ALNUM)[0].tolist()
            code = [number.setdefault(h, len(number)) + 2 for h in hashes]
            size = min(window, len(code))
            for k in range(len(code) - size + 1 if size else 0):
                owners[tuple(code[k : k + size])].add(place[item])
        vocabulary = np.array(list(number), np.uint64)
        by = np.argsort(vocabulary)
        self.vocabulary, self.codes, self.sigma = vocabulary[by], by + 2, len(number) + 2
        self.by_size = []
        for size in sorted({len(w) for w in owners}):
            rows = [w for w in owners if len(w) == size]
            self.by_size.append((size, np.array(rows, np.int64), [sorted(owners[w]) for w in rows]))
        self.shortest = self.by_size[0][0] if self.by_size else 0


class Shard:
    """Words of a shard's documents, as vocabulary codes with their document and place in it."""

    def __init__(self) -> None:
        self.ids: list = []
        self.n_words: list[np.ndarray] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = self.docs = 0

    def add(self, batch: pa.RecordBatch) -> None:
        raw, offs = T.flatten(batch.column(1))
        hashes, doc, starts, stops = T.word_hashes(raw, offs, T.ALNUM)
        first = T.segment_ids(doc, batch.num_rows)
        self.parts.append((hashes, doc + self.docs, np.arange(len(doc)) - first[doc], starts - offs[doc], stops - offs[doc]))
        self.ids.extend(batch.column(0).to_pylist())
        self.n_words.append(np.diff(first))
        self.docs += batch.num_rows
        self.size += len(raw)

    def hits(self, block: Windows) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list]:
        """Of all words: document and place columns, and which are hit; with (documents, items) found."""
        hashes, doc = self.hashes, self.doc
        slot = np.minimum(np.searchsorted(block.vocabulary, hashes), max(0, len(block.vocabulary) - 1))
        known = block.vocabulary[slot] == hashes if len(block.vocabulary) else np.zeros(len(hashes), bool)
        at = np.flatnonzero(known)
        hit = np.zeros(len(hashes) + 1, np.int64)
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        if not len(at) or not block.by_size:
            return hit[:-1] > 0, pairs
        starts_run = np.append(True, (np.diff(at) != 1) | (np.diff(doc[at]) != 0))
        run = np.cumsum(starts_run) - 1
        lengths = np.bincount(run)
        at, run = at[lengths[run] >= block.shortest], run[lengths[run] >= block.shortest]
        if not len(at):
            return hit[:-1] > 0, pairs
        new = np.append(False, np.diff(run) != 0)
        places = np.arange(len(at)) + np.cumsum(new)
        s = np.ones(places[-1] + 3, np.int64)
        s[places] = block.codes[slot[at]]
        s[-1] = 0
        word_of = np.full(len(s), -1, np.int64)
        word_of[places] = at
        index = FMIndex(s, block.sigma)
        for size, patterns, owners in block.by_size:
            low, high = index.search(patterns)
            n = high - low
            found = np.flatnonzero(n)
            if not len(found):
                continue
            which = np.repeat(found, n[found])
            rows = np.repeat(low[found], n[found]) + np.arange(len(which)) - np.repeat(np.cumsum(n[found]) - n[found], n[found])
            start = word_of[index.locate(rows)]
            np.add.at(hit, start, 1)
            np.add.at(hit, start + size, -1)
            couple = np.unique(np.stack([doc[start], which], 1), axis=0)
            n_items = np.array([len(owners[w]) for w in couple[:, 1]])
            pairs.append((np.repeat(couple[:, 0], n_items), np.concatenate([np.array(owners[w]) for w in couple[:, 1]])))
        return np.cumsum(hit[:-1]) > 0, pairs

    def result(self, blocks: list[Callable[[], Windows]]) -> pa.RecordBatch:
        self.hashes, self.doc, place, starts, stops = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts = []
        hit = np.zeros(len(self.hashes), bool)
        items: dict[int, set[str]] = defaultdict(set)
        for get in blocks:
            block = get()
            more, pairs = self.hits(block)
            hit |= more
            for docs, which in pairs:
                for d, w in zip(docs.tolist(), which.tolist(), strict=True):
                    items[d].add(block.ids[w])
        n_words = np.concatenate(self.n_words)
        at = np.flatnonzero(hit)
        n_hit = np.bincount(self.doc[at], minlength=self.docs)
        spans: dict[int, list] = defaultdict(list)
        if len(at):
            opens = np.append(True, (np.diff(at) != 1) | (np.diff(self.doc[at]) != 0))
            first, last = at[opens], at[np.append(opens[1:], True)]
            for d, a, b in zip(self.doc[first].tolist(), starts[first].tolist(), stops[last].tolist(), strict=True):
                spans[d].append({"start": a, "stop": b})
        rows = [self.ids, n_words, n_hit, [sorted(items.get(d, ())) for d in range(self.docs)], [spans.get(d, []) for d in range(self.docs)]]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, _ARROW, strict=True)], schema=_ARROW)


def benchmark_blocks(spark: SparkSession, bench: DataFrame, window: int, id_col: str, text_col: str, block_bytes: int) -> list:
    """Broadcast windows of the items, `block_bytes` of item text at a time; the driver holds one block."""
    blocks, items, size = [], [], 0
    rows = bench.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.coalesce(F.col(text_col), F.lit("")))
    for item, body in rows.toLocalIterator():
        items.append((item, body))
        size += len(body.encode())
        if size >= block_bytes:
            blocks.append(spark.sparkContext.broadcast(Windows(items, window)))
            items, size = [], 0
    if items or not blocks:
        blocks.append(spark.sparkContext.broadcast(Windows(items, window)))
    return blocks


def find_contamination(
    docs: DataFrame,
    bench: DataFrame,
    window: int = 10,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    shard_bytes: int = SHARD_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per document: words, words inside an occurrence of a benchmark window, the items (sorted as
    strings) and the merged spans to remove, as byte offsets into the UTF-8 text.

    A window is `window` consecutive words of an item, or all words of a shorter one.
    """
    spark = docs.sparkSession
    blocks = benchmark_blocks(spark, bench, window, item_id, item_text, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = [lambda b=b: b.value for b in blocks]
        shard = Shard()
        for batch in T.chunks(batches):
            shard.add(batch)
            if shard.size >= shard_bytes:
                yield shard.result(get)
                shard = Shard()
        if shard.docs:
            yield shard.result(get)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)


def excise(docs: DataFrame, bench: DataFrame, window: int = 10) -> DataFrame:
    """`docs` without the benchmark passages: removal spans are cut from the texts, again and again
    until no window is left, and documents of which no word is left go.

    `n_chars`, where there is such a column, follows the text.  Null and wordless texts stay.
    """
    spark = docs.sparkSession
    blocks = benchmark_blocks(spark, bench, window, "item_id", "text", BLOCK_BYTES)
    names = docs.columns
    at = names.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = [lambda b=b: b.value for b in blocks]

        def settle(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first = np.cumsum([0, *(p.num_rows for p in parts)])
            gone, texts = np.zeros(first[-1], bool), {}

            def text(i: int) -> str:
                k = int(np.searchsorted(first, i, "right")) - 1
                return texts[i] if i in texts else parts[k].column(at)[i - int(first[k])].as_py()

            shard = Shard()
            for k, p in enumerate(parts):
                shard.add(pa.RecordBatch.from_arrays([pa.array(np.arange(first[k], first[k + 1])), p.column(at)], ["doc_id", "text"]))
            while shard.docs:
                found, again = shard.result(get), []
                for i, n, h, spans in zip(*(found.column(c).to_pylist() for c in (0, 1, 2, 4)), strict=True):
                    if h:
                        gone[i] |= h == n
                        raw, pieces, last = text(i).encode(), [], 0
                        for span in spans:
                            pieces.append(raw[last : span["start"]])
                            last = span["stop"]
                        texts[i] = b"".join([*pieces, raw[last:]]).decode()
                        again.append(i)
                # removal may have brought further windows together
                shard = Shard()
                if again:
                    for batch in T.chunks([pa.RecordBatch.from_arrays([pa.array(again, pa.int64()), pa.array([texts[i] for i in again], pa.string())], ["doc_id", "text"])]):
                        shard.add(batch)
            for k, p in enumerate(parts):
                mine = [i for i in texts if first[k] <= i < first[k + 1]]
                if mine:
                    body = p.column(at).to_pylist()
                    for i in mine:
                        body[i - int(first[k])] = texts[i]
                    columns = [pa.array(body, c.type) if j == at else c for j, c in enumerate(p.columns)]
                    p = pa.RecordBatch.from_arrays(columns, schema=p.schema)
                yield p.filter(pa.array(~gone[first[k] : first[k + 1]]))

        held, size = [], 0
        for batch in T.chunks(batches, names[at]):
            held.append(batch)
            size += batch.nbytes
            if size >= SHARD_BYTES:
                yield from settle(held)
                held, size = [], 0
        if held:
            yield from settle(held)

    out = docs.mapInArrow(clean, docs.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out
