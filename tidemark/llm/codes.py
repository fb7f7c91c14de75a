"""Product codes of vectors, with segment-mean lower bounds in place of a full search.

Components become integers (floor of SCALE times the value); a vector is cut into PARTS equal
parts, each with a codebook of ENTRIES entries that ROUNDS rounds of assignment and mean
update refine.  The nearest entry of a part is found from coarse to fine: the part and the
entries are cut into blocks (one, then two, four, ...), and

    |x - c|^2  >=  sum over blocks of  n (mean x - mean c)^2 + (|rest x| - |rest c|)^2

where a rest is what is left of a block without its mean.  An entry whose bound lies above
the exact distance to the entry that looked best stays out; bounds are lowered by more than
their rounding error, so none is left out wrongly.  Survivors get exact integer distances.

Each round is one pass over the table and one aggregation whose result has PARTS * ENTRIES
rows, whatever the table's size; codebooks are all that the driver holds.

Cases: rows whose vector is null, or has null or non-finite components, are dropped, and so
are rows of another length than that of the first kept vec_id; a length that PARTS does not
divide, and components beyond 2^15, raise ValueError, as 64-bit sums would not hold them; rows
with equal vec_id are vectors of their own (the first ones are ordered by vec_id, nulls last, then by vector);
with fewer than ENTRIES rows the codebooks are smaller; null labels are a label of their
own; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .shared import materialise

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Rows that are compared at once.
BLOCK = 4096
LIMIT = float(1 << 15)


def usable(vector: Column) -> Column:
    """Whether a vector is not null and all its components are finite numbers."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def whole_numbers(column: pa.Array, length: int) -> np.ndarray:
    """(rows, length) integers of a list column without nulls."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)
    if len(x) and np.abs(x).max() > LIMIT:
        raise ValueError(f"components beyond {LIMIT:g} are not covered")
    return np.floor(x * SCALE).astype(np.int64)


class Blocks:
    """Block sums, scaled, and norms of the rests, of the rows of an integer matrix, for one number of blocks."""

    def __init__(self, x: np.ndarray, n: int):
        width = -(-x.shape[1] // n)
        padded = np.pad(x, ((0, 0), (0, width * n - x.shape[1]))).reshape(len(x), n, width).astype(np.float64)
        total = padded.sum(2)
        self.mean = total / np.sqrt(width)  # squares of differences are width * (difference of means)^2
        self.rest = np.sqrt(np.maximum((padded * padded).sum(2) - self.mean * self.mean, 0))


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of the nearest entry of each row (the lowest of equal ones), its squared distance, and how many exact distances it took."""
    n, m = len(x), len(entries)
    if not x.shape[1] or not n:
        return np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    # sums of squares are rounded by less than this share of themselves
    slack = 1e-9 * ((x.astype(np.float64) ** 2).sum(1) + (entries.astype(np.float64) ** 2).sum(1).max()) + 1e-6
    one, other = Blocks(x, 1), Blocks(entries, 1)
    bound = (one.mean - other.mean.T) ** 2 + (one.rest - other.rest.T) ** 2
    guess = bound.argmin(1)
    limit = ((x - entries[guess]) ** 2).sum(1)
    row, entry = np.nonzero(bound <= (limit + slack)[:, None])
    blocks = 2
    while blocks < x.shape[1] and len(row) > n:
        a, b = Blocks(x, blocks), Blocks(entries, blocks)
        bound = ((a.mean[row] - b.mean[entry]) ** 2 + (a.rest[row] - b.rest[entry]) ** 2).sum(1)
        keep = bound <= (limit + slack)[row]
        row, entry = row[keep], entry[keep]
        blocks *= 2
    far = np.iinfo(np.int64).max
    exact = np.full((n, m), far)
    exact[row, entry] = ((x[row] - entries[entry]) ** 2).sum(1)
    best = exact.argmin(1)
    return best, exact[np.arange(n), best], len(row) + n


def encode(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, parts) codes and squared distances."""
    width = x.shape[1] // len(books)
    found = [nearest(x[:, p * width : (p + 1) * width], book)[:2] for p, book in enumerate(books)]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield batch.slice(at, BLOCK)
    T.give_back()


def refine(vectors: DataFrame, books: list[np.ndarray], length: int) -> list[np.ndarray]:
    """Codebooks after one round: each entry becomes the floor of the mean of its parts; unused ones stay."""
    width, entries = length // len(books), len(books[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(books), entries, width + 1), np.int64)
        for batch in _slices(batches):
            x = whole_numbers(batch.column(0), length)
            codes, _ = encode(x, books)
            for p in range(len(books)):
                np.add.at(sums[p], codes[:, p], np.pad(x[:, p * width : (p + 1) * width], ((0, 0), (0, 1)), constant_values=1))
        p, e = np.nonzero(sums[:, :, -1])
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(sums[p, e, -1]), pa.array(list(sums[p, e, :-1]), pa.list_(pa.int64()))], ["p", "e", "n", "s"])

    parts = vectors.select("vector").mapInArrow(run, "p int, e int, n long, s array<long>")
    total = parts.groupBy("p", "e").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[k]).alias(f"s{k}") for k in range(width)])
    out = [b.copy() for b in books]
    for r in total.collect():  # PARTS * ENTRIES rows at most
        out[r["p"]][r["e"]] = [r[f"s{k}"] // r["n"] for k in range(width)]
    return out


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[list[np.ndarray], int]:
    """Codebooks of usable (vec_id, vector) rows, and the length of their vectors; none for an empty table."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    if not first:
        return [], 0
    length = len(first[0]["vector"])
    if length % parts:
        raise ValueError(f"{parts} equal parts of {length} components are asked for")
    same = vectors.filter(F.size("vector") == length)
    if any(len(r["vector"]) != length for r in first):
        first = same.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    x = whole_numbers(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), length)
    width = length // parts
    books = [x[:, p * width : (p + 1) * width] for p in range(parts)]
    for _ in range(rounds):
        books = refine(same, books, length)
    return books, length


def coded(rows: DataFrame, books: list[np.ndarray], length: int) -> DataFrame:
    """(vec_id, label, code, error, errors) of usable rows (vec_id, label, vector): a byte for each part, the squared distance, and that of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            codes, errors = encode(whole_numbers(batch.column(2), length), books)
            code = pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), code, pa.array(errors.sum(1)), pa.array(list(errors), pa.list_(pa.int64()))], ["vec_id", "label", "code", "error", "errors"])

    kinds = dict(rows.dtypes)
    return rows.filter(F.size("vector") == length).mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code binary, error long, errors array<long>")


def compress(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """vec_id, label, code, error, errors and label_error of each kept row, and the final codebooks.

    The errors of a label are summed before they are shuffled, and meet the rows in a join that Spark may split."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte for each part")
    rows = embeddings.filter(usable(F.col("embedding"))).select("vec_id", "label", F.col("embedding").alias("vector"))
    books, length = train(rows.select("vec_id", "vector"), parts, entries, rounds)
    if not books:
        books, length = [np.zeros((1, 0), np.int64)] * parts, 0
    final = materialise(coded(rows, books, length), "codes")
    sums = final.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return final.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of"), books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
