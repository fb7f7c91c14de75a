"""Toxicity by a counterfactual-regularised linear classifier.

Features are the distinct words of a text.  A bounded sample of labelled rows is drawn
for each label by hash of the id; executors turn its texts into word hashes, and also into
counterfactuals: the same sentence with an identity term swapped for another one of its
group or for a neutral word, or, where there is none, with a term put in.  The driver
fits weights by proximal gradient steps on logistic loss + L1 + the mean squared change
of the score between a sentence and its counterfactuals, so that mentioning a group moves
the score as little as possible.  The kept words are then refitted without L1.

Cases: null text is empty and gets the score of a text without known words; rows whose
label is null or whose document is missing are not learned from; with no usable labels
every score is 0; repeated rows are scored each; very long texts are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .language import fold

# Identity terms by group; the last word of each line is the neutral one.
IDENTITIES = """
muslim christian jewish hindu buddhist atheist religious
women men girls boys transgender people
woman man girl boy person
gay straight lesbian bisexual queer person
black white asian latino african european american
immigrant refugee foreigner citizen
disabled blind deaf able person
muslime christen juden frauen männer leute
femmes hommes musulmans chrétiens juifs gens
mujeres hombres musulmanes cristianos judíos personas
"""

#: Labelled rows learned from, for each label.
SAMPLE_ROWS = 6000
SWAPS = 4
L1 = 1e-4
FAIRNESS = 1.0
RIDGE = 3e-5
STEPS = 250
THRESHOLD = 0.3


def groups() -> list[list[int]]:
    return [[T.word_hash(w) for w in line.split()] for line in IDENTITIES.strip().splitlines()]


@dataclass
class Model:
    words: np.ndarray
    weights: np.ndarray
    bias: float | None

    def scores(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        docs = len(offs) - 1
        if self.bias is None:
            return np.zeros(docs)
        total = np.full(docs, self.bias)
        if len(self.words) and len(raw):
            hashes, doc, _, _ = T.word_hashes(raw, offs, T.ALNUM)
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            known = self.words[at] == hashes
            pair = np.unique(doc[known] * len(self.words) + at[known])
            total += np.bincount(pair // len(self.words), weights=self.weights[pair % len(self.words)], minlength=docs)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _examples(batch: pa.RecordBatch, terms: dict[int, list[int]], spare: list[int]) -> pa.RecordBatch:
    """Distinct words of each text, and the words each counterfactual takes away and puts in."""
    raw, offs = T.flatten(batch.column(0))
    hashes, doc, _, _ = T.word_hashes(raw, offs, T.ALNUM)
    first = T.segment_ids(doc, batch.num_rows)
    words, gone, added = [], [], []
    for d in range(batch.num_rows):
        mine = np.unique(hashes[first[d] : first[d + 1]])
        have = set(mine.tolist())
        swaps = [(w, x) for w in have & terms.keys() for x in terms[w] if x not in have][:SWAPS]
        if not swaps and spare:
            swaps = [(0, spare[(d * 7 + len(have)) % len(spare)])]
        words.append(mine.view(np.int64))
        gone.append(np.array([w for w, _ in swaps], np.uint64).view(np.int64))
        added.append(np.array([x for _, x in swaps], np.uint64).view(np.int64))
    kind = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), *[pa.array(x, kind) for x in (words, gone, added)]], ["toxic", "weight", "words", "gone", "added"])


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The learned-from rows: at most `rows` of each label, weighted back to the labels' shares."""
    # one label for each id: the larger of repeated ones
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 2)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).toLocalIterator()}
    parts = [usable.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).withColumn("weight", F.lit(n / min(n, rows))) for k, n in sizes.items()]
    if not parts:
        return docs.select("text", F.lit(0).alias("toxic"), F.lit(0.0).alias("weight")).limit(0)
    picked = parts[0]
    for p in parts[1:]:
        picked = picked.unionByName(p)
    # at most 2 * rows ids
    return docs.join(F.broadcast(picked), "doc_id").select("text", "toxic", "weight")


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    by_term = {w: [x for x in g if x != w] for g in groups() for w in g[:-1]}
    spare = sorted(by_term)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.chunks(batches):
            yield _examples(batch, by_term, spare)

    lists = ", ".join(f"{k} array<long>" for k in ("words", "gone", "added"))
    got = sample(docs, labels, rows).mapInArrow(run, f"toxic int, weight double, {lists}").toArrow()
    y = got["toxic"].to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        return Model(np.zeros(0, np.uint64), np.zeros(0), None)
    return fit(y, got["weight"].to_numpy(), *[_ragged(got[k]) for k in ("words", "gone", "added")])


def _ragged(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values, as unsigned hashes, and the row of each."""
    lists = column.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    return lists.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(len(lists)), sizes)


def fit(y: np.ndarray, weight: np.ndarray, words: tuple, gone: tuple, added: tuple, l1: float = L1, fairness: float = FAIRNESS) -> Model:
    """Weights of words that occur in three or more examples, or stand in counterfactuals."""
    vocabulary, n = np.unique(words[0], return_counts=True)
    in_swaps = np.unique(np.concatenate([gone[0], added[0]]))
    vocabulary = np.union1d(vocabulary[n >= 3], in_swaps[in_swaps > 0])
    v = len(vocabulary)

    def placed(values: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(vocabulary, values), v - 1)
        return np.where(vocabulary[at] == values, at, v)

    x, row = placed(words[0]), words[1]
    keep = x < v
    x, row = x[keep], row[keep]
    out, put = placed(gone[0]), placed(added[0])
    weight = weight / weight.sum()

    def solve(x: np.ndarray, row: np.ndarray, out: np.ndarray, put: np.ndarray, v: int, l1: float, l2: float, steps: int) -> tuple[np.ndarray, float]:
        w, bias = np.zeros(v + 1), float(np.log((weight @ y) / (1 - weight @ y)))
        pairs = max(1, len(out))
        size = np.bincount(row, minlength=len(y)) + 1.0
        # a step size for each word: a bound on the curvature along it
        bound = 0.25 * np.bincount(x, weights=(weight * np.sqrt(size))[row], minlength=v + 1) * 4 + l2 + 1e-6
        bound += 4 * fairness / pairs * (np.bincount(out, minlength=v + 1) + np.bincount(put, minlength=v + 1))
        z, momentum, b_z = w.copy(), 1.0, bias
        for _ in range(steps):
            z[v] = 0.0
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=z[x], minlength=len(y)) + b_z, -30, 30)))
            err = weight * (p - y)
            change = z[put] - z[out]
            grad = np.bincount(x, weights=err[row], minlength=v + 1) + l2 * z
            grad += 2 * fairness / pairs * (np.bincount(put, weights=change, minlength=v + 1) - np.bincount(out, weights=change, minlength=v + 1))
            new = z - grad / bound
            new = np.sign(new) * np.maximum(np.abs(new) - l1 / bound, 0)
            new[v] = 0.0
            b_new = b_z - err.sum() / 0.25 / 4
            nxt = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
            z, b_z = new + (momentum - 1) / nxt * (new - w), b_new + (momentum - 1) / nxt * (b_new - bias)
            w, bias, momentum = new, b_new, nxt
        return w[:v], bias

    w, _ = solve(x, row, out, put, v, l1, 0.0, STEPS)
    chosen = np.flatnonzero(w)
    slot = np.full(v + 1, len(chosen))
    slot[chosen] = np.arange(len(chosen))
    kept = slot[x] < len(chosen)
    w, bias = solve(slot[x[kept]], row[kept], slot[out], slot[put], len(chosen), 0.0, RIDGE, STEPS)
    return Model(vocabulary[chosen], w, bias)


def score(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    model = train(docs.select("doc_id", "text"), labels, rows)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.chunks(batches):
            s = shipped.value.scores(*T.flatten(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
