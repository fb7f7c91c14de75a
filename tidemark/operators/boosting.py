"""Histogram gradient boosting for quantiles and means, in memory for one job or over the rows of a table.

Values become bins by edges from quantile sketches; bin 0 is for missing values.  A tree grows
level by level: counts and gradient sums by (leaf, feature, bin) decide the splits, the best ones
first until there are enough leaves.  A leaf's value is the residuals' quantile (or mean); the
quantile is read from counts in two steps, a coarse one over the range of all residuals and
a fine one inside the bin that holds it, so that it needs no sort and counts add up.

Both sources of counts, arrays in memory and a table in Spark, serve the same growth; with quantile loss all sums are integers, so
that both give the same trees.  A table's rows lie in blocks, dealt evenly over the tasks whatever the layout of the input.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialise

TREES, RATE, LEAVES, LEAST = 160, 0.025, 20, 20
BINS = 64
#: Residual bins of each of the two steps of a leaf's quantile.
STEPS = 1024
#: Trees after which scores over a table are written anew.
REFRESH = 10
#: Rows in a block of a table.
BLOCK = 20_000


@dataclass
class Tree:
    """Nodes in the order of their making; a node without feature (-1) is a leaf."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        """Rows with a bin up to `cut` go left."""
        made = len(self.feature), len(self.feature) + 1
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, *made
        for column, empty in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
            column += [empty, empty]
        return made

    def nodes(self, codes: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        at = np.zeros(len(codes), np.int64)
        feature, cut, left, right = (np.array(v) for v in (self.feature, self.cut, self.left, self.right))
        rows = np.arange(len(codes))
        while True:
            inner = feature[at] >= 0
            if not inner.any():
                return at
            goes = codes[rows, np.maximum(feature[at], 0)] <= cut[at]
            at = np.where(inner, np.where(goes, left[at], right[at]), at)

    def predict(self, codes: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(codes)]


class Leaves:
    """A tree as tables: bit k of a feature's bin is set where leaf k may hold it, so that a row's leaf is the bit that all its bins share."""

    def __init__(self, tree: Tree):
        self.ends = [k for k, f in enumerate(tree.feature) if f < 0]
        self.values = np.array(tree.value)[self.ends]
        self.used = sorted({f for f in tree.feature if f >= 0})
        spans: dict[int, dict[int, tuple[int, int]]] = {0: {}}  # by node and feature: its bins, end exclusive
        for node, f in enumerate(tree.feature):
            if f >= 0:
                box = spans.pop(node)
                low, high = box.get(f, (0, 256))
                spans[tree.left[node]], spans[tree.right[node]] = box | {f: (low, tree.cut[node] + 1)}, box | {f: (tree.cut[node] + 1, high)}
        self.words = np.zeros((-(-len(self.ends) // 64), len(self.used), 256), np.uint64)
        for k, end in enumerate(self.ends):
            for row, f in enumerate(self.used):
                self.words[k // 64, row, slice(*spans[end].get(f, (0, 256)))] |= np.uint64(1 << k % 64)

    def places(self, codes: np.ndarray) -> np.ndarray:
        """The place in `ends` of the leaf of each column of (feature, row) bins."""
        at = np.zeros(codes.shape[1], np.int64)
        for k, table in enumerate(self.words) if self.used else ():
            bits = table[0][codes[self.used[0]]]
            for row, f in enumerate(self.used[1:], 1):
                bits &= table[row][codes[f]]
            place = np.frexp(bits.astype(float))[1]  # 1 + the place of the bit, 0 without one
            at += place if not k else np.where(place > 0, place + 64 * k, 0)
        return at - 1 if self.used else at

    def predict(self, codes: np.ndarray) -> np.ndarray:
        return self.values[self.places(codes)]


@dataclass
class Model:
    edges: list[np.ndarray]
    base: float
    rate: float
    trees: list[Tree] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        codes = binned(x, self.edges)
        return self.base + self.rate * sum(t.predict(codes) for t in self.trees)


def edges_of(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Edges between the bins 1, 2, ... of each column, at quantiles of its finite values."""
    out = []
    for column in x.T:
        some = column[np.isfinite(column)]
        out.append(np.unique(np.quantile(some, np.linspace(0, 1, bins)[1:-1])) if len(some) else np.zeros(0))
    return out


def binned(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bin 0 for what is missing, else 1 + the number of edges below."""
    codes = np.stack([np.searchsorted(e, c) + 1 for e, c in zip(edges, x.T, strict=True)], 1) if len(edges) else np.zeros((len(x), 0), np.int64)
    return np.where(np.isfinite(x), codes, 0).astype(np.uint8)


def histograms(codes: np.ndarray, node: np.ndarray, active: Sequence[int], r: np.ndarray, level: float | None, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """(active leaf, feature, bin): rows, and rows below their forecast (or the sum of residuals, for means)."""
    place = np.full(int(node.max(initial=0)) + 1 + max(active), -1)
    place[list(active)] = np.arange(len(active))
    keep = place[node] >= 0
    codes, slot, r = codes[keep], place[node[keep]], r[keep]
    shape = (len(active), codes.shape[1], bins)
    flat = (slot[:, None] * shape[1] + np.arange(shape[1])) * bins + codes
    size = int(np.prod(shape))
    if level is not None:  # both counts at once
        both = np.bincount((flat + (r < 0)[:, None] * size).ravel(), minlength=2 * size).reshape(2, *shape)
        return both[0] + both[1], both[1].astype(float)
    return np.bincount(flat.ravel(), minlength=size).reshape(shape), np.bincount(flat.ravel(), np.repeat(r, shape[1]), size).reshape(shape)


def residual_bins(r: np.ndarray, low: np.ndarray, width: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((r - low) / width * STEPS), -1, STEPS).astype(np.int64)


def grow(counts, leaf_values, level: float | None, leaves: int, least: int) -> Tree:
    """One tree: `counts(tree, active)` gives histograms, `leaf_values(tree, leaves)` the value of each leaf."""
    tree, active, made = Tree(), [0], 1
    while active and made < leaves:
        n, s = counts(tree, active)
        if level is not None:
            s = level * n - s  # sum of the gradients: level, less one for each row below its forecast
        below_n, below_s = np.cumsum(n, 2)[:, :, :-1], np.cumsum(s, 2)[:, :, :-1]
        all_n, all_s = n.sum(2)[:, :, None], s.sum(2)[:, :, None]
        above_n, above_s = all_n - below_n, all_s - below_s
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = below_s**2 / below_n + above_s**2 / above_n - all_s**2 / all_n
        gain = np.where((below_n >= least) & (above_n >= least), gain, 0.0)
        flat = gain.reshape(len(active), -1)
        best = flat.argmax(1) if flat.shape[1] else np.zeros(len(active), int)
        value = flat[np.arange(len(active)), best] if flat.shape[1] else np.zeros(len(active))
        chosen = [k for k in np.argsort(-value, kind="stable") if value[k] > 1e-12][: leaves - made]
        after = []
        for k in sorted(chosen):
            after += tree.split(active[k], *(int(v) for v in divmod(best[k], gain.shape[2])))
        made += len(chosen)
        active = after
    ends = [k for k, f in enumerate(tree.feature) if f < 0]
    for k, v in zip(ends, leaf_values(tree, ends), strict=True):
        tree.value[k] = float(v)
    return tree


def quantile_from(count, leaves: int, low: float, high: float, level: float) -> np.ndarray:
    """Quantile of each leaf's residuals by counts: `count(low, width)` gives (leaf, STEPS + 2) rows below, in and above the bins of each
    leaf's range; the second call is for the bin that the first one found."""
    lows, widths = np.full(leaves, low), np.full(leaves, max(high - low, 1e-300))
    for _ in range(2):
        upto = np.cumsum(count(lows, widths), 1)
        rank = np.maximum(np.ceil(level * upto[:, -1]), 1)
        at = np.clip((upto >= rank[:, None]).argmax(1) - 1, 0, STEPS - 1)  # column 0 is what lies below
        lows, widths = lows + at / STEPS * widths, widths / STEPS
    return lows + widths / 2


class Memory:
    """Counts over arrays."""

    def __init__(self, codes: np.ndarray, y: np.ndarray, level: float | None, bins: int):
        self.codes, self.y, self.level, self.bins = codes, y, level, bins
        self.score = np.zeros(len(y))
        self.span = float(y.min()), float(y.max())

    def counts(self, tree: Tree, active: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
        return histograms(self.codes, tree.nodes(self.codes), active, self.y - self.score, self.level, self.bins)

    def totals(self, tree: Tree, ends: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
        node = np.searchsorted(ends, tree.nodes(self.codes))
        return np.bincount(node, minlength=len(ends)), np.bincount(node, self.y - self.score, len(ends))

    def residuals(self, tree: Tree, ends: Sequence[int]):
        node, r = np.searchsorted(ends, tree.nodes(self.codes)), self.y - self.score
        return lambda low, width: np.bincount(node * (STEPS + 2) + residual_bins(r, low[node], width[node]) + 1, minlength=len(ends) * (STEPS + 2)).reshape(len(ends), -1)

    def add(self, tree: Tree, rate: float) -> None:
        self.score += rate * tree.predict(self.codes)


def boost(source, edges: list[np.ndarray], level: float | None, trees: int, rate: float, leaves: int, least: int) -> Model:
    """The model over a source of counts; the bounds of all residuals follow from those of y and of the trees."""
    low, high = source.span

    def values(tree: Tree, ends: Sequence[int]) -> np.ndarray:
        if level is None:
            n, s = source.totals(tree, ends)
            return s / np.maximum(n, 1)
        return quantile_from(source.residuals(tree, ends), len(ends), low, high, level)

    first = Tree()
    first.value[0] = float(values(first, [0])[0])
    model = Model(edges, first.value[0], rate)
    source.add(first, 1.0)
    low, high = low - model.base, high - model.base
    for _ in range(trees):
        tree = grow(source.counts, values, level, leaves, least)
        model.trees.append(tree)
        source.add(tree, rate)
        ends = [v for v, f in zip(tree.value, tree.feature, strict=True) if f < 0]
        low, high = low - rate * max(ends), high - rate * min(ends)
    return model


def fit(x: np.ndarray, y: np.ndarray, level: float | None, trees: int = TREES, rate: float = RATE, leaves: int = LEAVES, least: int = LEAST, bins: int = BINS) -> Model:
    """A model of the arrays of one job."""
    edges = edges_of(x, bins)
    return boost(Memory(binned(x, edges), y, level, bins), edges, level, trees, rate, leaves, least)


#: A block: its rows, the bounds of y, and y, score (null for zeros) and (feature, row) bins in bytes.
KIND = "rows int, low double, high double, y binary, score binary, codes binary"


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray, np.ndarray, np.ndarray]]:
    """Each block with its y, scores and bins."""
    for batch in batches:
        for k in range(batch.num_rows):
            block = {name: batch.column(name)[k] for name in batch.schema.names}
            y = np.frombuffer(block["y"].as_buffer())
            score = np.frombuffer(block["score"].as_buffer()) if block["score"].is_valid else np.zeros(len(y))
            codes = block["codes"].as_buffer()
            yield block, y, score, (np.frombuffer(codes, np.uint8) if codes.size else np.zeros(0, np.uint8)).reshape(-1, len(y))


class Rows:
    """Counts over a table of blocks: each one is a pass in which tasks count their own rows and the counts are added up by leaf."""

    def __init__(self, table: DataFrame, features: int, level: float | None, bins: int):
        self.table, self.features, self.level, self.bins = table, features, level, bins
        self.later: list[tuple[Leaves, float]] = []
        self.span = tuple(float(v) for v in table.agg(F.min("low"), F.max("high")).first())

    def _passed(self, tree: Tree, slots: Sequence[int], sizes: tuple[int, int], count) -> list[tuple[np.ndarray, np.ndarray]]:
        """Sums by slot of `count(codes, slot, residuals)`, which gives two arrays (slot, size); rows of other leaves have a slot after the last."""
        later, look, kept = list(self.later), Leaves(tree), len(slots)
        slot_of = np.array([slots.index(k) if k in slots else kept for k in look.ends])

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = None
            for _, y, score, codes in _opened(batches):
                for t, rate in later:
                    score = score + rate * t.predict(codes)
                found = count(codes, slot_of[look.places(codes)], y - score)
                sums = found if sums is None else [a + b for a, b in zip(sums, found, strict=True)]
            if sums is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(kept, dtype=np.int32)), *[pa.array([row.astype(float).tobytes() for row in v[:kept]], pa.binary()) for v in sums]], ["slot", "a", "b"])

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list[np.ndarray]] = {}
            for batch in batches:
                for slot, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    found = [np.frombuffer(v) for v in (a, b)]
                    sums[slot] = found if slot not in sums else [x + y for x, y in zip(sums[slot], found, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), *[pa.array([v[k].tobytes() for v in sums.values()], pa.binary()) for k in (0, 1)]], ["slot", "a", "b"])

        kind = "slot int, a binary, b binary"
        out = [(np.zeros(sizes[0]), np.zeros(sizes[1])) for _ in slots]
        for row in self.table.mapInArrow(local, kind).repartition("slot").mapInArrow(merge, kind).collect():  # a row for each leaf
            out[row["slot"]] = np.frombuffer(row["a"]), np.frombuffer(row["b"])
        return out

    def counts(self, tree: Tree, active: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
        level, bins, shape = self.level, self.bins, (len(active), self.features, self.bins)
        slots = len(active) + 1

        def count(codes: np.ndarray, slot: np.ndarray, r: np.ndarray) -> list[np.ndarray]:
            if level is None:
                at = slot * bins
                both = [[np.bincount(at + c, w, slots * bins).reshape(slots, bins) for c in codes] for w in (None, r)]
            else:
                at = (slot * 2 + (r < 0)) * bins
                split = [np.bincount(at + c, minlength=2 * slots * bins).reshape(slots, 2, bins) for c in codes]
                both = [[v.sum(1) for v in split], [v[:, 1] for v in split]]
            return [np.concatenate(v, 1) for v in both]

        found = self._passed(tree, active, (shape[1] * bins, shape[1] * bins), count)
        return tuple(np.array([f[k] for f in found]).reshape(shape) for k in (0, 1))

    def totals(self, tree: Tree, ends: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
        def count(codes: np.ndarray, slot: np.ndarray, r: np.ndarray) -> list[np.ndarray]:
            return [np.bincount(slot, minlength=len(ends))[:, None], np.bincount(slot, r, len(ends))[:, None]]

        found = self._passed(tree, ends, (1, 1), count)
        return tuple(np.array([f[k][0] for f in found]) for k in (0, 1))

    def residuals(self, tree: Tree, ends: Sequence[int]):
        def passed(low: np.ndarray, width: np.ndarray) -> np.ndarray:
            def count(codes: np.ndarray, slot: np.ndarray, r: np.ndarray) -> list[np.ndarray]:
                b = residual_bins(r, low[slot], width[slot]) + 1
                return [np.bincount(slot * (STEPS + 2) + b, minlength=len(ends) * (STEPS + 2)).reshape(len(ends), -1), np.zeros((len(ends), 1))]

            return np.array([f[0] for f in self._passed(tree, ends, (STEPS + 2, 1), count)])

        return passed

    def add(self, tree: Tree, rate: float) -> None:
        self.later.append((Leaves(tree), rate))
        if len(self.later) >= REFRESH:
            self.table, self.later = materialise(scored(self.table, self.later), "scores"), []


def scored(table: DataFrame, trees: Sequence[tuple[Leaves, float]]) -> DataFrame:
    """Blocks whose scores have these trees added, in the order given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, score, codes in _opened(batches):
            for t, rate in trees:
                score = score + rate * t.predict(codes)
            yield pa.RecordBatch.from_arrays([pa.array([score.tobytes()], pa.binary()) if name == "score" else pa.array([v.as_py()], v.type) for name, v in block.items()], list(block))

    return table.mapInArrow(run, KIND)


def sketched_edges(df: DataFrame, features: Sequence[str], bins: int = BINS, accuracy: int = 10_000) -> list[np.ndarray]:
    """Edges from mergeable quantile sketches; they are features x bins numbers, whatever the rows."""
    at = F.array(*[F.lit(float(v)) for v in np.linspace(0, 1, bins)[1:-1]])
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c).cast("double"))
    row = df.agg(*[F.percentile_approx(finite(c), at, F.lit(accuracy)).alias(f"q{k}") for k, c in enumerate(features)]).first()
    return [np.unique(np.array(v, float)) if v else np.zeros(0) for v in row]


def binned_rows(df: DataFrame, features: Sequence[str], target: str, edges: list[np.ndarray]) -> DataFrame:
    """Blocks of the binned rows, dealt evenly over the tasks; rows without a finite target are left out."""
    chosen = df.filter(F.col(target).isNotNull() & ~F.isnan(F.col(target).cast("double"))).select(F.col(target).cast("double").alias("__y"), *[F.col(c).cast("double").alias(f"__x{k}") for k, c in enumerate(features)])

    def block(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        y, codes = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        values = [len(y), float(y.min()), float(y.max()), y.tobytes(), None, codes.T.tobytes()]
        kinds = [pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["rows", "low", "high", "y", "score", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(start, BLOCK)
                if held + piece.num_rows > BLOCK:
                    yield block(parts)
                    parts, held = [], 0
                x = np.stack([piece.column(1 + k).to_numpy(zero_copy_only=False) for k in range(len(features))], 1).astype(float)
                parts.append((piece.column(0).to_numpy(), binned(x, edges)))
                held += piece.num_rows
        if held:
            yield block(parts)

    return chosen.mapInArrow(run, KIND).repartition(4 * df.sparkSession.sparkContext.defaultParallelism)  # a file of one part gives work to all cores


def fit_rows(df: DataFrame, features: Sequence[str], target: str, level: float | None, trees: int = TREES, rate: float = RATE, leaves: int = LEAVES, least: int = LEAST, bins: int = BINS) -> Model:
    """A model of all rows of a table, which stay where they are: the driver holds edges, counts and trees only."""
    if not 2 <= bins <= 255:
        raise ValueError("a bin has one byte")
    edges = sketched_edges(df, features, bins)
    table = materialise(binned_rows(df, features, target, edges), "binned")
    if table.isEmpty():
        raise ValueError("there are no rows with a target")
    return boost(Rows(table, len(features), level, bins), edges, level, trees, rate, leaves, least)


def predict_rows(df: DataFrame, features: Sequence[str], model: Model, name: str = "predicted") -> DataFrame:
    """`df` with the model's forecast of each row."""
    kinds = df.schema
    doubles = {f.name for f in kinds if f.dataType.typeName() == "double"}  # they are there as they are
    cast = [c for c in dict.fromkeys(features) if c not in doubles]
    place = [len(kinds) + cast.index(c) if c in cast else kinds.names.index(c) for c in features]
    trees = [Leaves(t) for t in model.trees]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in place], 1).astype(float)
            codes = np.ascontiguousarray(binned(x, model.edges).T)
            out = model.base + model.rate * sum((t.predict(codes) for t in trees), np.zeros(batch.num_rows))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kinds)], pa.array(out)], [*kinds.names, name])

    given = df.select("*", *[F.col(c).cast("double").alias(f"__x{k}") for k, c in enumerate(cast)])
    return given.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kinds], f"{name} double"]))
