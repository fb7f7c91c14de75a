"""Language identification with interpolated Kneser-Ney character models.

Texts are read as lower-cased letters with single boundaries between runs of letters.
Character 4-grams are counted for each language over all training rows; the counts of
lower orders are the numbers of distinct continuations, as Kneser-Ney asks for.  A model
is a set of sorted code arrays, which holds every 4-gram that was counted; they lie in the
shared folder and executors map them into memory.  The language of a text
is the one with the least cross-entropy per character.  The temperature of the score and
the limit on the cross-entropy, above which a text is rejected, are calibrated on
all training rows that the counts leave out; the limit comes from quantiles, which single
odd rows do not move.  Where such rows are few, a text is rejected that its best model
predicts clearly worse than a guess among all letters would.

Cases: null texts and texts without a letter get 'und' and score 0; rows with a null lang
are not learned from; without any training row all predictions are 'und'; repeated rows
count each; very long texts are scored whole.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .shared import materialise, scratch, text_batches

ORDER = 4
BITS = 15
CHUNK_BYTES = 1 << 20
#: 4-grams that come to the driver, or are settled, at once.
PIECE = 2_000_000
#: One training row in so many is kept for calibration.
CALIBRATION_PART = 8
#: Fewer calibration rows than this leave the temperature at 1 and the limit at its fallback.
CALIBRATION_LEAST = 20
#: The limit is this much strangeness at least, and twice this quantile of the calibration rows.
LIMIT, LIMIT_QUANTILE = 10.0, 0.99
#: Letters that count as evidence for the rejection limit.
EVIDENCE = 400


def _classes() -> np.ndarray:
    out = np.zeros(0x10000, np.uint16)
    for cp in range(0x10000):
        c = chr(cp)
        if c.isalpha():
            low = ord(c.lower()[0])
            out[cp] = low if low < 0x7FFF else 1 + low % 0x7FFE
    return out


CLASSES: list[np.ndarray] = []


def letters(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """4-gram codes of all characters that are predicted, and the document of each."""
    if not CLASSES:
        CLASSES.append(_classes())
    cps = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=heads[1:])
    offs = heads[offs]
    if len(cps) != offs[-1]:
        raise ValueError("text is not valid UTF-8")
    kind = CLASSES[0][np.minimum(cps, 0xFFFF)]
    far = np.flatnonzero(cps > 0xFFFF)
    for at in far:
        c = chr(cps[at])
        kind[at] = 1 + ord(c.lower()[0]) % 0x7FFE if c.isalpha() else 0
    keep = kind != 0
    after = np.append(False, keep[:-1])
    starts = offs[:-1][offs[:-1] < len(kind)]
    after[starts] = False
    keep |= after
    at = np.flatnonzero(keep)
    doc = np.searchsorted(offs, at, "right") - 1
    pad = ORDER - 1
    place = np.arange(len(at)) + pad * (doc + 1)
    s = np.zeros(len(at) + pad * len(offs) + 1, np.uint64)
    s[place] = kind[at]
    code = np.zeros(len(place), np.uint64)
    for k in range(pad, -1, -1):
        code = (code << np.uint64(BITS)) | s[place - k]
    return code, doc


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of all parts with summed counts."""
    keys = np.concatenate([p[0] for p in parts])
    counts = np.concatenate([p[1] for p in parts])
    by = np.argsort(keys, kind="stable")
    keys, counts = keys[by], counts[by]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in a sorted array, and whether it is there."""
    at = np.minimum(np.searchsorted(table, keys), max(0, len(table) - 1))
    return at, table[at] == keys if len(table) else np.zeros(len(keys), bool)


def stored(values: np.ndarray, folder: str | None) -> np.ndarray:
    """The array, mapped from a new file of the folder if there is one."""
    if folder is None or not len(values):
        return values
    path = f"{folder}/{uuid.uuid4().hex}.npy"
    np.save(path, values)
    return np.load(path, mmap_mode="r")


class Mapped:
    """Arrays that are mapped from files are pickled as the paths of these."""

    def __getstate__(self) -> dict:
        return {k: Path(v.filename) if isinstance(v, np.memmap) else v for k, v in self.__dict__.items()}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update({k: np.load(v, mmap_mode="r") if isinstance(v, Path) else v for k, v in state.items()})


@dataclass
class Level(Mapped):
    """One order: n-grams with their discounted probabilities, contexts with what they leave to lower orders."""

    grams: np.ndarray
    share: np.ndarray
    contexts: np.ndarray
    rest: np.ndarray


@dataclass
class Model(Mapped):
    langs: list[str] = field(default_factory=list)
    levels: list[list[Level]] = field(default_factory=list)
    uniform: float = 1.0
    known: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    logs: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    temperature: float = 1.0
    mean: float = 0.0
    spread: float = 1.0
    limit: float = float("inf")

    def probability(self, codes: np.ndarray) -> np.ndarray:
        """Interpolated Kneser-Ney probability of each 4-gram's last character, a column for each language."""
        out = np.empty((len(codes), len(self.langs)))
        for k, levels in enumerate(self.levels):
            p = np.full(len(codes), self.uniform)
            for order, level in enumerate(levels, 1):
                gram = codes & np.uint64((1 << (BITS * order)) - 1)
                at, there = find(level.grams, gram)
                mine = np.where(there, level.share[at], 0.0) if len(level.grams) else 0.0
                at, there = find(level.contexts, gram >> np.uint64(BITS))
                p = mine + p * (np.where(there, level.rest[at], 1.0) if len(level.contexts) else 1.0)
            out[:, k] = p
        return out

    def settle(self, folder: str | None) -> None:
        known = np.unique(np.concatenate([levels[-1].grams for levels in self.levels])) if self.levels else self.known
        logs = np.empty((len(known), len(self.langs)), np.float32)
        for at in range(0, len(known), PIECE):
            logs[at : at + PIECE] = np.log(self.probability(known[at : at + PIECE]))
        self.known, self.logs = stored(known, folder), stored(logs, folder)

    def entropies(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each document under each language, and its number of characters."""
        docs = len(offs) - 1
        code, doc = letters(raw, offs)
        n = np.bincount(doc, minlength=docs)
        total = np.zeros((docs, len(self.langs)))
        if len(code) and self.langs:
            keys, inverse = np.unique(code, return_inverse=True)
            at, there = find(self.known, keys)
            logs = self.logs[at] if len(self.known) else np.zeros((len(keys), len(self.langs)), np.float32)
            if not there.all():
                logs = logs.copy()
                logs[~there] = np.log(self.probability(keys[~there]))
            for k in range(len(self.langs)):
                total[:, k] = np.bincount(doc, weights=logs[inverse, k], minlength=docs)
        has_letter = np.bincount(doc, weights=(code & np.uint64((1 << BITS) - 1)) > 0, minlength=docs) > 0
        n = np.where(has_letter, n, 0)
        return -total / np.maximum(n, 1)[:, None], n

    def scores(self, entropy: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Calibrated probability of the language of least cross-entropy."""
        if not self.langs:
            return np.zeros(len(n))
        z = -(entropy - entropy.min(1, keepdims=True)) * n[:, None] * self.temperature
        return np.where(n > 0, 1 / np.exp(np.maximum(z, -700)).sum(1), 0.0)

    def strangeness(self, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (best - self.mean) / self.spread * np.sqrt(np.minimum(n, EVIDENCE))


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]], folder: str | None = None) -> Model:
    """A model from the sorted 4-gram codes and counts of each language; its arrays go to the folder."""
    model = Model(langs=sorted(counts))
    low = np.uint64(BITS)
    alphabet = np.unique(np.concatenate([np.unique(c[0] & np.uint64((1 << BITS) - 1)) for c in counts.values()])) if counts else []
    model.uniform = 1.0 / (len(alphabet) + 1)
    for lang in model.langs:
        grams, n = counts[lang]
        levels = []
        for order in range(ORDER, 0, -1):
            ones, twos = (n == 1).sum(), (n == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            context = grams >> low
            first = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(grams) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(first, len(grams)))
            total = np.add.reduceat(n, first) if len(first) else n
            share = np.maximum(n - discount, 0) / np.repeat(total, sizes)
            rest = discount * sizes / np.maximum(total, 1)
            levels.append(Level(stored(grams, folder), stored(share, folder), stored(context[first], folder), stored(rest, folder)))
            if order > 1:
                shorter = grams & np.uint64((1 << (BITS * (order - 1))) - 1)
                grams, n = merged([(shorter, np.ones(len(shorter), np.int64))])
        model.levels.append(levels[::-1])
    model.settle(folder)
    return model


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4


def count_grams(train: DataFrame) -> DataFrame:
    """(lang, code, n) over all rows of `train`; tasks add up their own counts before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        sizes: dict[str, int] = {}

        def out(lang: str) -> pa.RecordBatch:
            keys, n = merged(held.pop(lang))
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "code", "n"])

        for batch in T.chunks(batches, "text", CHUNK_BYTES):
            raw, offs = T.flatten(batch.column(0))
            code, doc = letters(raw, offs)
            langs = np.array(batch.column(1).to_pylist(), object)[doc]
            for lang in set(langs.tolist()):
                keys, n = np.unique(code[langs == lang], return_counts=True)
                held.setdefault(lang, []).append((keys, n))
                sizes[lang] = sizes.get(lang, 0) + len(keys)
                if sizes[lang] > 1_500_000:
                    held[lang] = [merged(held[lang])]
                    sizes[lang] = len(held[lang][0][0])
                    if sizes[lang] > 1_000_000:
                        yield out(lang)
                        sizes[lang] = 0
        for lang in list(held):
            yield out(lang)

    return train.select("text", "lang").mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def local_folder(spark: SparkSession) -> str | None:
    """A new folder of the shared place, if that is mounted as a path."""
    path = scratch(spark)
    path = path.removeprefix("file:") if path.startswith("file:") else path
    if ":" in path.split("/")[0]:
        return None
    path = "/" + path.lstrip("/")
    os.makedirs(path, exist_ok=True)
    return path


def gathered(grams: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n rows (code, n), sorted, a piece at a time."""
    pieces = max(1, -(-n // PIECE))
    keys, counts, at = np.empty(n, np.uint64), np.empty(n, np.int64), 0
    for k in range(pieces):
        part = grams.filter(F.pmod(F.xxhash64("code"), F.lit(pieces)) == k).select("code", "n").toArrow()
        keys[at : at + len(part)] = part.column(0).to_numpy()
        counts[at : at + len(part)] = part.column(1).to_numpy()
        at += len(part)
    by = np.argsort(keys)
    return keys[by], counts[by]


def train(docs: DataFrame) -> Model:
    """A calibrated model from the rows of `docs` (text, lang, doc_id)."""
    text_batches(docs.sparkSession)
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    aside = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(CALIBRATION_PART)) == 0
    table = materialise(count_grams(rows.filter(~aside)), "grams")
    folder = local_folder(docs.sparkSession)
    counts = {}
    for r in table.groupBy("lang").agg(F.count("*").alias("k")).collect():
        keys, n = gathered(table.filter(F.col("lang") == r["lang"]), r["k"])
        counts[r["lang"]] = stored(keys, folder), stored(n, folder)
    model = build(counts, folder)
    if model.langs:
        calibrate(model, rows.filter(aside))
    return model


def calibrate(model: Model, rows: DataFrame) -> None:
    """Fit the temperature and the rejection limit on rows with known language."""
    model.mean, model.spread, model.limit = -float(np.log(model.uniform)), 1.0, LIMIT
    shipped = rows.sparkSession.sparkContext.broadcast(model)
    grid = np.geomspace(1e-3, 1, 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        place = {lang: k for k, lang in enumerate(model.langs)}
        for batch in T.chunks(batches, "text", CHUNK_BYTES):
            entropy, n = model.entropies(*T.flatten(batch.column(0)))
            truth = np.array([place.get(lang, -1) for lang in batch.column(1).to_pylist()], int)
            keep = np.flatnonzero((n > 0) & (truth >= 0))
            entropy, n, truth = entropy[keep], n[keep], truth[keep]
            best = entropy.min(1)
            losses = np.empty((len(keep), len(grid)))
            for k, t in enumerate(grid):
                p = np.exp(-(entropy - best[:, None]) * n[:, None] * t)
                p = p[np.arange(len(n)), truth] / p.sum(1)
                losses[:, k] = -np.log(np.maximum(p, 1e-9))
            yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.int64)), pa.array(best), pa.array(losses.tolist(), pa.list_(pa.float64()))], ["n", "best", "losses"])

    found = materialise(rows.select("text", "lang").mapInArrow(run, "n long, best double, losses array<double>"), "calibration")
    first = found.agg(F.count("*").alias("rows"), F.percentile("best", F.lit(0.5)).alias("mean"), *[F.avg(F.get("losses", F.lit(k))).alias(f"loss{k}") for k in range(len(grid))]).first()
    if first["rows"] < CALIBRATION_LEAST:
        return
    model.temperature = float(min((first[f"loss{k}"], t) for k, t in enumerate(grid))[1])
    model.mean = float(first["mean"])
    away = (F.col("best") - F.lit(model.mean)) * F.sqrt(F.least("n", F.lit(EVIDENCE)))
    spread, far = found.agg(F.percentile(F.abs(away), F.lit(0.5)), F.percentile(away, F.lit(LIMIT_QUANTILE))).first()
    model.spread = float(max(1e-3, spread))
    model.limit = float(max(LIMIT, 2 * far / model.spread))


OUT = "__tm_lang string, __tm_score double, __tm_rejected boolean"


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns `keep` of `docs` with __tm_lang, __tm_score and __tm_rejected, from the text alone."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in keep if c != "text"] + [c for c in keep if c == "text"]
    whole = "text" in keep
    rows = docs.select(*keep) if whole else docs.select(*keep, "text")
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        langs = np.array([*model.langs, "und"], object)
        for batch in T.chunks(batches, "text", CHUNK_BYTES):
            entropy, n = model.entropies(*T.flatten(batch.column(batch.num_columns - 1)))
            some = (n > 0) & bool(model.langs)
            best = np.where(some, entropy.argmin(1) if model.langs else 0, -1)
            score = model.scores(entropy, n)
            low = entropy.min(1) if model.langs else np.zeros(len(n))
            gone = ~some | (model.strangeness(low, n) > model.limit)
            added = [pa.array(langs[best], pa.string()), pa.array(score), pa.array(gone)]
            passed = batch.num_columns if whole else batch.num_columns - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:passed], *added], [*batch.schema.names[:passed], "__tm_lang", "__tm_score", "__tm_rejected"])

    return rows.mapInArrow(run, f"{names}, {OUT}")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected: learned from the rows that are not held out."""
    model = train(docs.select("doc_id", "text", "lang").filter(fold(F.col("doc_id")) != 2))
    out = predict(docs, model, ["doc_id"])
    return out.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), F.col("__tm_lang").alias("lang_pred"), F.col("__tm_score").alias("score"), F.col("__tm_rejected").alias("rejected"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """`docs` without the rows that are rejected: no letter, or unlike every learned language."""
    model = train(docs.select("doc_id", "text", "lang").filter(fold(F.col("doc_id")) != 2))
    out = predict(docs.select(*docs.columns), model, docs.columns)
    return out.filter(~F.col("__tm_rejected")).select(*docs.columns)
