"""Alignment of the tokens of two tokenizers over the same texts.

Texts are encoded once and kept as token ids in the shared folder, in batches of about
CHUNK_BYTES.  A batch is aligned as a whole: its documents lie end to end, the ends of all A
and all B tokens are counted by byte once, and the text is cut where both have an end.
Prefix sums over the batch, taken at the documents' byte offsets, give each document's
groups and links.  Between two neighbouring ends lies one byte range that belongs to one A
and one B token, so that links are as many as different ends.

Counts of id pairs over the corpus are summed where they arise and then by pair; a pair's
count and whether it is the highest of its B id go back to every set of batches that holds
the pair, once, in a join on the pair that Spark may split.

Words recur, so a text is encoded in pieces: it is cut before a space that follows neither
white space nor a character that may be one.  Neither tokenizer has a token over such a cut: the
byte-level one never has a space after other characters in one of its words, and the
other's vocabulary is searched for one (where there is one, texts are encoded whole).
Each piece is encoded once for each task that remembers it, new ones many at a time.

Cases: null and empty texts, and texts whose tokens do not give back the same bytes, have no
tokens: counts of 0 and an empty digest; strings of special tokens are plain text; repeated
rows and rows with equal or null doc_id are documents of their own; very long texts are
used whole; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as T
from .shared import materialise

FOLDER = "/opt/tokenizers"
CHUNK_BYTES = 1 << 20
#: Batches that share one list of pair counts.
SET = 8
#: Pieces that a task remembers.
REMEMBERED = 300_000
#: Bytes of pieces that are encoded by one call.
CALL_BYTES = 1 << 16

WORD_START = "▁"
_models: dict[tuple[str, str, str], Pair] = {}


def byte_alphabet() -> dict[str, int]:
    """The byte of each character in the vocabulary of a byte-level tokenizer: printable bytes stand for themselves, others follow 255."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


@dataclass
class Pair:
    """Two tokenizers, and the bytes of each of their tokens."""

    a: object
    b: object
    a_bytes: list[bytes]
    b_bytes: list[bytes]
    cut: bool

    @staticmethod
    def load(folder: str, a: str, b: str) -> Pair:
        """The tokenizers of these files, kept between tasks of a worker."""
        if (folder, a, b) not in _models:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from sentencepiece import SentencePieceProcessor
            from tokenizers import Tokenizer

            first = Tokenizer.from_file(f"{folder}/{a}")
            first.encode_special_tokens = True
            second = SentencePieceProcessor(model_file=f"{folder}/{b}")
            alphabet = byte_alphabet()
            names = [first.id_to_token(k) or "" for k in range(first.get_vocab_size())]
            a_bytes = [bytes(alphabet[c] for c in n) if all(c in alphabet for c in n) else n.encode() for n in names]
            pieces = [second.id_to_piece(k) for k in range(second.get_piece_size())]
            b_bytes = [bytes([int(p[3:5], 16)]) if second.is_byte(k) else p.replace(WORD_START, " ").encode() for k, p in enumerate(pieces)]
            cut = not any(re.search(f"[^{WORD_START}]{WORD_START}", p) for p in pieces)
            _models[folder, a, b] = Pair(first, second, a_bytes, b_bytes, cut)
        return _models[folder, a, b]

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        """Of texts that begin with a space, which this tokenizer adds itself."""
        alone = [self.b.piece_to_id(WORD_START)]
        return [ids if len(t) > 1 else alone for t, ids in zip(texts, self.b.encode([t[1:] for t in texts], num_threads=1), strict=True)]


def cuts(raw: np.ndarray) -> np.ndarray:
    """Places of spaces that follow a character which is not white space for either tokenizer."""
    before, second, third = (np.append(np.zeros(k, np.uint8), raw)[: len(raw)] for k in (1, 2, 3))
    plain = (before > 32) & (before < 127)
    wide = (before >= 128) & (second != 0xC2) & ~(((third >= 0xE1) & (third <= 0xE3)) & ((second == 0x9A) | (second == 0x80) | (second == 0x81) | (second == 0x96)))
    return np.flatnonzero((raw == 32) & (plain | wide))


class Remembered:
    """Pieces by their bytes, with the ids of both tokenizers end to end."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.sizes = [np.array([len(x) for x in table], np.int64) for table in (pair.a_bytes, pair.b_bytes)]
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.ids = (array("I"), array("I"))
        self.offs = (array("q", [0]), array("q", [0]))
        self.good = array("b")

    def learn(self, pieces: list[bytes]) -> None:
        """New pieces; those that the first tokenizer would cut between anyhow go to it as one text."""
        last = [p.decode()[-1:].isspace() for p in pieces]
        for together in (True, False):
            held, size = [], 0
            for p in (p for p, alone in zip(pieces, last, strict=True) if (self.pair.cut and not alone) == together):
                held.append(p)
                size += len(p)
                if size >= CALL_BYTES:
                    self._learn(held, together)
                    held, size = [], 0
            if held:
                self._learn(held, together)

    def _learn(self, pieces: list[bytes], together: bool) -> None:
        texts, body = [p.decode() for p in pieces], b"".join(pieces)
        sizes = np.array([len(p) for p in pieces])
        found = [None, self.pair.encode_b(texts)]
        if together:
            (ids,) = self.pair.encode_a(["".join(texts)])
            upto = np.append(0, np.cumsum(self.sizes[0][ids]))
            at = np.searchsorted(upto, np.append(0, np.cumsum(sizes)))
            if b"".join(map(self.pair.a_bytes.__getitem__, ids)) == body and (upto[at[1:]] == np.cumsum(sizes)).all():
                found[0] = [ids[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        found[0] = found[0] or self.pair.encode_a(texts)
        good = np.ones(len(pieces), bool)
        for which, table in enumerate((self.pair.a_bytes, self.pair.b_bytes)):
            counts = np.array([len(x) for x in found[which]])
            flat = [k for x in found[which] for k in x]
            owner = np.repeat(np.arange(len(pieces)), counts)
            if (np.bincount(owner, self.sizes[which][flat], len(pieces)) != sizes).any() or b"".join(map(table.__getitem__, flat)) != body:
                good &= [b"".join(map(table.__getitem__, x)) == p for x, p in zip(found[which], pieces, strict=True)]
            ends = len(self.ids[which]) + np.cumsum(counts)
            self.ids[which].extend(flat)
            self.offs[which].extend(ends.tolist())
        self.at.update(zip(pieces, range(len(self.good), len(self.good) + len(pieces)), strict=True))
        self.good.extend(good.astype(int).tolist())

    def encode(self, pieces: list[bytes], owner: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For both tokenizers the ids of n texts end to end, and how many each has; `owner` has the text of each piece."""
        if len(self.good) > REMEMBERED:
            self.clear()
        self.learn([p for p in dict.fromkeys(pieces) if p not in self.at])
        index = np.array([self.at[p] for p in pieces], np.int64)
        bad = np.zeros(n, bool)
        bad[owner[np.array(self.good)[index] == 0]] = True
        index, owner = index[~bad[owner]], owner[~bad[owner]]
        out = []
        for ids, offs in zip(self.ids, self.offs, strict=True):
            ids, offs = np.array(ids), np.array(offs)
            sizes = np.diff(offs)[index]
            ends = np.cumsum(sizes)
            at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(offs[index] - ends + sizes, sizes)
            out.append((ids[at], np.bincount(owner, sizes, n).astype(np.int64)))
        return out


def encoded(docs: DataFrame, folder: str, a: str, b: str) -> DataFrame:
    """(part, ids, n_a, n_b, a, b): batches of documents with the token ids of both tokenizers, two or four bytes each, compressed."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair.load(folder, a, b)
        known = Remembered(pair)
        widths = [np.uint16 if len(x) <= 1 << 16 else np.uint32 for x in (pair.a_bytes, pair.b_bytes)]
        part = TaskContext.get().partitionId() << 32
        for k, batch in enumerate(T.chunks(batches, limit=CHUNK_BYTES)):
            raw, offs = T.flatten(batch.column(1))
            n = batch.num_rows
            some = np.flatnonzero(np.diff(offs))
            spaced = np.insert(raw, offs[some], 32)  # a space before each text that is not empty
            begins = offs[some] + np.arange(len(some))
            starts = np.union1d(begins, cuts(spaced)) if pair.cut else begins
            owner = some[np.searchsorted(begins, starts, "right") - 1]
            body = spaced.tobytes()
            pieces = [body[x:y] for x, y in zip(starts.tolist(), np.append(starts[1:], len(body)).tolist(), strict=True)] if len(starts) else []
            (ids_a, n_a), (ids_b, n_b) = known.encode(pieces, owner, n)
            column = lambda x: pa.array([x], pa.list_(pa.int64()))
            ids = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), batch.column(0))
            blob = [pa.array([pa.compress(x.astype(w).tobytes(), codec="zstd", asbytes=True)], pa.binary()) for x, w in zip((ids_a, ids_b), widths, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([part + k // SET], pa.int64()), ids, column(n_a), column(n_b), *blob], ["part", "ids", "n_a", "n_b", "a", "b"])

    return docs.select("doc_id", "text").mapInArrow(run, f"part long, ids array<{kind}>, n_a array<long>, n_b array<long>, a binary, b binary")


class Aligned:
    """The alignment of one batch: `a` and `b` are token ids, `n_a` and `n_b` how many each document has."""

    def __init__(self, pair: Pair, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray):
        self.a, self.b, self.n_a, self.n_b = a, b, n_a, n_b
        size = [np.array([len(x) for x in table], np.int64) for table in (pair.a_bytes, pair.b_bytes)]
        self.end_a, self.end_b = np.cumsum(size[0][a]), np.cumsum(size[1][b])
        total = int(self.end_a[-1]) if len(a) else 0
        first = np.append(0, np.cumsum(n_a))
        self.docs = np.append(0, self.end_a)[first]  # byte offsets of the documents
        has_a, has_b = (np.bincount(e, minlength=total + 1) for e in (self.end_a, self.end_b))
        self.upto_a, self.upto_b = np.cumsum(has_a), np.cumsum(has_b)
        self.cut = (has_a > 0) & (has_b > 0)
        self.cuts = np.cumsum(self.cut)
        self.ends = np.flatnonzero(has_a + has_b)
        self.upto = np.cumsum((has_a + has_b) > 0)

    def per_document(self, upto: np.ndarray) -> np.ndarray:
        return upto[self.docs[1:]] - upto[self.docs[:-1]]

    def links(self) -> np.ndarray:
        """A id << 32 | B id of each pair of tokens that overlap, in order."""
        a, b = self.a[self.upto_a[self.ends - 1]], self.b[self.upto_b[self.ends - 1]]
        return a.astype(np.int64) << 32 | b

    def groups(self, table: np.ndarray) -> list[bytes]:
        """Each document's groups as a1,a2|b1;a3|b2,b3."""
        at = np.flatnonzero(self.cut)
        group_a, group_b = self.cuts[self.end_a - 1], self.cuts[self.end_b - 1]
        place_a = np.arange(len(self.a)) + np.append(0, self.upto_b[at])[group_a]
        place_b = np.arange(len(self.b)) + self.upto_a[at][group_b]
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        codes[place_a] = self.a.astype(np.int64) * 4 + self.cut[self.end_a]
        codes[place_b] = self.b.astype(np.int64) * 4 + 2 * self.cut[self.end_b]
        stops = np.cumsum(self.n_a + self.n_b)
        codes[stops[(self.n_a + self.n_b) > 0] - 1] += 1
        said = table[codes].tolist()
        return [b"".join(said[x:y]) for x, y in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]


def _separated(n: int) -> np.ndarray:
    """Ids with what follows them: a comma, a bar, a semicolon or nothing."""
    out = np.empty(4 * n, object)
    out[:] = [f"{k}{s}".encode() for k in range(n) for s in (",", "|", ";", "")]
    return out


def _batches(table: pa.Table | pa.RecordBatch, pair: Pair) -> Iterator[tuple[pa.Array, Aligned]]:
    for row in range(table.num_rows):
        n_a, n_b, a, b = (table.column(k)[row] for k in ("n_a", "n_b", "a", "b"))
        n_a, n_b = (n.values.to_numpy() for n in (n_a, n_b))
        ids = []
        for packed, n, names in ((a, n_a, pair.a_bytes), (b, n_b, pair.b_bytes)):
            kind = np.dtype(np.uint16 if len(names) <= 1 << 16 else np.uint32)
            ids.append(np.frombuffer(pa.decompress(packed.as_buffer(), int(n.sum()) * kind.itemsize, codec="zstd"), kind))
        yield table.column("ids")[row].values, Aligned(pair, *ids, n_a, n_b)


def pair_counts(batches: DataFrame, folder: str, a: str, b: str) -> DataFrame:
    """(part, pair, n): links of each id pair in each set of batches; a set that two tasks read comes in two rows for a pair."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair.load(folder, a, b)
        part, held = None, {}
        for row in rows:
            for k, (_, found) in enumerate(_batches(row, pair)):
                now = row.column(0)[k].as_py()
                if held and now != part:
                    yield batch_of(part, held)
                    held = {}
                part = now
                keys, n = np.unique(found.links(), return_counts=True)
                for key, count in zip(keys.tolist(), n.tolist(), strict=True):
                    held[key] = held.get(key, 0) + count
        if held:
            yield batch_of(part, held)

    def batch_of(part: int, held: dict[int, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part] * len(held), pa.int64()), pa.array(held.keys(), pa.int64()), pa.array(held.values(), pa.int64())], ["part", "pair", "n"])

    return batches.mapInArrow(run, "part long, pair long, n long")


def align(docs: DataFrame, folder: str = FOLDER, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", groups: bool = False) -> tuple[DataFrame, DataFrame]:
    """(1) doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and if asked the groups themselves) of each document;
    (2) pair (A id << 32 | B id), n: the corpus-wide counts of linked ids."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    batches = materialise(encoded(docs, folder, a, b), "tokens")
    local = materialise(pair_counts(batches, folder, a, b), "pairs")
    counts = local.groupBy("pair").agg(F.sum("n").alias("n"))
    by_b = Window.partitionBy(F.col("pair").bitwiseAND(0xFFFFFFFF))  # as many rows as A has ids, at most
    known = counts.withColumn("best", F.col("n") == F.max("n").over(by_b))
    told = local.select("part", "pair").join(known, "pair").select("part", "pair", "n", "best")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *["groups"] * groups]

    def run(tokens: pa.Table, told: pa.Table) -> pa.Table:
        pair = Pair.load(folder, a, b)
        table = _separated(max(len(pair.a_bytes), len(pair.b_bytes)))
        keys, first = np.unique(told.column("pair").to_numpy(), return_index=True)
        count, best = (told.column(k).to_numpy()[first] for k in ("n", "best"))
        out = []
        for ids, found in _batches(tokens, pair):
            at = np.searchsorted(keys, found.links())
            sums = [np.append(0, np.cumsum(x[at].astype(np.int64)))[found.upto] for x in (best, count)]
            said = found.groups(table)
            digest = pa.array([hashlib.sha256(s).hexdigest() if s else "" for s in said], pa.string())
            columns = [found.n_a, found.n_b, *map(found.per_document, (found.cuts, found.upto, *sums))]
            more = [pa.array([s.decode() for s in said], pa.string())] if groups else []
            out.append(pa.Table.from_arrays([ids, *map(pa.array, columns), digest, *more], names))
        T.give_back()
        return pa.concat_tables(out)

    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + ", groups string" * groups
    return batches.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(run, schema), counts
