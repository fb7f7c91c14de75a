"""N-gram Jaccard self-join by universe partition and the pigeonhole principle.

A document is its set of distinct 5-word shingles, as 64-bit hashes.  If two sets reach
Jaccard similarity 3/4, they differ in at most H = floor((|x| + |y|) / 7) shingles.  Sets
are handled by size band; a band cuts the hash range into m segments.

* Exact allocation: two linked sets agree on at least m - H segments.  Every set leaves
  out its m - H - SHARED costliest segments, in one order of (frequency, signature) that all
  sets share, and indexes the subsets in the H + SHARED others; SHARED agreeing segments are
  then indexed by both sides, whatever each leaves out.
* One-deletion allocation: with m = floor(H / 2) + 1 segments, some segment differs by at
  most one shingle; a set indexes each segment's subset and each subset less one shingle.

The cheaper allocation by expected cost is taken for each band; frequencies come from a
sketch counted over all documents.  Equal sets are one class, which takes part once.  Sets
that share a signature form a block; signatures with the same members are one block.

* In blocks of at most SMALL_BLOCK sets all pairs are counted; one that shares fewer than
  SHARED signatures there is not linked, or meets again in a larger block.
* In a larger block each set is first held against a hub, the member whose signatures are the
  most common; then neighbours are.  What is left outside a block's main component is then held
  against every set of that component once, or only against those in the same blocks, whichever
  are fewer, and against the others that are left.

Candidates whose sizes and parity bitmaps allow a link are verified exactly.

Cases: null, empty and wordless texts have size 0 and no links; a text of fewer than five
words is one shingle; rows with equal doc_id are one document with the links of all its
rows; rows with null doc_id have a null component; very long texts are used whole; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import text as T
from .shared import components, materialise, release, text_batches

SHINGLE = 5
BAND_RATIO = 3
#: Signatures and the sets' keys beside them have 48 bits: chance collisions only add candidates, which are verified.
#: The low bytes of the one and the high bytes of the other are zero, which shuffles well.
SIGNATURE_BITS = ~np.uint64((1 << 16) - 1)
KEY_BITS = (1 << 48) - 1
#: Set in the signatures of one-deletion bands.
DELETION = 1 << 16
#: Segments of a band for each segment that a set has to index.
SPREAD = 1.5
SLOT_BITS = 20
#: Signatures that two linked sets share at least; one of the one-deletion allocation counts for all of them.
SHARED = 3
#: Members of a block in which all pairs are counted.
SMALL_BLOCK = 4
#: Rounds in which neighbours in a block are held against each other before all pairs are.
CHAINS = 1
#: Ids in a broadcast set; beyond it the ids are joined by shuffle.
BROADCAST_IDS = 1_000_000

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def largest_partner(size: np.ndarray | int) -> np.ndarray | int:
    return size * 4 // 3


def most_different(a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | int:
    """H: the largest symmetric difference of linked sets of these sizes."""
    return (a + b) // 7


@dataclass(frozen=True)
class Band:
    low: int
    high: int
    segments: int
    deletions: bool


def band(low: int, high: int) -> Band:
    """The cheaper of the two allocations for sets of low to high shingles."""
    worst = int(most_different(high, largest_partner(high)))
    exact, deleted = int(SPREAD * (worst + 1)) + 1, worst // 2 + 1
    # expected cost of a set of middle size: signatures to move, and much more for those that tell
    # little, of which there are as many as the set has too few filled segments
    size = (low + high) / 2
    need = most_different(int(size), largest_partner(int(size))) + 1
    filled = exact * (1 - (1 - 1 / exact) ** size)
    poor = max(0.0, need - filled + 2 * (filled * (1 - filled / exact)) ** 0.5)
    cost_exact = need + 64 * poor
    cost_deleted = deleted + size + 64 * deleted * (1 - 1 / deleted) ** (size - 1)
    return Band(low, high, deleted, True) if cost_deleted < cost_exact else Band(low, high, exact, False)


def bands(largest: int) -> list[Band]:
    """Bands from 3 shingles on; sets of one or two are linked with equal ones only."""
    out, low = [], 3
    while low <= largest:
        high = low + 1 if low == 3 else low * BAND_RATIO
        out.append(band(low, high))
        low = high + 1
    return out


def shingles(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted inside each document, and their n+1 offsets."""
    docs = len(offs) - 1
    hashes, doc, _, _ = T.word_hashes(raw, offs, T.NONSPACE)
    first = T.segment_ids(doc, docs)
    n = np.diff(first)
    total = np.zeros(len(hashes), np.uint64)
    for k in range(SHINGLE):
        shifted = np.zeros(len(hashes), np.uint64)
        shifted[: len(hashes) - k] = hashes[k:] * _MULTIPLIERS[k]
        inside = np.arange(len(hashes)) - first[doc] + k < n[doc]
        total += np.where(inside, shifted, 0)
    place = np.arange(len(hashes)) - first[doc]
    keep = place <= np.maximum(n[doc] - SHINGLE, 0)
    h, doc = T.mix(total[keep] + np.minimum(n, SHINGLE).astype(np.uint64)[doc[keep]]), doc[keep]
    by = np.lexsort((h, doc))
    h, doc = h[by], doc[by]
    new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])) if len(h) else np.zeros(0, bool)
    return h[new], T.segment_ids(doc[new], docs)


def identity(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each set."""
    out = []
    for salt in (0x51ED270B7F4A7C15, 0x2545F4914F6CDD1D):
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(T.mix(h ^ np.uint64(salt)), out=sums[1:])
        out.append(T.mix(sums[first[1:]] - sums[first[:-1]]).view(np.int64))
    return out[0], out[1]


def parity(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bitmap of each set as 64-bit words, with the offsets of each: bit b is the parity of the number of its
    hashes that fall on b.  The width is a power of two, at least four times the set's size."""
    n = np.diff(first)
    width = 64 << np.maximum(0, np.ceil(np.log2(np.maximum(4 * n, 64) / 64))).astype(np.int64)
    begin = np.cumsum(width) - width
    at = np.repeat(begin, n) + (h & np.repeat(width - 1, n).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(at, minlength=int(width.sum())) & 1).astype(bool)
    return np.packbits(odd, bitorder="little").view(np.int64), np.append(begin, width.sum()) // 64


FACTS = "doc_id long, n long, c1 long, c2 long, bits array<long>, slot int"


def describe(docs: DataFrame) -> DataFrame:
    """A row for each document, and rows with a slot (and its count in n) for slots of the frequency sketch
    that are well above a task's mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "c1", "c2", "bits", "slot"]
        sketch = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in T.chunks(batches):
            h, first = shingles(*T.flatten(batch.column(1)))
            sketch += np.bincount((h >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=len(sketch))
            c1, c2 = identity(h, first)
            bits, begin = parity(h, first)
            lists = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(bits))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first).astype(np.int64)), pa.array(c1), pa.array(c2), lists, pa.nulls(len(c1), pa.int32())], names)
        heavy = np.flatnonzero(sketch > 8 + 4 * sketch.mean())
        if len(heavy):
            none = pa.nulls(len(heavy), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(sketch[heavy]), none, none, pa.nulls(len(heavy), pa.list_(pa.int64())), pa.array(heavy.astype(np.int32))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FACTS)


class Signer:
    """The signatures of sets under a list of bands and a table of slot frequencies."""

    def __init__(self, plan: list[Band], slots: np.ndarray, counts: np.ndarray):
        self.plan = plan
        self.frequency = np.zeros(1 << SLOT_BITS, np.int64)
        self.frequency[slots] = counts
        self.lows = np.array([b.low for b in plan])

    def sign(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(signature, number of the set) of everything the sets index; those of one-deletion bands have DELETION set."""
        n = np.diff(first)
        own = np.searchsorted(self.lows, n, "right") - 1
        parts = []
        for k, b in enumerate(self.plan):
            for shift in (0, 1):  # the sets of the band, and the larger ones that reach into it
                sets = np.flatnonzero((own == k + shift) & ((shift == 0) | (n * 3 <= b.high * 4)))
                if len(sets):
                    most = np.where(shift == 0, most_different(n[sets], largest_partner(n[sets])), most_different(n[sets], b.high))
                    parts.append(self._band(h, first, sets, most, k, b))
        if not parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _band(self, h: np.ndarray, first: np.ndarray, sets: np.ndarray, most: np.ndarray, k: int, b: Band) -> tuple[np.ndarray, np.ndarray]:
        n = np.diff(first)[sets]
        begin = np.cumsum(n) - n
        at = np.repeat(first[sets] - begin, n) + np.arange(n.sum())
        mine, who = h[at], np.repeat(np.arange(len(sets)), n)
        segment = ((mine >> np.uint64(32)) * np.uint64(b.segments) >> np.uint64(32)).astype(np.int64)
        cell = who * b.segments + segment
        head = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        value = T.mix(mine + np.uint64(k * 2 + 1))
        sums = np.add.reduceat(value, head)
        sizes = np.diff(np.append(head, len(cell)))
        salt = T.mix((segment[head] + (k << 32)).astype(np.uint64))
        if b.deletions:
            less = np.repeat(sums, sizes) - value
            everything = np.concatenate([T.mix(sums + salt), T.mix(less + np.repeat(salt, sizes))])
            owner = np.concatenate([who[head], who])
            # a segment that is empty here may hold one shingle on the other side
            blank = np.ones((len(sets), b.segments), bool)
            blank[who[head], segment[head]] = False
            row, col = np.nonzero(blank)
            everything = np.concatenate([everything, T.mix(T.mix((col + (k << 32)).astype(np.uint64)))])
            owner = np.concatenate([owner, row])
            pair = np.unique(np.stack([owner.astype(np.uint64), (everything & SIGNATURE_BITS) | np.uint64(DELETION)], 1), axis=0)
            return pair[:, 1], sets[pair[:, 0].astype(np.int64)]
        signature = T.mix(sums + salt)
        slot = (mine >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        cost = np.minimum.reduceat(self.frequency[slot], head)
        owner = who[head]
        by = np.lexsort((signature, cost, owner))
        owner = owner[by]
        start = T.segment_ids(owner, len(sets))
        rank = np.arange(len(owner)) - start[owner]
        keep = rank < most[owner] + SHARED
        signature, owner = signature[by][keep], owner[keep]
        short = np.maximum(most + SHARED - np.diff(start), 0)
        if short.any():  # empty segments are the costliest; take as many as are still needed
            blank = np.ones((len(sets), b.segments), bool)
            blank[who[head], segment[head]] = False
            row, col = np.nonzero(blank)
            order = np.arange(len(row)) - T.segment_ids(row, len(sets))[row]
            row, col = row[order < short[row]], col[order < short[row]]
            signature = np.concatenate([signature, T.mix(T.mix((col + (k << 32)).astype(np.uint64)))])
            owner = np.concatenate([owner, row])
        return signature & SIGNATURE_BITS & ~np.uint64(DELETION), sets[owner]


def signatures(docs: DataFrame, signer: Signer) -> DataFrame:
    """(sig, key) of all sets; a task passes equal sets on once."""
    shipped = docs.sparkSession.sparkContext.broadcast(signer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in T.chunks(batches):
            h, first = shingles(*T.flatten(batch.column(0)))
            c1, _ = identity(h, first)
            fresh = []
            for k, c in enumerate(c1.tolist()):
                if c not in seen:
                    seen.add(c)
                    fresh.append(k)
            fresh = np.array(fresh, np.int64)
            n = np.diff(first)[fresh]
            at = np.repeat(first[fresh] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            sig, which = shipped.value.sign(h[at], np.append(0, np.cumsum(n)))
            yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array((c1[fresh] & KEY_BITS)[which])], ["sig", "key"])

    return docs.select("text").mapInArrow(run, "sig long, key long")


def shingle_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, c1, items) of the documents in `ids`: their sorted shingle hashes as bytes."""
    few = ids.count() <= BROADCAST_IDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.chunks(batches):
            h, first = shingles(*T.flatten(batch.column(1)))
            c1, _ = identity(h, first)
            raw = h.tobytes()
            items = [raw[8 * a : 8 * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(c1), pa.array(items, pa.binary())], ["id", "c1", "items"])

    picked = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(ids) if few else ids, "id", "left_semi")
    return picked.mapInArrow(run, "id long, c1 long, items binary")


def verify(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of pairs (a, a1, b, b1) of representatives and their classes, those that are linked."""
    ids = materialise(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "ids")
    sets = shingle_sets(docs, ids)
    left = sets.select(F.col("id").alias("a"), F.col("c1").alias("a1"), F.col("items").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("c1").alias("b1"), F.col("items").alias("y"))
    joined = pairs.join(left, ["a", "a1"]).join(right, ["b", "b1"]).select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= 75 * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, "a long, b long").distinct()


def _may_link(p: str, q: str) -> Column:
    """Sizes and parity bitmaps allow similarity 3/4: the bitmaps differ in no more bits than the sets in shingles.

    Sizes that pass are so close that the wider bitmap, if any, is folded once."""
    sizes = (F.col(f"{p}n") * 4 >= F.col(f"{q}n") * 3) & (F.col(f"{q}n") * 4 >= F.col(f"{p}n") * 3)
    x, y = F.col(f"{p}bits"), F.col(f"{q}bits")
    xor = lambda a, b: a.bitwiseXOR(b)
    half = lambda a: (F.size(a) / 2).cast("int")
    fold = lambda a: F.zip_with(F.slice(a, F.lit(1), half(a)), F.slice(a, half(a) + 1, half(a)), xor)
    left = F.when(F.size(x) > F.size(y), fold(x)).otherwise(x)
    right = F.when(F.size(y) > F.size(x), fold(y)).otherwise(y)
    bits = F.aggregate(F.zip_with(left, right, xor), F.lit(0), lambda acc, w: acc + F.bit_count(w))
    return F.when(sizes, bits * 7 <= F.col(f"{p}n") + F.col(f"{q}n")).otherwise(F.lit(False))


def frequent_slots(facts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The sketch's slots with the largest counts; at most 2**16 come to the driver."""
    top = facts.filter("slot is not null").groupBy("slot").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "slot").limit(1 << 16).toArrow()
    return top["slot"].to_numpy().astype(np.int64), top["n"].to_numpy()


def link(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facts of the documents, classes of equal sets with their representative `id`, and (v, root) of the
    representatives that are linked."""
    spark: SparkSession = docs.sparkSession
    text_batches(spark)
    facts = materialise(describe(docs), "facts")
    rows = facts.filter("slot is null")
    classes = materialise(
        rows.filter("n > 0 and doc_id is not null").groupBy("c1", "c2", "n").agg(F.min("doc_id").alias("id"), F.first("bits").alias("bits")),
        "classes",
    ).withColumn("key", F.col("c1").bitwiseAND(F.lit(KEY_BITS)))
    largest = rows.agg(F.max("n")).first()[0] or 0
    release(spark)
    blocks = materialise(shared_blocks(signatures(docs, Signer(bands(largest), *frequent_slots(facts)))), "blocks")
    release(spark)
    large = blocks.filter(F.col("k") > SMALL_BLOCK)
    first = small_pairs(blocks.filter(F.col("k") <= SMALL_BLOCK)).unionByName(hub_pairs(large)).distinct()
    named = lambda p: classes.select(F.col("key").alias(f"{p}0"), F.col("c1").alias(f"{p}1"), F.col("n").alias(f"{p}n"))
    met = first.join(named("a"), "a0").join(named("b"), "b0").filter((F.col("an") * 4 >= F.col("bn") * 3) & (F.col("bn") * 4 >= F.col("an") * 3))
    asked = materialise(met.select(F.least("a1", "b1").alias("a1"), F.greatest("a1", "b1").alias("b1")).distinct(), "asked")
    links = materialise(verify(docs, _probable(asked, classes)), "links")
    release(spark)
    # most of a large group is connected by holding neighbours in a random order against each other
    known = components(links)
    for turn in range(CHAINS):
        more = materialise(_neighbours(_placed(large, classes, known), turn).join(asked, ["a1", "b1"], "left_anti"), "asked")
        known = components(materialise(verify(docs, _probable(more, classes)), "links"), known)
        asked = asked.unionByName(more)
        release(spark)
    # the rest: every pair in a large block that is not connected yet; in small ones all pairs have been counted
    placed = materialise(_placed(large, classes, known), "placed")
    rest = materialise(_open_pairs(placed, classes, known).join(asked, ["a1", "b1"], "left_anti"), "rest")
    if rest.limit(1).count():
        known = components(materialise(verify(docs, rest), "links"), known)
    return rows, classes, known


def _open_pairs(placed: DataFrame, classes: DataFrame, known: DataFrame) -> DataFrame:
    """(a, a1, b, b1) that share a block, are not connected and may be linked."""
    counts = placed.groupBy("block", "root").agg(F.count("*").alias("members"))
    main = counts.groupBy("block").agg(F.max_by(F.struct("root", "members"), F.struct("members", "root")).alias("main"), F.count("*").alias("roots"))
    shut = placed.join(main.filter("roots > 1").select("block", F.col("main.root").alias("main"), "main.members"), "block")
    left = materialise(shut.filter("root <> main"), "left")
    # each set that is left, with each main component it meets: the component's size against its members in shared blocks
    everyone = classes.select("id", "c1", "n", "bits").join(known.withColumnRenamed("v", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    sizes = everyone.groupBy(F.col("root").alias("main")).agg(F.count("*").alias("size"), F.min("n").alias("least"), F.max("n").alias("most"))
    met = left.groupBy("id", "c1", "n", "main").agg(F.sum("members").alias("near")).join(sizes, "main")
    met = met.filter((F.col("n") * 3 <= F.col("most") * 4) & (F.col("n") * 4 >= F.col("least") * 3))
    met = materialise(met.withColumn("whole", F.col("size") <= F.col("near")), "met")
    cast = lambda df, p: df.select(*[F.col(c).alias(p + s) for c, s in (("id", ""), ("c1", "1"), ("n", "n"), ("bits", "bits"))], *[c for c in df.columns if c not in ("id", "c1", "n", "bits")])
    bits = classes.select("id", "c1", "bits")
    a = cast(met.filter("whole").select("id", "c1", "n", "main").join(bits, ["id", "c1"]), "a")
    b = cast(everyone, "b")
    names = ["a", "a1", "b", "b1"]
    apart = a.join(b, (F.col("main") == F.col("root")) & _may_link("a", "b")).select(*names)
    # where the component is the larger: its members in the block; and those that are left among themselves
    wide = left.join(met.filter("not whole").select("id", "c1", "main"), ["id", "c1", "main"], "left_semi").select("block", "id", "c1", "n")
    inside = placed.join(main.select("block", F.col("main.root").alias("root")), ["block", "root"]).join(wide.select("block").distinct(), "block", "left_semi").select("block", "id", "c1", "n")
    tell = lambda df, p: cast(df.join(bits, ["id", "c1"]), p)
    several = left.groupBy("block").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("block")
    told = left.select("block", "id", "c1", "n", "root").join(several, "block", "left_semi").join(bits, ["id", "c1"])
    side = lambda p: told.select(*[F.col(c).alias(f"{p}{s}") for c, s in (("block", "block"), ("id", ""), ("c1", "1"), ("n", "n"), ("bits", "bits"), ("root", "root"))])
    among = side("a").join(side("b"), (F.col("ablock") == F.col("bblock")) & (F.col("aroot") < F.col("broot")) & _may_link("a", "b")).select(*names)
    within = tell(wide, "a").join(tell(inside, "b").withColumnRenamed("block", "bblock"), (F.col("block") == F.col("bblock")) & _may_link("a", "b")).select(*names)
    rest = apart.unionByName(among).unionByName(within)
    ordered = [F.when(F.col("a1") < F.col("b1"), F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("a", "b"), ("a1", "b1"), ("b", "a"), ("b1", "a1"))]
    return rest.select(*ordered).distinct()


def shared_blocks(signed: DataFrame) -> DataFrame:
    """(block, k, key, m): the members of blocks, at most k of them, and the signatures they have in the block;
    sets that share too few in all of their blocks are left out."""
    group = Window.partitionBy("sig")
    member = F.shiftright(F.xxhash64("key"), 16)
    shared = signed.select("sig", "key", F.count("*").over(group).alias("k"), F.try_sum(member).over(group).alias("sum"), F.min("key").over(group).alias("lo"), F.max("key").over(group).alias("hi"))
    weight = F.when(F.col("sig").bitwiseAND(F.lit(DELETION)) != 0, SHARED).otherwise(1)
    named = shared.filter("lo < hi").select(F.coalesce(F.xxhash64("k", "sum"), "sig").alias("block"), "k", "key", weight.alias("m"))
    blocks = materialise(named.groupBy("block", "k", "key").agg(F.sum("m").alias("m")), "members")
    enough = blocks.groupBy("key").agg(F.sum("m").alias("all")).filter(F.col("all") >= SHARED).select("key")
    return blocks.join(enough, "key", "left_semi")


def small_pairs(blocks: DataFrame) -> DataFrame:
    """(a0, b0) of keys that share SHARED signatures in blocks of at most SMALL_BLOCK members."""
    sets = blocks.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("key", "m"))).alias("sets"))
    after = lambda i: F.slice("sets", i + 2, SMALL_BLOCK)
    both = F.flatten(F.transform("sets", lambda x, i: F.transform(after(i), lambda y: F.struct(x["key"].alias("a0"), y["key"].alias("b0"), F.least(x["m"], y["m"]).alias("m")))))
    pairs = sets.select(F.explode(both).alias("p")).select("p.*")
    return pairs.groupBy("a0", "b0").agg(F.sum("m").alias("m")).filter(F.col("m") >= SHARED).select("a0", "b0")


def hub_pairs(blocks: DataFrame) -> DataFrame:
    """(a0, b0) of keys: each set with the hub it shares most signatures with; a block's hub is its member whose signatures
    have the most members."""
    common = blocks.groupBy("key").agg(F.sum(F.col("m").cast("double") * F.col("k")).alias("weight"))
    hubs = blocks.select("block", "key").join(common, "key").groupBy("block").agg(F.max_by("key", F.struct("weight", "key")).alias("hub"))
    met = blocks.join(hubs, "block").filter("key <> hub").groupBy("key", "hub").agg(F.sum("m").alias("m"))
    own = met.groupBy("key").agg(F.max_by("hub", F.struct("m", "hub")).alias("hub"))
    return own.select(F.least("key", "hub").alias("a0"), F.greatest("key", "hub").alias("b0"))


def _probable(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, a1, b, b1) of the pairs (a1, b1) whose sizes and bitmaps allow a link."""
    facts_of = lambda p, *more: classes.select(F.col("c1").alias(f"{p}1"), F.col("id").alias(p), F.col("n").alias(f"{p}n"), *[F.col(c).alias(f"{p}{c}") for c in more])
    sized = pairs.select("a1", "b1").join(facts_of("a"), "a1").join(facts_of("b"), "b1")
    sized = sized.filter((F.col("an") * 4 >= F.col("bn") * 3) & (F.col("bn") * 4 >= F.col("an") * 3)).select("a", "a1", "b", "b1")
    met = sized.join(facts_of("a", "bits"), ["a", "a1"]).join(facts_of("b", "bits"), ["b", "b1"])
    return materialise(met.filter(_may_link("a", "b")).select("a", "a1", "b", "b1"), "pairs")


def _placed(blocks: DataFrame, classes: DataFrame, known: DataFrame) -> DataFrame:
    """(block, c1, id, n, root): the members of blocks with their class and its root in `known` (v, root)."""
    members = blocks.select("block", "key").join(classes.select("key", "c1", "id", "n"), "key").drop("key")
    return members.join(known.withColumnRenamed("v", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))


def _neighbours(placed: DataFrame, turn: int) -> DataFrame:
    """Pairs that follow each other in a block, in a random order of the turn, and are not connected yet."""
    w = Window.partitionBy("block").orderBy(F.xxhash64("id", F.lit(turn)), "id", "c1")
    both = placed.select("c1", "root", F.lag("c1").over(w).alias("c0"), F.lag("root").over(w).alias("root0")).filter("root <> root0 and c0 <> c1")
    return both.select(F.least("c0", "c1").alias("a1"), F.greatest("c0", "c1").alias("b1")).distinct()


def join_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each document: the smallest doc_id that links reach."""
    rows, classes, roots = link(docs)
    ids = classes.join(roots.withColumnRenamed("v", "id"), "id", "left").select("c1", "c2", "n", F.coalesce("root", "id").alias("root"))
    out = rows.join(ids, ["c1", "c2", "n"], "left")
    # rows with equal doc_id are one document
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"))
    return out


def keep_one(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each component: the document that gives it its name."""
    parts = materialise(join_components(docs), "components")
    losers = materialise(parts.filter("component_id <> doc_id").select("doc_id").distinct(), "losers")
    few = losers.count() <= BROADCAST_IDS
    out = docs.join(F.broadcast(losers) if few else losers, "doc_id", "left_anti").select(*docs.columns)
    n, distinct = parts.agg(F.count("doc_id"), F.countDistinct("doc_id")).first()
    if n > distinct:
        alone = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
        out = out.withColumn("__tm_alone", alone).dropDuplicates(["doc_id", "__tm_alone"]).drop("__tm_alone")
    return out
