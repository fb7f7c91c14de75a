"""Sharding by weighted rendezvous hashing.

Every (record key, shard) pair has a uniform number u from a hash; a record goes to the
shard with the least -ln(u) / weight.  A shard's share is in proportion to its weight, a
record's place depends on its key and the shards only, and one more shard takes records
only into itself, because the other shards' numbers stay as they are.

Cases: a null key hashes as the empty string; a null text has size 8 and checksum 0;
repeated rows go to the same shard and take a slot each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mixing import arranged, mix
from .shared import materialise, numbered

SHARDS = 24


def costs(key: Column, weights: Sequence[float]) -> Column:
    """-ln(u) / weight for each shard, u from the first 52 bits of md5(key#shard)."""

    def one(shard: int, weight: float) -> Column:
        digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f"#{shard}")))
        u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
        return -F.log(u) / F.lit(float(weight))

    return F.array(*[one(k, w) for k, w in enumerate(weights)])


def least(cost: Column, n: int) -> Column:
    first = F.slice(cost, 1, n)
    return (F.array_position(first, F.array_min(first)) - 1).cast("int")


def with_shards(docs: DataFrame, n: int = SHARDS, weights: Sequence[float] | None = None, key: str = "doc_id", grown: bool = True, prefix: str = "") -> DataFrame:
    """`docs` with columns shard and, if asked, grown_shard (as with one more shard of weight 1)."""
    weights = list(weights or [1.0] * n)
    if len(weights) != n:
        raise ValueError("one weight for each shard is needed")
    out = docs.withColumn("__tm_cost", costs(F.col(key), [*weights, 1.0]))
    out = out.withColumn(f"{prefix}shard", least(F.col("__tm_cost"), n))
    if grown:
        out = out.withColumn(f"{prefix}grown_shard", least(F.col("__tm_cost"), n + 1))
    return out.drop("__tm_cost")


def assign(docs: DataFrame, n: int = SHARDS, weights: Sequence[float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each document; no text is moved."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    placed = materialise(with_shards(narrow, n, weights), "placed")
    return numbered(placed, "shard", ["doc_id", "text_crc32", "size"], "slot").withColumn("law", F.lit("key"))


def in_shards(docs: DataFrame, mixture: Mapping[str | None, float] | None = None, rest: float = 1.0, n: int = SHARDS, weights: Sequence[float] | None = None, slot: bool = True, rows_per_part: int = 5000) -> DataFrame:
    """`docs` with columns shard and, if asked, slot, sorted by both; slot is the row's place in its shard, gapless from 0,
    in the order of the mixture of the sources, which is worked out here and not taken from the order of the input."""
    places = materialise(with_shards(mix(docs, mixture, rest).select("doc_id", "tie", "position"), n, weights, grown=False), "places")
    sizes = {r["shard"]: r["n"] for r in places.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    before = F.array(*[F.lit(sum(sizes.get(j, 0) for j in range(k))).cast("long") for k in range(n)])
    slots = numbered(places, "shard", ["position"], "slot").withColumn("place", F.get(before, F.col("shard")) + F.col("slot"))
    return arranged(docs, slots, ["shard", "slot"] if slot else ["shard"], rows_per_part)


def write_shards(docs: DataFrame, path: str, n: int = SHARDS, weights: Sequence[float] | None = None) -> None:
    """Write documents below path/shard=k/, every task straight to the shards of its rows."""
    with_shards(docs, n, weights, grown=False).write.partitionBy("shard").parquet(path)
