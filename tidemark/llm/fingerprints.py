"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

The terms of a text are its lower-cased words, weighted by their counts.  For every seed,
a term with weight S gets r, c from Gamma(2, 1) and b from U(0, 1), all from hashes of
(term, seed); t = floor(ln S / r + b) and the cost ln c - r (t - b + 1).  The seed's
sample is the (term, t) of least cost, and two texts have the same sample with a
probability equal to their generalised Jaccard similarity.  A fingerprint is 8 hex digits
for each seed; the likeness of two is the share of equal samples.

Text is moved once: to buckets of neighbouring doc_ids, in which the next document is at
hand.  Counting terms, sampling and comparing then need no further exchange.

Cases: null text is empty; a text without words has the fingerprint of the empty set,
which is like itself only; equal texts have equal fingerprints; rows with equal doc_id
follow each other by text; a null doc_id sorts below all others; one row alone is its own
next document; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEEDS = 32
#: Seeds worked out together in one row.
LANES = 8
DOCS_PER_TASK = 2500
BUCKETS_PER_TASK = 8
KNOTS = 64
LOWEST = -(1 << 63)
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
EMPTY = (1 << 31) - 1


def samples(term: Column, seed: Column, weights: list[Column]) -> list[Column]:
    """For each weight (null: absent) a long that is least for the sampled term: cost above, sample below."""
    h1 = F.xxhash64(term, seed)
    h2 = F.xxhash64(h1)
    h3 = F.xxhash64(h2)
    high = lambda h: (F.shiftrightunsigned(h, 32) + 0.5) / 4294967296.0
    low = lambda h: (h.bitwiseAND(F.lit(0xFFFFFFFF)) + 0.5) / 4294967296.0
    r = -F.log(high(h1) * low(h1))
    log_c = F.log(-F.log(high(h2) * low(h2)))
    b = high(h3)
    out = []
    for w in weights:
        t = F.floor(F.log(w) / r + b)
        cost = log_c - r * (t - b + 1)
        name = F.xxhash64(h1, t).bitwiseAND(F.lit(EMPTY))
        out.append(F.shiftleft(((cost + 64) * F.lit(float(1 << 25))).cast("long"), 31).bitwiseOR(name))
    return out


def likeness(a: Column, b: Column, seeds: int = SEEDS) -> Column:
    """Share of equal samples of two fingerprints."""
    same = F.lit(0)
    for k in range(seeds):
        same = same + (F.substring(a, 8 * k + 1, 8) == F.substring(b, 8 * k + 1, 8)).cast("int")
    return same / F.lit(float(seeds))


def bucket_of(order: Column, knots: list[int], parts: int) -> Column:
    """A number that grows with `order` and has about as many rows for each value: knots are
    quantiles, and the range between two knots is split into equal parts."""
    out = F.lit(-1)
    for lo, hi in zip(knots, knots[1:], strict=False):
        k = knots.index(lo)
        inside = F.floor((order.cast("double") - float(lo)) / float(max(1, hi - lo)) * parts)
        out = F.when(order >= lo, F.least(inside, F.lit(parts - 1)) + k * parts).otherwise(out)
    return out.cast("int")


def with_next(docs: DataFrame) -> DataFrame:
    """Each document with its text and that of the next one by descending doc_id (after the last:
    the first), in rows (bucket, row, home, key, text, next_text); rows with home = 0 only close a bucket."""
    spark = docs.sparkSession
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    total, knots = keyed.agg(F.count("*"), F.percentile_approx("key", [k / KNOTS for k in range(KNOTS + 1)], 10_000)).first()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // DOCS_PER_TASK))
    knots = sorted(set(knots or [0]))
    if len(knots) == 1:
        knots.append(knots[0] + 1)
    parts = -(-tasks * BUCKETS_PER_TASK // (len(knots) - 1))
    held = keyed.withColumn("bucket", bucket_of(F.col("key"), knots, parts))
    # the first document of each bucket (at most tasks * BUCKETS_PER_TASK + KNOTS rows) closes the one before
    firsts = sorted(((r["bucket"], r["key"]) for r in held.groupBy("bucket").agg(F.max("key").alias("key")).toLocalIterator()), reverse=True)
    closes = [(a[0], b[1]) for a, b in zip(firsts, firsts[1:] + firsts[:1], strict=True)]
    closers = spark.createDataFrame(closes, "bucket int, closer long") if closes else spark.createDataFrame([], "bucket int, closer long")
    copies = keyed.join(F.broadcast(closers), F.col("key") == F.col("closer")).select("key", "text", "bucket", F.lit(0).alias("home"))
    rows = held.withColumn("home", F.lit(1)).unionByName(copies).repartition(tasks, "bucket")
    w = Window.partitionBy("bucket").orderBy(F.desc("home"), F.desc("key"), "text")
    return rows.select("bucket", F.row_number().over(w).alias("row"), "home", "key", "text", F.lead("text").over(w).alias("next_text"))


def fingerprint(docs: DataFrame, seeds: int = SEEDS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each document.

    The edited text has its last third replaced by as many code points from the start of the next text.
    """
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    both = with_next(docs).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - third), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), third)))
    digest = F.sha2("edited", 256)
    quarters = [F.conv(F.substring(digest, 16 * k + 1, 16), 16, -10).cast("long").alias(f"sha{k}") for k in range(4)]
    facts = ["home", "key", "n_chars", *[f"sha{k}" for k in range(4)]]
    sides = both.select("bucket", "row", "home", "key", n.cast("long").alias("n_chars"), *quarters, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("body")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("body")))).alias("s"))
    words = sides.select("bucket", "row", *facts, F.col("s.side").alias("side"), F.explode(F.split(F.lower("s.body"), NOT_WORD)).alias("word"))
    real = F.col("word") != ""
    counted = words.groupBy("bucket", "row", F.when(real, F.xxhash64("word")).alias("term")).agg(
        F.sum(F.when(real & (F.col("side") == 0), 1).otherwise(0)).alias("n0"),
        F.sum(F.when(real & (F.col("side") == 1), 1).otherwise(0)).alias("n1"),
        *[F.max(k).alias(k) for k in facts],
    )
    weights = [F.when(F.col(k) > 0, F.col(k)) for k in ("n0", "n1")]
    lanes = counted.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(seeds // LANES - 1))))
    picks = []
    for lane in range(LANES):
        for side, pick in enumerate(samples(F.col("term"), F.col("group") * LANES + lane, weights)):
            picks.append(F.min(pick).alias(f"p{side}_{lane}"))
    sampled = lanes.groupBy("bucket", "row", "group").agg(*picks, *[F.max(k).alias(k) for k in facts])
    hexed = lambda c: F.lower(F.lpad(F.hex(F.coalesce(F.col(c), F.lit(EMPTY)).bitwiseAND(F.lit(EMPTY))), 8, "0"))
    pieces = sampled.withColumns({f"f{side}": F.concat(*[hexed(f"p{side}_{lane}") for lane in range(LANES)]) for side in (0, 1)})
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("group", c))), lambda x: x[c]), "")
    prints = pieces.groupBy("bucket", "row").agg(joined("f0").alias("fingerprint"), joined("f1").alias("edited_fingerprint"), *[F.max(k).alias(k) for k in facts])
    w = Window.partitionBy("bucket").orderBy("row")
    out = prints.withColumn("next_fingerprint", F.lead("fingerprint").over(w)).filter("home = 1")
    return out.select(
        F.when(F.col("key") != LOWEST, F.col("key")).alias("doc_id"),
        "n_chars",
        F.lower(F.concat(*[F.lpad(F.hex(f"sha{k}"), 16, "0") for k in range(4)])).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), seeds).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint"), seeds).alias("near_next"),
    )
