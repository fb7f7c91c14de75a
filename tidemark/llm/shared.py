"""Session-level helpers: shared scratch tables, distributed row numbers, connected components."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which every executor and the driver share.

    The session's setting is read; only where it is unset (as in tests) a folder is set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = "/tmp/checkpoints"
    return f"{root.rstrip('/')}/tm-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "t") -> DataFrame:
    """Write `df` to the shared folder and read it again: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the scratch folder of a materialised frame that nothing reads any more; other folders stay."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 2)[0] for f in df.inputFiles()}:
        if not folder.rsplit("/", 1)[-1].startswith("tm-"):
            continue
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow carry at most so many rows at once from here on in this session: rows hold whole texts, and a batch is
    held several times on both sides of a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "0")) <= rows:
        spark.conf.set(key, str(rows))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that are no longer referenced."""
    for _ in range(2):  # the driver's references go first, then what they held in the JVM
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def numbered(df: DataFrame, group: str, order: list[str], name: str, per_task: int = 100_000) -> DataFrame:
    """Add `name`: gapless row numbers from 0 inside each group, in the order given.

    A group may hold any share of the rows: rows are dealt by ranges of (group, order), so
    that a large group spans many parts; each part is numbered alone and shifted by the
    sizes of its group's earlier parts.  `df` should be narrow: it is written once to the
    shared folder, which also keeps the parts the same if a task runs again.
    """
    parts = max(32, -(-df.count() // per_task))
    dealt = materialise(df.repartitionByRange(parts, group, *order).withColumn("__tm_part", F.spark_partition_id()), "dealt")
    sizes = dealt.groupBy(group, "__tm_part").agg(F.count("*").alias("__tm_n"))
    before = Window.partitionBy(group).orderBy("__tm_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(
        F.col(group).alias("__tm_g"),
        F.col("__tm_part").alias("__tm_p"),
        F.coalesce(F.sum("__tm_n").over(before), F.lit(0)).alias("__tm_shift"),
    )
    rank = F.row_number().over(Window.partitionBy(group, "__tm_part").orderBy(*order)) - 1
    match = F.col(group).eqNullSafe(F.col("__tm_g")) & (F.col("__tm_part") == F.col("__tm_p"))
    return (
        dealt.withColumn("__tm_rank", rank)
        .join(shifts, match)
        .withColumn(name, (F.col("__tm_rank") + F.col("__tm_shift")).cast("long"))
        .drop("__tm_part", "__tm_rank", "__tm_shift", "__tm_g", "__tm_p")
    )


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(v, root): the smallest vertex reachable from each vertex of edges (a, b); with `known`, an earlier
    result of this function, by those edges and by the ones that it came from.

    Alternates the large-star and small-star contractions until only stars are left; each
    round is a few shuffles of at most as many edges as before, and each round's edges go to
    the shared folder, where they take the place of the round before.  A hub's smallest neighbour
    is found with a map-side min(); its edges meet it in a join that Spark may split.
    """
    if known is not None:
        edges = edges.select("a", "b").unionByName(known.select(F.col("v").alias("a"), F.col("root").alias("b")))
    now = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _only_stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m")).join(large, "a")
        after = small.select("a", F.col("m").alias("b")).unionByName(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        after = materialise(after, "edges")
        discard(now)
        now = after
    return now.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())


def _only_stars(edges: DataFrame) -> bool:
    """Whether distinct edges (a, b) with a > b are stars: each vertex has one smaller neighbour, or only larger ones."""
    end = lambda v, up: edges.select(F.col(v).alias("v"), F.lit(up).alias("up"))
    ends = end("a", 1).unionByName(end("b", 0)).groupBy("v").agg(F.sum("up").alias("smaller"), F.min("up").alias("least"))
    return ends.filter("smaller > 1 or (smaller = 1 and least = 0)").agg(F.count("*")).first()[0] == 0
