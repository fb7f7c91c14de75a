"""Tables of shards that are published as a whole: staged writes, manifests, resumption and verification.

    root/data/run=<id>/<key>=<value>/...   what each run wrote
    root/manifests/<number>/               one row for each shard: its run, rows, signature, status, config hash

A run writes below a folder of its own, reads it back to sign each shard, writes the next
manifest beside the others and gives it its number by one rename; until then readers see the
manifest before, whose folders no run touches.  A run that dies leaves a folder that no manifest
names.  The next run does the jobs that the manifest does not have, wave by wave, so that
what was published stays done.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class StaleConfig(ValueError):
    """The table was made under another configuration."""


class Damaged(ValueError):
    """Shards whose contents are not what was signed."""


def config_hash(config: Mapping) -> str:
    """Of a nested configuration, whatever the order of its keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def row_hash(columns: Sequence[str]) -> list[Column]:
    """Two 64-bit hashes of a row; nulls are told from any value and from their neighbours."""
    cells = [e for c in sorted(columns) for e in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    return [F.xxhash64(*cells), F.xxhash64(F.lit(1), *cells)]


def signature(columns: Sequence[str]) -> Column:
    """An aggregate: the rows as a multiset.  Sums of hashes do not depend on order, partitioning or files."""
    sums = [F.sum(h.cast("decimal(38,0)")).cast("string") for h in row_hash(columns)]
    return F.sha2(F.concat_ws(":", F.count("*").cast("string"), *sums), 256)


class ShardTable:
    """A table below `root`, in shards by `keys`, made under `config`."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], schema: str, config: Mapping):
        self.spark, self.root, self.keys, self.schema, self.hash = spark, root.rstrip("/"), list(keys), schema, config_hash(config)
        self.columns = spark.createDataFrame([], schema).columns
        if missing := [k for k in self.keys if k not in self.columns]:
            raise ValueError(f"keys that the schema lacks: {missing}")

    # files

    def _files(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _children(self, path: str) -> list[str]:
        fs, p = self._files(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    # manifests

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self._children(f"{self.root}/manifests") if n.isdigit())

    def manifest(self, version: int | None = None) -> DataFrame:
        """keys, run, rows, signature, status, config, published of each shard; no rows before the first version."""
        kinds = dict(self.spark.createDataFrame([], self.schema).dtypes)
        schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in self.keys], "run string, rows long, signature string, status string, config string, published timestamp"])
        versions = self.versions()
        if not versions:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/manifests/{versions[-1] if version is None else version}")

    def require_config(self) -> None:
        """Refuse to go on where published shards come from another configuration."""
        other = self.manifest().filter(F.col("config") != self.hash).limit(1).first()
        if other:
            raise StaleConfig(f"{self.root} was made under configuration {other.config[:12]}, not {self.hash[:12]}; publish to another folder or call reset()")

    def reset(self) -> None:
        """Publish an empty version; earlier ones stay readable by number until collect_garbage()."""
        self._publish(self.manifest().limit(0))

    def fresh(self, seconds: float) -> bool:
        """Whether the newest shard is younger than so many seconds."""
        newest = self.manifest().agg(F.max(F.unix_micros("published"))).first()[0]
        return newest is not None and time.time() - newest / 1e6 < seconds

    # reading

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version's shards; only their folders are read."""
        if not self.versions():
            return self.spark.createDataFrame([], self.schema)
        shards = self.manifest(version).filter("status = 'ok'").select(*[F.col(k).alias(f"__{k}") for k in self.keys], F.col("run").alias("__run"))
        kept = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.keys]
        return self._raw().join(shards, [F.col("run") == F.col("__run"), *kept], "left_semi").select(*self.columns)

    def _raw(self, run: str | None = None) -> DataFrame:
        reader = self.spark.read.schema(f"{self.schema}, run string").option("basePath", f"{self.root}/data")
        return reader.parquet(f"{self.root}/data" + (f"/run={run}" if run else ""))

    def damaged(self, version: int | None = None) -> DataFrame:
        """keys, run, why of shards whose rows are not those that were signed."""
        found = self._raw().groupBy(*self.keys, "run").agg(F.count("*").alias("found_rows"), signature(self.columns).alias("found"))
        found = found.select(*[F.col(k).alias(f"__{k}") for k in self.keys], F.col("run").alias("__run"), "found_rows", "found")
        kept = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.keys]
        met = self.manifest(version).filter("status = 'ok'").join(found, [F.col("run") == F.col("__run"), *kept], "left")
        why = F.when(F.col("found").isNull(), "missing").when(F.col("rows") != F.col("found_rows"), "rows").when(F.col("signature") != F.col("found"), "contents")
        return met.withColumn("why", why).filter("why is not null").select(*self.keys, "run", "why")

    def require_whole(self) -> None:
        if rows := self.damaged().limit(5).collect():
            raise Damaged(f"shards of {self.root}: {[r.asDict() for r in rows]}")

    # writing

    def pending(self, jobs: DataFrame) -> DataFrame:
        """The jobs (rows of keys) that the newest version has not."""
        done = self.manifest().select(*[F.col(k).alias(f"__{k}") for k in self.keys])
        return jobs.select(*self.keys).distinct().join(done, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.keys], "left_anti")

    def publish(self, rows: DataFrame, jobs: DataFrame | None = None) -> int:
        """Write `rows` as new contents of their shards and publish them with the other shards of the newest version.

        Shards of `jobs` without rows are published as empty, so that no later run tries them again.
        """
        self.require_config()
        run = uuid.uuid4().hex
        rows.select(*self.columns).write.option("compression", "zstd").partitionBy(*self.keys).parquet(f"{self.root}/data/run={run}")
        kinds = dict(self.manifest().dtypes)
        written = self._raw(run).groupBy(*self.keys).agg(F.count("*").alias("rows"), signature(self.columns).alias("signature")).withColumn("status", F.lit("ok"))
        if jobs is not None:
            have = written.select(*[F.col(k).alias(f"__{k}") for k in self.keys])
            empty = jobs.select(*self.keys).distinct().join(have, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.keys], "left_anti")
            written = written.unionByName(empty.withColumns({"rows": F.lit(0).cast("long"), "signature": F.lit(""), "status": F.lit("empty")}))
        written = written.withColumns({"run": F.lit(run), "config": F.lit(self.hash), "published": F.current_timestamp()}).select(*kinds)
        fresh = written.select(*[F.col(k).alias(f"__{k}") for k in self.keys])
        kept = self.manifest().join(fresh, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.keys], "left_anti")
        return self._publish(kept.select(*kinds).unionByName(written))

    def _publish(self, manifest: DataFrame) -> int:
        number = (self.versions() or [0])[-1] + 1
        staged = f"{self.root}/staged/{uuid.uuid4().hex}"
        manifest.write.parquet(staged)
        fs, source = self._files(staged)
        _, target = self._files(f"{self.root}/manifests/{number}")
        fs.mkdirs(target.getParent())
        if fs.exists(target) or not fs.rename(source, target):
            raise RuntimeError(f"version {number} of {self.root} was published by another run meanwhile")
        return number

    def resume(self, jobs: DataFrame, work: Callable[[DataFrame], DataFrame], wave: int = 1000) -> int:
        """Do the pending jobs, `wave` of them at a time, each wave published when it is whole; the number of jobs done.

        `work` gets a table of jobs and gives their rows.  Waves go by a hash of the key, so that a run that starts again forms the same ones.
        """
        self.require_config()
        todo = self.pending(jobs)
        n = todo.count()
        waves = -(-n // wave) if n else 0
        if not n:
            return 0
        numbered = todo.withColumn("__wave", F.pmod(F.xxhash64(*[F.col(k) for k in self.keys]), F.lit(waves)))
        path = f"{self.root}/staged/{uuid.uuid4().hex}"
        numbered.write.parquet(path)  # what is pending changes with each wave
        for k in range(waves):
            part = self.spark.read.schema(numbered.schema).parquet(path).filter(F.col("__wave") == k).drop("__wave")
            self.publish(work(part), part)
        return n

    def collect_garbage(self, keep: int = 1) -> list[str]:
        """Delete runs that none of the newest `keep` versions names, older manifests, and what was staged; call it while no run writes."""
        versions = self.versions()
        named = {r.run for v in versions[-keep:] for r in self.manifest(v).select("run").distinct().collect()}
        gone = [f"data/{n}" for n in self._children(f"{self.root}/data") if n.startswith("run=") and n[4:] not in named]
        gone += [f"manifests/{v}" for v in versions[:-keep]] + [f"staged/{n}" for n in self._children(f"{self.root}/staged")]
        for path in gone:
            fs, p = self._files(f"{self.root}/{path}")
            fs.delete(p, True)
        return gone
