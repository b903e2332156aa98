"""Sharding by size-tiered compaction.

Arrivals are appended as small immutable Parquet shards. Compaction sorts shards into tiers by size,
and merges runs of similarly sized shards into files of up to the target size. Every change is a new
version of a manifest that lists the live shards; it is committed by renaming a finished file to the
next version's name, which fails if another writer was first, and is then tried again on top of that
version. Readers see the version they opened for as long as vacuums keep it; they delete files that
no kept version lists, and what failed appends and lost merges have left.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from contextlib import contextmanager
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    rows: int


class CommitConflict(RuntimeError):
    """Another writer committed the version first."""


class ShardStore:
    """A versioned set of shards below one folder of any Hadoop file system.

    target_bytes: shards of that size and more are final. fanout: a tier spans sizes of one power of
    it, and a run of at least that many shards of a tier is merged. merges_per_job: merges of one Spark
    job, each a task of its own.
    """

    def __init__(self, spark: SparkSession, root: str, *, target_bytes: int = 128 << 20, fanout: int = 4, smallest: int = 64 << 10, merges_per_job: int = 256):
        self.spark, self.root = spark, root.rstrip("/")
        self.target, self.fanout, self.smallest, self.merges_per_job = target_bytes, fanout, smallest, merges_per_job
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def _manifest(self, version: int) -> str:
        return f"{self.root}/manifest/v{version:08d}.json"

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/manifest")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[1:9]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version (default: the last); version 0 is the empty store."""
        if version is None:
            version = (self.versions() or [0])[-1]
        if version == 0:
            return {"version": 0, "action": "create", "schema": None, "shards": []}
        stream = self._fs.open(self._path(self._manifest(version)))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def shards(self, version: int | None = None) -> list[Shard]:
        return [Shard(**s) for s in self.manifest(version)["shards"]]

    def commit(self, base: dict, shards: list[Shard], action: str, schema: str | None) -> int:
        """Write version base + 1; CommitConflict if it exists."""
        version = base["version"] + 1
        body = json.dumps({"version": version, "parent": base["version"], "action": action, "schema": schema, "shards": [asdict(s) for s in shards]})
        draft, final = self._path(f"{self.root}/manifest/.{uuid.uuid4().hex}"), self._path(self._manifest(version))
        out = self._fs.create(draft, False)
        out.write(bytearray(body.encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(draft, final, none)  # never replaces a file
        except Exception as e:
            self._fs.delete(draft, False)
            if self._fs.exists(final):
                raise CommitConflict(f"version {version} exists") from e
            raise
        return version

    def _written(self, folder: str) -> list[tuple[str, int]]:
        found = [(s.getPath().toString(), s.getLen()) for s in self._fs.listStatus(self._path(folder))]
        return sorted(f for f in found if f[0].rpartition("/")[2].startswith("part-"))

    def append(self, df: DataFrame) -> int:
        """Add the rows of df as new shards, one a partition; returns the version. An empty df adds none."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        rows = {r["f"].rpartition("/")[2]: r["n"] for r in self.spark.read.schema(df.schema).parquet(folder).groupBy(F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n")).collect()}
        new = [Shard(p, size, rows[p.rpartition("/")[2]]) for p, size in self._written(folder) if p.rpartition("/")[2] in rows]
        while True:
            base = self.manifest()
            if base["schema"] and json.loads(base["schema"]) != json.loads(df.schema.json()):
                raise ValueError("the rows have another schema than the store")
            try:
                return self.commit(base, [Shard(**s) for s in base["shards"]] + new, "append", df.schema.json())
            except CommitConflict:
                continue

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / self.smallest, self.fanout)))

    def merge_groups(self, shards: list[Shard], everything: bool = False) -> list[list[Shard]]:
        """Groups of shards to merge: of tiers that hold a run of fanout or more, smallest first, each up to the target size.

        everything: also pack what is left under the target size, whatever its tier (a last compaction).
        """
        small = [s for s in shards if s.bytes < self.target]
        runs: list[list[Shard]] = []
        if everything:
            runs = [sorted(small, key=lambda s: (s.bytes, s.path))]
        else:
            tiers: dict[int, list[Shard]] = {}
            for s in small:
                tiers.setdefault(self.tier(s.bytes), []).append(s)
            runs = [sorted(t, key=lambda s: (s.bytes, s.path)) for _, t in sorted(tiers.items()) if len(t) >= self.fanout]
        groups: list[list[Shard]] = []
        for run in runs:
            group: list[Shard] = []
            for s in run:
                if group and sum(x.bytes for x in group) + s.bytes > self.target:
                    groups.append(group)
                    group = []
                group.append(s)
            groups.append(group)
        return [g for g in groups if len(g) > 1]

    def compact(self, everything: bool = False) -> int | None:
        """One round of merges; the new version, or None if no run is due.

        A group is read and written by one task, without a shuffle: its size is bounded by the target.
        If another writer removed a merged shard meanwhile, the merge is dropped.
        """
        base = self.manifest()
        groups = self.merge_groups([Shard(**s) for s in base["shards"]], everything)
        if not groups:
            return None
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(json.loads(base["schema"]))

        merged = [m for i in range(0, len(groups), self.merges_per_job) for m in self._merge(groups[i : i + self.merges_per_job], schema)]
        gone = {s.path for g in groups for s in g}
        while True:
            now = self.manifest()
            live = [Shard(**s) for s in now["shards"]]
            if not gone <= {s.path for s in live}:
                return None
            try:
                return self.commit(now, [s for s in live if s.path not in gone] + merged, "compact", now["schema"])
            except CommitConflict:
                continue

    def _merge(self, groups: list[list[Shard]], schema) -> list[Shard]:
        """One job that writes the rows of each group as one file, a task a group."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        parts = [self.spark.read.schema(schema).parquet(*(s.path for s in g)).coalesce(1) for g in groups]
        with _separate_unions(self.spark):
            reduce(DataFrame.union, parts).write.option("maxRecordsPerFile", 0).parquet(folder)
        files = self._written(folder)
        if [int(path.rpartition("/part-")[2][:5]) for path, _ in files] != list(range(len(groups))):
            raise RuntimeError(f"{len(files)} files in {folder} for {len(groups)} merges")
        return [Shard(path, size, sum(s.rows for s in g)) for (path, size), g in zip(files, groups, strict=True)]

    def read(self, version: int | None = None) -> DataFrame:
        from pyspark.sql.types import StructType

        m = self.manifest(version)
        if not m["shards"]:
            return self.spark.createDataFrame([], StructType.fromJson(json.loads(m["schema"])) if m["schema"] else StructType([]))
        return self.spark.read.schema(StructType.fromJson(json.loads(m["schema"]))).parquet(*(s["path"] for s in m["shards"]))

    def vacuum(self, keep_versions: int = 2, orphans_after: float = 86400.0) -> int:
        """Delete files and manifests that none of the last keep_versions versions needs; returns the number of files.

        Readers of an older version must be done. Folders that no version lists and that are older than
        orphans_after seconds (more than any append or merge takes) go as well.
        """
        versions = self.versions()
        kept, old = versions[-keep_versions:], versions[:-keep_versions]
        live = {s.path for v in kept for s in self.shards(v)}
        dead = {s.path for v in old for s in self.shards(v)} - live
        for p in dead:
            self._fs.delete(self._path(p), False)
        for v in old:
            self._fs.delete(self._path(self._manifest(v)), False)
        data, used = self._path(f"{self.root}/data"), {p.rpartition("/")[0].rpartition("/")[2] for p in live}
        for s in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if s.getPath().getName() not in used and s.getModificationTime() < 1000 * (time.time() - orphans_after):
                self._fs.delete(s.getPath(), True)
        return len(dead)


@contextmanager
def _separate_unions(spark: SparkSession):
    """Unions keep a task for each of their parts; Spark 4.1 would else join parts of one partition each."""
    name = "spark.sql.unionOutputPartitioning"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def shard_by_compaction(arrivals: list[DataFrame], store: ShardStore, keep_versions: int = 1) -> DataFrame:
    """Append each arrival, compacting as runs come up, then pack the rest; the rows of the final version.

    keep_versions: those that stay after a merge; 1 is for a store that nobody else reads meanwhile.

    Rows come back as they went in: nulls, empty texts and repeated rows included. No arrivals, or
    only empty ones, give an empty table.
    """
    for df in arrivals:
        store.append(df)
        while store.compact() is not None:
            store.vacuum(keep_versions)
    store.compact(everything=True)
    store.vacuum(keep_versions)
    return store.read()


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    from peakloom.workspace import new_folder

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    arrivals = [docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == i) for i in range(4)]
    kept = shard_by_compaction(arrivals, ShardStore(spark, new_folder(spark, "shards"), target_bytes=32 << 20))
    return kept.select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"))


QUERIES = {"op10_sharding": op10_sharding}

ORACLE_SQL = {"op10_sharding": "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents"}
