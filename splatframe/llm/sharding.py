"""Sharding by size-tiered compaction.

append() writes arrivals as small immutable shards and commits a manifest that lists them. compact() sorts the shards
into tiers of similar size and merges each tier's run of small shards into files of about the target size. A tier is
one job whose tasks read whole shards packed up to the target, so nothing is shuffled and no shard is split: merged
files hold at most the target's bytes of shards, and more than half of it but for the last.

Manifests are versioned, and a version can be committed once: its file is made under another name and then linked (local
file systems) or renamed (HDFS, ABFS) into place, which is one step there and fails if another writer was first. Where
a rename is a copy, as on plain object stores, two writers could both win, so such stores are refused unless the caller
vouches for them by atomic_rename=True. Appends and compactions that lose try again on the newer version; a compaction
whose shards were merged by another one is given up, and its files are deleted. Readers see the files of one version.

Each shard is listed with its schema. Only shards of one schema are merged, and read() unites schemas by name: a column
that a shard lacks is null in its rows, so appending a table with other columns loses none. Types that can't be united
raise an error when they are read.

Tasks write by Spark's commit protocol, so a lost executor's files are written again and never listed twice. Rows are
kept as they are: nulls, empty and very long texts, ties, repeated rows, any columns. An empty table is a version
without rows, of an empty shard that keeps the schema.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a file after merging, and rows of an arriving shard at most.
TARGET_BYTES = 64 << 20
ARRIVAL_ROWS = 4096
#: File systems on which the commit is one step.
ATOMIC = ("file", "hdfs", "viewfs", "abfs", "abfss")
#: Sizes of one tier differ by this factor at most; a tier with fewer shards than this waits.
TIER_FACTOR = 4
MIN_RUN = 4


class CommitConflict(RuntimeError):
    """Another writer was first."""


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    schema: str


def _schema(text: str) -> T.StructType:
    return T.StructType.fromJson(json.loads(text))


class ShardStore:
    """A folder with shards and manifests, reached by the Hadoop file system of its path."""

    def __init__(self, spark: SparkSession, root: str, atomic_rename: bool = False):
        self.spark, self.root = spark, root
        self._jvm = spark._jvm
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._scheme = self._fs.getUri().getScheme()
        if self._scheme not in ATOMIC and not atomic_rename:
            raise ValueError(f"a rename on {self._scheme} may not be atomic; pass atomic_rename=True if it is")
        for folder in ("manifests", "shards"):
            self._fs.mkdirs(self._path(f"{root}/{folder}"))

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _listed(self, folder: str, ending: str) -> list[tuple[str, int]]:
        found = self._fs.listStatus(self._path(folder))
        return sorted(
            (f"{folder}/{s.getPath().getName()}", s.getLen()) for s in found if s.getPath().getName().endswith(ending)
        )

    def version(self) -> int:
        names = [path.rsplit("/", 1)[1] for path, _ in self._listed(f"{self.root}/manifests", ".json")]
        return max((int(x[1:-5]) for x in names if x.startswith("v")), default=0)

    def manifest(self, version: int | None = None) -> list[Shard]:
        version = self.version() if version is None else version
        if not version:
            return []
        stream = self._fs.open(self._path(f"{self.root}/manifests/v{version:08d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        found = json.loads(text)
        return [Shard(x["path"], x["bytes"], found["schemas"][x["schema"]]) for x in found["shards"]]

    def commit(self, shards: list[Shard], based_on: int) -> int:
        """The next version, if it is still based_on + 1; one step makes it visible, or another writer has it."""
        version = based_on + 1
        held, final = (f"{self.root}/manifests/{x}" for x in (f".{uuid.uuid4().hex}", f"v{version:08d}.json"))
        schemas = sorted({s.schema for s in shards})
        number = {x: k for k, x in enumerate(schemas)}
        listed = [{"path": s.path, "bytes": s.bytes, "schema": number[s.schema]} for s in shards]
        out = self._fs.create(self._path(held), False)
        try:
            out.write(bytearray(json.dumps({"version": version, "schemas": schemas, "shards": listed}).encode()))
        finally:
            out.close()
        won = self._publish(held, final)
        if self._fs.exists(self._path(held)):
            self._fs.delete(self._path(held), False)
        if not won:
            raise CommitConflict(f"version {version} is taken")
        return version

    def _publish(self, held: str, final: str) -> bool:
        """Gives the file its name, unless that is taken."""
        if self._scheme == "file":  # whose rename would replace the other writer's file
            try:
                os.link(*(self._path(x).toUri().getPath() for x in (held, final)))
            except FileExistsError:
                return False
            return True
        return not self._fs.exists(self._path(final)) and self._fs.rename(self._path(held), self._path(final))

    def _again(self, shards_of) -> int:
        """Commits what shards_of makes of the newest version, until no other writer comes first."""
        while True:
            now = self.version()
            try:
                return self.commit(shards_of(self.manifest(now)), now)
            except CommitConflict:
                if self.version() == now:
                    raise
                time.sleep(0.05)

    def _write(self, df: DataFrame, rows: int | None = None) -> list[Shard]:
        folder = f"{self.root}/shards/{uuid.uuid4().hex}"
        writer = df.write.option("maxRecordsPerFile", rows) if rows else df.write
        writer.parquet(folder)
        schema = df.schema.json()
        return [Shard(path, size, schema) for path, size in self._listed(folder, ".parquet")]

    def append(self, df: DataFrame, rows: int = ARRIVAL_ROWS) -> int:
        """Writes df as shards of at most that many rows and commits them beside those that are there."""
        fresh = self._write(df, rows)
        return self._again(lambda now: [*now, *fresh])

    def tiers(self, shards: list[Shard], target: int) -> list[list[Shard]]:
        """Runs of small shards of one schema and of similar size, by powers of TIER_FACTOR."""
        by_tier: dict[tuple[int, str], list[Shard]] = {}
        for s in shards:
            if 2 * s.bytes <= target:
                tier = 0
                while TIER_FACTOR ** (tier + 1) <= s.bytes:
                    tier += 1
                by_tier.setdefault((tier, s.schema), []).append(s)
        return [run for _, run in sorted(by_tier.items()) if len(run) >= MIN_RUN]

    def compact(self, target: int = TARGET_BYTES) -> int:
        """Merges each tier and commits one version with the merged files in the place of the small ones."""
        runs = self.tiers(self.manifest(), target)
        if not runs:
            return self.version()
        merged = [s for run in runs for s in self._write(self._packed(run, target))]
        gone = {s.path for run in runs for s in run}

        def replaced(now: list[Shard]) -> list[Shard]:
            if gone <= {s.path for s in now}:
                return [*(s for s in now if s.path not in gone), *merged]
            for folder in {s.path.rsplit("/", 1)[0] for s in merged}:
                self._fs.delete(self._path(folder), True)
            raise CommitConflict("another compaction has merged these shards")

        return self._again(replaced)

    def _packed(self, run: list[Shard], target: int) -> DataFrame:
        """The run's rows in partitions of whole shards, of target bytes at most: each makes one file."""
        own = self.spark.newSession()
        for key, value in (("maxPartitionBytes", target), ("openCostInBytes", 0), ("minPartitionNum", 1)):
            own.conf.set(f"spark.sql.files.{key}", str(value))
        return own.read.schema(_schema(run[0].schema)).parquet(*(s.path for s in run))

    def vacuum(self) -> None:
        """Deletes shards that the newest version doesn't list: only for a store without other writers, and without
        readers of older versions."""
        kept = {s.path for s in self.manifest()}
        base = f"{self.root}/shards"
        for folder in self._fs.listStatus(self._path(base)):
            own = f"{base}/{folder.getPath().getName()}"
            files = [path for path, _ in self._listed(own, ".parquet")]
            if kept.isdisjoint(files):
                self._fs.delete(self._path(own), True)
                continue
            for path in files:
                if path not in kept:
                    self._fs.delete(self._path(path), False)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with the columns of all its shards."""
        by_schema: dict[str, list[str]] = {}
        for s in self.manifest(version):
            by_schema.setdefault(s.schema, []).append(s.path)
        if not by_schema:
            raise ValueError("the store has no version with shards")
        parts = [self.spark.read.schema(_schema(text)).parquet(*paths) for text, paths in by_schema.items()]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def digest(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """What a round trip must keep: doc_id, lang, source, n_chars, and the text's digest and bytes."""
    return df.select(
        F.col(doc_id), "lang", "source", "n_chars", F.sha2(F.col(text), 256).alias("text_sha256"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )
