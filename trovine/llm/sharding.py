"""A shard store with size-tiered compaction and versioned manifests. DataFrame functions only.

``append`` writes a batch as it comes, one immutable file per input partition. ``compact`` merges files of similar size:
a file's tier is how often the target must be divided by ``fan`` to reach it; files of one tier are merged, oldest
first, into files of about the target size. A merge reads its files and writes one: nothing is shuffled. Each change is
a new manifest, a small JSON file that names all live files and the columns of the store. A manifest appears whole under
its version's number, which must not exist: readers see the old or the new version, and of two writers one must try
again. Files that no manifest names are leftovers of failed work; ``vacuum`` removes them.

The columns of the store are all that any batch had, by name; rows of batches without a column have nulls there. A batch
that gives a known column another type is refused before anything is written.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


@dataclass(frozen=True)
class Shard:
    file: str  # below the store's folder
    rows: int
    bytes: int
    added: int  # the version that added it


class Conflict(RuntimeError):
    """Another writer has committed this version."""


def united(a: StructType, b: StructType) -> StructType:
    """The columns of both, those of ``a`` first; all may be null."""
    known = {f.name: f for f in a}
    for f in b:
        if f.name in known and known[f.name].dataType != f.dataType:
            raise TypeError(f"column {f.name} is {known[f.name].dataType.simpleString()} in the store, {f.dataType.simpleString()} in the batch")
    return StructType([StructField(f.name, f.dataType) for f in (*a, *(f for f in b if f.name not in known))])


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, target_bytes: int = 256 << 20, fan: int = 4, merges_per_job: int = 64):
        self.spark, self.path = spark, path.rstrip("/")
        self.target, self.fan, self.wave = target_bytes, fan, merges_per_job
        self._jvm = spark.sparkContext._jvm
        self._root = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._names = spark.sparkContext._gateway.new_array(self._jvm.java.lang.String, 0)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _list(self, name: str) -> list:
        path = self._path(name)
        return list(self._fs.listStatus(path)) if self._fs.exists(path) else []

    def version(self) -> int:
        """The latest version; 0 if there is none."""
        names = [s.getPath().getName() for s in self._list("manifests")]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """version, schema (the JSON of a Spark schema) and shards."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": json.loads(StructType().json()), "shards": []}
        stream = self._fs.open(self._path(f"manifests/{version:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def shards(self, version: int | None = None) -> list[Shard]:
        return [Shard(**x) for x in self.manifest(version)["shards"]]

    def schema(self, version: int | None = None) -> StructType:
        return StructType.fromJson(self.manifest(version)["schema"])

    def commit(self, base: int, shards: list[Shard], schema: StructType) -> int:
        """Makes ``shards`` version ``base`` + 1, unless that exists.

        The file is written whole under another name and then gets its own by a call that fails if the name is taken: a
        hard link on a local or mounted file system, a rename without overwrite elsewhere (atomic on HDFS). A file
        system whose rename does neither needs a lock around this call.
        """
        version = base + 1
        body = json.dumps({"version": version, "schema": json.loads(schema.json()), "shards": [asdict(s) for s in sorted(shards, key=lambda s: (s.added, s.file))]})
        temporary, final = self._path(f"manifests/.{uuid.uuid4().hex}.tmp"), self._path(f"manifests/{version:012d}.json")
        out = self._fs.create(temporary, False)
        try:
            out.write(bytearray(body.encode()))
        finally:
            out.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                paths = self._jvm.java.nio.file.Paths
                at = [paths.get(self._fs.makeQualified(p).toUri().getPath(), self._names) for p in (final, temporary)]
                self._jvm.java.nio.file.Files.createLink(*at)
            else:
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
                context.rename(temporary, final, self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName() or self._fs.exists(final):
                raise Conflict(f"version {version} exists") from None
            raise
        finally:
            if self._fs.exists(temporary):
                self._fs.delete(temporary, False)
        return version

    def _written(self, folder: str, version: int) -> list[Shard]:
        """The files of a finished job, with rows from the Parquet footers."""
        files = {s.getPath().getName(): s.getLen() for s in self._list(folder) if s.getPath().getName().startswith("part-")}
        if not files:
            return []
        df = self.spark.read.parquet(f"{self.path}/{folder}")
        names = df.select(df.metadataColumn("_metadata")["file_name"].alias("name"))
        rows = {r["name"]: r["n"] for r in names.groupBy("name").agg(F.count("*").alias("n")).collect()}
        return [Shard(f"{folder}/{name}", rows[name], size, version) for name, size in sorted(files.items()) if rows.get(name)]

    def append(self, batch: DataFrame) -> int:
        """Adds the rows of ``batch`` as small shards and commits; returns the version. No rows, no new version.

        A TypeError if a column has another type than in the store.
        """
        united(self.schema(), batch.schema)
        folder = f"data/{uuid.uuid4().hex}"
        batch.write.parquet(f"{self.path}/{folder}")
        return self._retry(lambda base: [*self.shards(base), *self._written(folder, base + 1)], batch.schema)

    def _retry(self, shards_of, added: StructType = StructType()) -> int:
        while True:
            base = self.version()
            shards = shards_of(base)
            if shards == self.shards(base):
                return base
            try:
                return self.commit(base, shards, united(self.schema(base), added))
            except Conflict:
                continue

    def tier(self, size: int) -> int:
        """0 for files of half the target or more; then one more for each factor ``fan``."""
        if size * 2 >= self.target:
            return 0
        return max(1, math.ceil(math.log(self.target / 2 / max(size, 1), self.fan)))

    def plan(self, shards: list[Shard]) -> list[list[Shard]]:
        """Groups to merge: from each tier below the target, oldest first, up to the target size; a remainder of fewer
        than two files waits, and moves up with the next tier if that has too few as well."""
        groups: list[list[Shard]] = []
        waiting: list[Shard] = []
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            tiers.setdefault(self.tier(s.bytes), []).append(s)
        for tier in sorted((t for t in tiers if t), reverse=True):
            now = sorted(waiting + tiers[tier], key=lambda s: (s.added, s.file))
            waiting = []
            while now:
                group, size = [], 0
                while now and (not group or size + now[0].bytes <= self.target * 5 // 4):
                    size += now[0].bytes
                    group.append(now.pop(0))
                if len(group) > 1 and (size * 2 >= self.target or not now and len(group) >= self.fan):
                    groups.append(group)
                else:
                    waiting += group
        if len(waiting) > 1:
            groups.append(waiting)
        return groups

    def compact(self) -> int:
        """Merges until no two files below half the target are left to merge; returns the version."""
        while groups := self.plan(self.shards()):
            before = len(self.shards())
            for k in range(0, len(groups), self.wave):
                self._merge(groups[k : k + self.wave])
            if len(self.shards()) >= before:
                break
        return self.version()

    def _merge(self, groups: list[list[Shard]]) -> None:
        folder = f"data/{uuid.uuid4().hex}"
        schema = self.schema()  # of a later version than the files': a file without a column has nulls there
        parts = [self.spark.read.schema(schema).parquet(*(f"{self.path}/{s.file}" for s in g)).coalesce(1) for g in groups]
        reduce(DataFrame.union, parts).write.parquet(f"{self.path}/{folder}")
        gone = {s.file for g in groups for s in g}

        def result(base: int) -> list[Shard]:
            live = self.shards(base)
            if not gone <= {s.file for s in live}:  # another writer has merged some of them: this work is void
                return live
            new = self._written(folder, base + 1)
            if sum(s.rows for s in new) != sum(s.rows for s in live if s.file in gone):
                raise RuntimeError("a merge lost or gained rows")
            return [s for s in live if s.file not in gone] + new

        self._retry(result)

    def vacuum(self, keep_versions: int = 1) -> int:
        """Removes files that none of the last ``keep_versions`` versions names, and older manifests; returns how many."""
        version = self.version()
        kept = range(max(1, version - keep_versions + 1), version + 1)
        live = {s.file for v in kept for s in self.shards(v)}
        n = 0
        for folder in self._list("data"):
            name = f"data/{folder.getPath().getName()}"
            files = [f"{name}/{s.getPath().getName()}" for s in self._list(name)]
            dead = [f for f in files if f.rpartition("/")[2].startswith("part-") and f not in live]
            n += len(dead)
            if not any(f in live for f in files):
                self._fs.delete(self._path(name), True)
            else:
                for f in dead:
                    self._fs.delete(self._path(f), False)
        for s in self._list("manifests"):
            stem = s.getPath().getName()[:-5]
            if stem.isdigit() and int(stem) not in kept:
                self._fs.delete(s.getPath(), False)
        return n

    def listed(self, version: int | None = None) -> DataFrame:
        """version, file, rows, bytes, added and tier of each shard, read from the manifest."""
        version = self.version() if version is None else version
        schema = "version long, shards array<struct<file: string, rows: long, bytes: long, added: long>>"
        rows = self.spark.read.schema(schema).json(f"{self.path}/manifests/{version:012d}.json").select("version", F.explode("shards").alias("s")).select("version", "s.*")
        depth = F.greatest(F.lit(1), F.ceil(F.log(float(self.fan), F.lit(self.target / 2) / F.greatest(F.col("bytes"), F.lit(1)))).cast("int"))
        return rows.withColumn("tier", F.when(F.col("bytes") * 2 >= self.target, 0).otherwise(depth))

    def read(self, version: int | None = None, file_column: str = "shard") -> DataFrame:
        """The rows of a version, with all its columns and the name of each row's file.

        Where the rows have a column ``file_column`` themselves, the file's name gets underscores before its own.
        """
        shards, schema = self.shards(version), self.schema(version)
        names = {n.lower() for n in schema.names}
        while file_column.lower() in names:
            file_column = "_" + file_column
        if not shards:
            return self.spark.createDataFrame([], schema.add(file_column, "string"))
        df = self.spark.read.schema(schema).parquet(*(f"{self.path}/{s.file}" for s in shards))
        return df.select("*", df.metadataColumn("_metadata")["file_name"].alias(file_column))


def shard_documents(docs: DataFrame, path: str, arrivals: int = 3, target_bytes: int = 128 << 20) -> DataFrame:
    """``docs`` appended to a new store in ``arrivals`` batches (by a hash of doc_id), compacted, and read again:
    doc_id, shard, shard_rows, shard_bytes, version, tier.

    Batch k + 1 is half as large as batch k, the last two are equal, so that files of several tiers arise. All columns,
    of whatever name, and all rows are kept as they are, nulls, repeated rows and long texts too. An empty table makes an
    empty store and gives no rows.
    """
    spark = docs.sparkSession
    store = ShardStore(spark, path, target_bytes)
    slot = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1))), F.lit(1 << (arrivals - 1)))
    for k in range(arrivals):
        low, high = (1 << (arrivals - 1)) >> (k + 1), (1 << (arrivals - 1)) >> k
        store.append(docs.where((slot >= low) & (slot < high) if k < arrivals - 1 else slot == 0) if arrivals > 1 else docs)
    store.compact()
    store.vacuum()
    if not store.version():
        return docs.where("false").selectExpr("doc_id", "'' AS shard", "0L AS shard_rows", "0L AS shard_bytes", "0L AS version", "0 AS tier")
    rows = store.read()
    rows = rows.select("doc_id", F.col(rows.columns[-1]).alias("shard"))
    listed = store.listed().select(F.substring_index("file", "/", -1).alias("shard"), F.col("rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"), "version", "tier")
    return rows.join(listed, "shard").select("doc_id", "shard", "shard_rows", "shard_bytes", "version", "tier")
