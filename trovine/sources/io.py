"""Tables in and out: projected scans, roles, candidate lists, answers, resumable writes, cached artefacts."""

from __future__ import annotations

import hashlib
import json
import resource
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import number
from ..operators.evaluate import without_keys
from ..operators.windows import first_per

CANDIDATES = T.StructType([T.StructField("query_id", T.StringType()), T.StructField("item_id", T.StringType()), T.StructField("score", T.FloatType()), T.StructField("rank", T.IntegerType())])


def read(spark: SparkSession, path: str, columns: Sequence[str] | None = None, ids: DataFrame | None = None, key: str = "item_id") -> DataFrame:
    """A Parquet table with only ``columns``, and only rows whose key is in ``ids``."""
    df = spark.read.parquet(path)
    df = df.select(*columns) if columns else df
    return df.join(ids.select(key).distinct(), key, "left_semi") if ids is not None else df


def spread(df: DataFrame, split_bytes: int = 4 << 20) -> DataFrame:
    """A table that is too small to give every core a split of a file is dealt out row by row; a larger one stays as it is.

    A file is read in splits, but a split without the middle of a row group has no rows: of a small file one core would do
    all the work. A table of ``split_bytes`` a core and more is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if (1 << 20) < size < cores * split_bytes else df


def coordinates(df: DataFrame, lat: str = "item_latitude", lon: str = "item_longitude") -> DataFrame:
    """With lat and lon as numbers; what is none is null."""
    return df.withColumn("lat", number(lat)).withColumn("lon", number(lon))


def split(log: DataFrame, queries: DataFrame, held: DataFrame | None, limit: int | None = None) -> dict[str, DataFrame]:
    """train, train_fit (without held-out keys) and queries (the first ``limit`` by id)."""
    return {"train": log, "train_fit": without_keys(log, held) if held is not None else log, "queries": queries.orderBy("query_id").limit(limit) if limit else queries}


def read_strings(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """CSV with all columns as text; an empty field is the empty text, never null."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return df.select(*(F.coalesce(c, F.lit("")).alias(c) for c in columns))


def read_vectors(spark: SparkSession, path: str, width: int, id_col: str = "item_id", column: str = "vector") -> DataFrame:
    """(item_id, vector), after a check that every vector has ``width`` numbers."""
    df = spark.read.parquet(path).select(F.col(id_col).alias("item_id"), F.col(column).alias("vector"))
    bad = df.where(F.col("vector").isNull() | (F.size("vector") != width)).limit(1).count()
    if bad:
        raise ValueError(f"a vector in {path} has another length than {width}")
    return df


def source_candidates(cands: DataFrame, queries: DataFrame, items: DataFrame) -> DataFrame:
    """Candidates with item_location_id and city (the item is in the query's location)."""
    rows = cands.join(items.select("item_id", "item_location_id"), "item_id", "left").join(queries.select("query_id", "search_location_id"), "query_id")
    return rows.withColumn("city", F.coalesce(F.col("item_location_id") == F.col("search_location_id"), F.lit(False)))


def distinct_items(*tables: DataFrame) -> DataFrame:
    """Rows of several tables, one an item_id: of different ones the first in the order of their JSON."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return first_per(out, ["item_id"], [F.to_json(F.struct("*"))])


def text_lengths(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("*", *(F.length(F.coalesce(c, F.lit(""))).alias(f"{c}_length") for c in columns))


def sample_by_key(df: DataFrame, key: str, per_mille: int, seed: int = 42) -> DataFrame:
    """A sample that depends on the key only, so that samples of several tables fit together."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), 1, 6), 16, 10).cast("long")
    return df.where(h % 1000 < per_mille)


def write_candidates(cands: DataFrame, path: str) -> None:
    cands.select(*(F.col(f.name).cast(f.dataType) for f in CANDIDATES)).write.mode("overwrite").parquet(path)


def answers(cands: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """(query_id, answer): ids in rank order with one space between; '' for a query without candidates."""
    rows = cands.where(F.col("rank") <= k).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("item_id").cast("string").alias("item_id")))).alias("x"))
    rows = rows.select("query_id", F.array_join(F.transform("x", lambda s: s["item_id"]), " ").alias("answer"))
    return queries.select("query_id").distinct().join(rows, "query_id", "left").select("query_id", F.coalesce("answer", F.lit("")).alias("answer"))


def write_answer(cands: DataFrame, queries: DataFrame, path: str, k: int = 50, items: DataFrame | None = None) -> list:
    """The answer as one CSV file in the folder ``path``, in the order of the query ids; returns what the check says.

    A FAIL raises before anything is written.
    """
    from ..operators.validate import check_answer

    out = answers(cands, queries, k)
    found = check_answer(out, queries, items, k).collect()
    if any(r.severity == "FAIL" for r in found):
        raise ValueError(f"the answer breaks rules: {found}")
    # One row a query: a file of this size is what the format asks for.
    out.orderBy("query_id").coalesce(1).write.mode("overwrite").option("header", True).option("quoteAll", False).csv(path)
    return found


def resume_write(df: DataFrame, path: str, key: str) -> int:
    """Appends the rows whose key is not at ``path`` yet; returns how many.

    A run that failed has left nothing, and the next one starts from what is there. The counts come from the files' footers.
    (An observation would count on the way, but a session with one can no longer send fitted models to its tasks.)
    """
    spark = df.sparkSession
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    before = 0
    if jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path):
        known = spark.read.parquet(path)
        df, before = df.join(known.select(key), key, "left_anti"), known.count()
    df.write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def fingerprint(*parts: object) -> str:
    return hashlib.sha1(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def cached(spark: SparkSession, root: str, parts: Sequence[object], build: Callable[[], DataFrame]) -> DataFrame:
    """The table of these parameters below ``root``, built once. A write that did not finish does not count."""
    path = f"{root.rstrip('/')}/{fingerprint(*parts)}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def work_folder(spark: SparkSession) -> str:
    """A new folder for tables between steps: below ``spark.checkpoint.dir``, or local where one machine has none set (tests).

    It is removed when the session's process ends, if not before.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="trovine-")
    path = f"{root.rstrip('/')}/work-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def stage(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` and read back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: The tables of a saved split.
SPLIT = ("queries", "labels", "mask", "keys")


def save_split(path: str, queries: DataFrame, labels: DataFrame, mask: DataFrame, keys: DataFrame) -> None:
    """The four tables of a split: its queries, their answers, the log rows that go, and the keys held out."""
    for name, df in zip(SPLIT, (queries, labels, mask, keys), strict=True):
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def load_split(spark: SparkSession, path: str, log: DataFrame | None = None, key: str = "query_key") -> dict[str, DataFrame]:
    """The tables of a saved split; with ``log`` also train_fit: its rows whose key is not held out."""
    tables = {name: spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in SPLIT}
    return tables | ({"train_fit": without_keys(log, tables["keys"], key)} if log is not None else {})


class Timings:
    """Wall time of named steps, and the most memory that the driver's process had by the end of each, in MB."""

    def __init__(self) -> None:
        self.steps: dict[str, float] = {}
        self.memory: dict[str, float] = {}

    @contextmanager
    def step(self, name: str) -> Iterator[None]:
        start = time.perf_counter()
        try:
            yield
        finally:
            self.steps[name] = self.steps.get(name, 0.0) + time.perf_counter() - start
            self.memory[name] = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024


def write_report(df: DataFrame, path: str, fmt: str = "csv", **config: object) -> None:
    """A small report as one file, with its configuration as JSON beside it."""
    writer = df.coalesce(1).write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)
    if config:
        df.sparkSession.createDataFrame([(json.dumps(config, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.config")
