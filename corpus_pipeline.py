"""From raw documents to training shards: quality rules, near duplicates, benchmark passages, source mix, shards.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's documents. All but the last return the columns of documents.

A filtering stage removes the rows whose id its operator rejects. Rows without an id are never rejected; rows that share
an id go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovine.llm.decontaminate import find_benchmark
from trovine.llm.mixing import schedule, token_sizes
from trovine.llm.near_dedup import near_duplicates
from trovine.llm.quality_rules import quality_rules
from trovine.llm.sharding import shard_documents
from trovine.llm.storage import mark, materialise, new_folder, release

#: How much more often one source may occur than another after mixing.
REPETITION = 2.0


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    return docs.join(rejected.select("doc_id").where("doc_id IS NOT NULL").distinct(), "doc_id", "left_anti").select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents by the risk-controlled quality rules, with ``labels`` as the labelled holdout."""
    verdict = quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "lang")
    return _without(docs, verdict.where("NOT kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the least id, of each group of near duplicates."""
    return _without(docs, near_duplicates(docs).where("NOT kept"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold a passage of ``benchmark``."""
    return _without(docs, find_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of rarer sources: every document once at least, none more than ``REPETITION`` times as often.

    The rows are written block by block of the schedule, each block whole, in its order. Rows that share an id stand
    together, in the place of the first; rows without an id stand once, in blocks of their own.
    """
    plan = schedule(token_sizes(docs), repetition=REPETITION)
    place = F.col("block").cast("long") * F.lit(1 << 36) + F.col("position")
    places = plan.where("doc_id IS NOT NULL").groupBy("doc_id", "epoch").agg(F.min(place).alias("_place")).select(F.col("doc_id").alias("_id"), "_place")
    rows = docs.select(F.struct("*").alias("_row")).join(places, F.col("_row.doc_id") == F.col("_id"), "left")
    block = F.coalesce(F.shiftright("_place", 36), -1 - F.pmod(F.xxhash64("_row.text"), F.lit(1024)))
    return rows.withColumn("_block", block).repartition("_block").sortWithinPartitions("_block", "_place").select("_row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Appends the documents to a new shard store, compacts it, and tells each document's shard."""
    return shard_documents(docs, new_folder(spark, "corpus", keep=True))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: No stage but the first has an SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from ``documents``. What a stage has left behind goes when its rows are written."""
    docs, start = spark.read.parquet(f"{sf_dir}/documents.parquet"), mark()
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        before_write = mark()
        docs = materialise(out, name)
        release(spark, start, before_write)
