"""Work that comes in pieces: files and rows not handled yet. An extension for the event table stands last."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def process_new_files(spark: SparkSession, source: str, sink: str, checkpoint: str, step: Callable[[DataFrame], DataFrame], schema, name: str = "batch") -> int:
    """Applies ``step`` to Parquet files that have come since the last call, and appends the results; returns the rows.

    The checkpoint remembers the files. A batch that is run again after a failure writes to the same folder, so nothing
    is written twice.
    """
    total = spark.sparkContext.accumulator(0)

    def write(df: DataFrame, epoch: int) -> None:
        out = f"{sink.rstrip('/')}/{name}={epoch}"
        step(df).write.mode("overwrite").parquet(out)
        total.add(spark.read.parquet(out).count())

    query = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return total.value


def score_new(pairs: DataFrame, scored: DataFrame, step: Callable[[DataFrame], DataFrame], keys: tuple[str, ...] = ("query_id", "item_id")) -> DataFrame:
    """The rows of ``scored`` and ``step`` of the pairs that are not among them."""
    return scored.unionByName(step(pairs.join(scored.select(*keys), list(keys), "left_anti")))


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Extension: events and value per type and window; on a stream, rows later than ``late`` are left out."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return rows.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")
