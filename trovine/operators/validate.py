"""Checks of an answer file. Each rule is an aggregate; nothing but its counts comes back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluate import require_none

LIMIT = 50
ID_FORMAT = "^[0-9a-f]{16}$"


def check_answer(answer: DataFrame, queries: DataFrame, items: DataFrame | None = None, limit: int = LIMIT, id_format: str = ID_FORMAT) -> DataFrame:
    """(severity, rule, n, example) for each rule that ``answer`` (query_id, answer) breaks.

    FAIL: a query twice, missing or unknown; spacing other than single spaces; more than ``limit`` ids; an id twice.
    WARN: an id of another format, an id not in ``items`` (item_id), fewer than ``limit`` ids.
    """
    rows = answer.select(F.coalesce("query_id", F.lit("")).alias("query_id"), F.coalesce("answer", F.lit("")).alias("answer"))
    rows = rows.withColumn("ids", F.filter(F.split("answer", " "), lambda x: x != ""))
    known = queries.select(F.col("query_id").cast("string")).distinct()

    def rule(severity: str, name: str, df: DataFrame, example: Column | str) -> DataFrame:
        e = F.col(example) if isinstance(example, str) else example
        return df.agg(F.lit(severity).alias("severity"), F.lit(name).alias("rule"), F.count("*").alias("n"), F.min(e.cast("string")).alias("example"))

    each = rows.select("query_id", F.explode("ids").alias("id"))
    found = [
        rule("FAIL", "query repeats", rows.groupBy("query_id").count().where("count > 1"), "query_id"),
        rule("FAIL", "query missing", known.join(rows, "query_id", "left_anti"), "query_id"),
        rule("FAIL", "query unknown", rows.join(known, "query_id", "left_anti"), "query_id"),
        rule("FAIL", "spacing", rows.where(F.col("answer") != F.array_join("ids", " ")), "query_id"),
        rule("FAIL", "too many ids", rows.where(F.size("ids") > limit), "query_id"),
        rule("FAIL", "id repeats", rows.where(F.size(F.array_distinct("ids")) < F.size("ids")), "query_id"),
        rule("WARN", "id format", each.where(~F.col("id").rlike(id_format)), "id"),
        rule("WARN", "too few ids", rows.where(F.size("ids") < limit), "query_id"),
    ]
    if items is not None:
        found.append(rule("WARN", "id unknown", each.join(items.select(F.col("item_id").cast("string").alias("id")).distinct(), "id", "left_anti"), "id"))
    return reduce(DataFrame.unionByName, found).where("n > 0")


def check_file(spark, path: str) -> list[tuple[str, str]]:
    """What the bytes of a single CSV file show: (severity, rule) for a byte-order mark, bad UTF-8, a wrong header.

    The whole file is looked at, where it is read; only the findings come to the driver.
    """
    bom = "substring(content, 1, 3) = X'EFBBBF'"
    body = f"if({bom}, substring(content, 4), content)"
    header = f"rtrim('\r', substring_index(CAST(substring({body}, 1, 1000) AS STRING), '\n', 1))"
    found = spark.read.format("binaryFile").load(path).selectExpr(f"{bom} AS bom", "is_valid_utf8(CAST(content AS STRING)) AS utf8", f"{header} AS header").first()
    out = [("FAIL", "byte-order mark")] if found.bom else []
    if not found.utf8:
        return [*out, ("FAIL", "not UTF-8")]
    return out if found.header == "query_id,answer" else [*out, ("FAIL", "header")]


def require_full_lists(cands: DataFrame, n: int) -> None:
    """Every query has exactly ``n`` candidates with ranks 1 to n."""
    bad = cands.groupBy("query_id").agg(F.count("*").alias("rows"), F.min("rank").alias("low"), F.max("rank").alias("high"), F.count_distinct("rank").alias("ranks"))
    require_none(bad.where(f"rows <> {n} OR low <> 1 OR high <> {n} OR ranks <> {n}"), f"not exactly {n} candidates")
