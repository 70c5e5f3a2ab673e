"""Fusion of ranked lists and set operations on them. Lists are (query_id, item_id, rank[, score])."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import min_max, renumber, z_norm

#: Beyond any rank: the order of first appearance is list number times this plus rank.
_FAR = 10**9


def _stack(lists: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, [x.select(*by, "item_id", F.col("rank").cast("long").alias("rank"), F.lit(i).alias("list")) for i, x in enumerate(lists)])


def rrf(lists: Sequence[DataFrame], k: float = 60.0, n: int = 300, bonus: DataFrame | None = None, weights: Sequence[float] | None = None, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """Reciprocal ranks, sum of w / (k + rank), with rank; equal scores stand in the order of first appearance.

    ``bonus`` (query_id, item_id, bonus) is added before the cut, so it changes who is in.
    """
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in (weights or [1.0] * len(lists)))), F.col("list") + 1)
    fused = _stack(lists, by).groupBy(*by, "item_id").agg(F.sum(weight / (F.lit(float(k)) + F.col("rank"))).alias("score"), F.min(F.col("list") * F.lit(_FAR) + F.col("rank")).alias("first"))
    if bonus is not None:
        fused = fused.join(bonus.select(*by, "item_id", "bonus"), [*by, "item_id"], "left").withColumn("score", F.col("score") + F.coalesce("bonus", F.lit(0.0)))
    # Sums of equal parts in another order may differ in the last bit: ties are found after rounding.
    ranked = renumber(fused, [F.desc(F.round("score", 12)), "first", "item_id"], by)
    return ranked.where(F.col("rank") <= n).select(*by, "item_id", "score", "rank")


def weighted(a: DataFrame, b: DataFrame, w: float = 0.5, norm: str = "minmax", n: int = 300, tier: str | None = None, digits: int = 12) -> DataFrame:
    """w x normalised score of ``a`` + (1 - w) x that of ``b``; a missing one is the lowest of its list in the query
    (and tier), else 0. Scores that are equal after rounding to ``digits`` stand in the order of their ids."""
    scale = {"minmax": min_max, "z": z_norm}[norm]
    by = ["query_id"] + ([tier] if tier else [])
    x = a.select(*by, "item_id", scale("score", by).alias("sa"))
    y = b.select(*by, "item_id", scale("score", by).alias("sb"))
    both = x.join(y, [*by, "item_id"], "outer")
    for c in ("sa", "sb"):
        low = F.min(c).over(Window.partitionBy(*by))
        wide = F.min(c).over(Window.partitionBy("query_id"))
        both = both.withColumn(c, F.coalesce(c, low, wide, F.lit(0.0)))
    both = both.withColumn("score", F.lit(w) * F.col("sa") + F.lit(1 - w) * F.col("sb"))
    order = ([tier] if tier else []) + [F.desc(F.round("score", digits)), "item_id"]
    return renumber(both, order).where(F.col("rank") <= n).select("query_id", "item_id", "score", "rank")


def interleave(a: DataFrame, b: DataFrame, n: int = 300) -> DataFrame:
    """a1, b1, a2, b2, ...; an item stands at its first place."""
    rows = _stack([a, b], ["query_id"]).groupBy("query_id", "item_id").agg(F.min(2 * F.col("rank") - 1 + F.col("list")).alias("place"))
    return renumber(rows, ["place", "item_id"]).where(F.col("rank") <= n).select("query_id", "item_id", (1 / F.col("rank")).alias("score"), "rank")


def late(a: DataFrame, b: DataFrame, w: float = 1.0, k: float = 60.0) -> DataFrame:
    """1 / (k + rank in a) + w / (k + rank in b); ties by the rank in a, then in b."""
    x, y = a.select("query_id", "item_id", F.col("rank").alias("r1")), b.select("query_id", "item_id", F.col("rank").alias("r2"))
    both = x.join(y, ["query_id", "item_id"], "outer")
    score = F.coalesce(1 / (F.lit(k) + F.col("r1")), F.lit(0.0)) + F.coalesce(F.lit(w) / (F.lit(k) + F.col("r2")), F.lit(0.0))
    both = both.withColumn("score", score)
    order = [F.desc(F.round("score", 12)), F.col("r1").asc_nulls_last(), F.col("r2").asc_nulls_last(), "item_id"]
    return renumber(both, order).select("query_id", "item_id", "score", "rank")


def rerank_head(cands: DataFrame, scores: DataFrame, mode: str = "ce", top: int = 100, keep: int = 0, k: float = 60.0) -> DataFrame:
    """The first ``top`` by another model's score ``ce``: alone (``ce``), fused by reciprocal ranks (``rrf``), or after the
    first ``keep``, which stay (``keep``). The tail is untouched."""
    rows = cands.withColumnRenamed("rank", "old").drop("score").join(scores.select("query_id", "item_id", "ce"), ["query_id", "item_id"], "left")
    rows = rows.withColumn("_head", F.col("old") <= top)
    by_ce = F.row_number().over(Window.partitionBy("query_id", "_head").orderBy(F.desc_nulls_last("ce"), "old"))
    rows = rows.withColumn("_ce", by_ce)
    place = {
        "ce": F.col("_ce").cast("double"),
        "rrf": -(1 / (F.lit(k) + F.col("old")) + 1 / (F.lit(k) + F.col("_ce"))),
        "keep": F.when(F.col("old") <= keep, F.col("old") - F.lit(_FAR)).otherwise(F.col("_ce")).cast("double"),
    }[mode]
    rows = rows.withColumn("_place", F.when(F.col("_head"), F.round(place, 12)).otherwise(F.col("old").cast("double")))
    out = renumber(rows, [F.desc("_head"), "_place", "old"])
    return out.select("query_id", "item_id", (1 / (F.lit(k) + F.col("rank"))).alias("score"), "rank")


def union_candidates(fused: DataFrame, extra: DataFrame, bonus: DataFrame | None = None, k: int = 300) -> DataFrame:
    """The first ``k`` of ``fused`` and the items of ``extra`` that are not among them, with rank and score.

    A new item has its place and score in the continuation of ``fused``, if it is there; otherwise it stands after the
    list's end, in the order of ``extra``, with its bonus as score. Adds ft_rank (place in ``extra``, or its limit + 1) and
    is_new.
    """
    limit = extra.agg(F.max("rank")).first()[0] or 0
    length = fused.groupBy("query_id").agg(F.max("rank").alias("_n"))
    x = fused.select("query_id", "item_id", F.col("score").alias("_s"), F.col("rank").alias("_r"))
    y = extra.select("query_id", "item_id", F.col("rank").alias("ft_rank"))
    both = x.join(y, ["query_id", "item_id"], "outer").where(F.col("_r").isNull() | (F.col("_r") <= k) | F.col("ft_rank").isNotNull()).join(length, "query_id", "left")
    both = both.withColumn("is_new", (F.coalesce(F.col("_r"), F.lit(_FAR)) > k).cast("int"))
    order = F.row_number().over(Window.partitionBy("query_id", "is_new").orderBy(F.col("ft_rank").asc_nulls_last(), "item_id"))
    both = both.withColumn("_t", order)
    if bonus is not None:
        both = both.join(bonus.select("query_id", "item_id", "bonus"), ["query_id", "item_id"], "left")
    extra_score = F.coalesce("bonus", F.lit(0.0)) if bonus is not None else F.lit(0.0)
    return both.select(
        "query_id",
        "item_id",
        F.coalesce("_s", extra_score).alias("score"),
        F.coalesce("_r", F.coalesce("_n", F.lit(0)) + F.col("_t")).cast("int").alias("rank"),
        F.coalesce("ft_rank", F.lit(limit + 1)).cast("int").alias("ft_rank"),
        "is_new",
    )


def variants(lists: Mapping[str, Sequence[DataFrame]], **options) -> DataFrame:
    """RRF of several sets of lists in one pass, with the column ``variant``."""
    width = max(len(v) for v in lists.values())
    none = next(iter(lists.values()))[0].where("false")
    tagged = [[x.withColumn("variant", F.lit(name)) for x in v] + [none.withColumn("variant", F.lit(name))] * (width - len(v)) for name, v in lists.items()]
    stacked = [reduce(lambda p, q: p.select("variant", "query_id", "item_id", "rank").unionByName(q.select("variant", "query_id", "item_id", "rank")), [t[i] for t in tagged]) for i in range(width)]
    return rrf(stacked, by=("variant", "query_id"), **options)


def overlap(a: DataFrame, b: DataFrame, labels: DataFrame, k: int = 50) -> DataFrame:
    """One row: labelled pairs found by both, only a, only b, none."""
    at = labels.select("query_id", "item_id").distinct()
    for name, x in (("ina", a), ("inb", b)):
        at = at.join(x.where(F.col("rank") <= k).select("query_id", "item_id").distinct().withColumn(name, F.lit(True)), ["query_id", "item_id"], "left")
    ina, inb = F.col("ina").isNotNull(), F.col("inb").isNotNull()
    return at.agg(F.count_if(ina & inb).alias("both"), F.count_if(ina & ~inb).alias("only_a"), F.count_if(~ina & inb).alias("only_b"), F.count_if(~ina & ~inb).alias("none"))


def moved(a: DataFrame, b: DataFrame, labels: DataFrame, k: int = 50) -> DataFrame:
    """(query_id, item_id, move, rank_a, rank_b): labelled items that only one of two systems has in its first ``k``;
    ``in`` if that is b, ``out`` if it is a. Ranks are those of the whole lists, null where the item is in none."""
    at = labels.select("query_id", "item_id").distinct()
    for name, x in (("rank_a", a), ("rank_b", b)):
        at = at.join(x.select("query_id", "item_id", F.col("rank").alias(name)), ["query_id", "item_id"], "left")
    ina, inb = F.coalesce(F.col("rank_a") <= k, F.lit(False)), F.coalesce(F.col("rank_b") <= k, F.lit(False))
    return at.where(ina != inb).select("query_id", "item_id", F.when(inb, "in").otherwise("out").alias("move"), "rank_a", "rank_b")


def same_top(a: DataFrame, b: DataFrame, k: int = 50) -> DataFrame:
    """Per query: shared items of the first ``k`` of two systems, and whether the sets are equal."""
    rows = a.where(F.col("rank") <= k).select("query_id", "item_id", F.lit(1).alias("x")).join(b.where(F.col("rank") <= k).select("query_id", "item_id", F.lit(1).alias("y")), ["query_id", "item_id"], "outer")
    return rows.groupBy("query_id").agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("shared"), (F.count_if(F.col("x").isNull() | F.col("y").isNull()) == 0).alias("equal_sets"))
