"""Top-k with tiers, fallbacks and quotas. Ties go by item id, ascending."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import head, renumber


def top_k(scored: DataFrame, k: int, by: Sequence[str] = ("query_id",), positive: bool = False) -> DataFrame:
    """The ``k`` best by score, with rank. ``positive``: only scores above 0, as for term matching."""
    rows = scored.where("score > 0") if positive else scored
    best = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "item_id")))
    return best.where(F.col("rank") <= k)


def tiered_top_k(scored: DataFrame, tiers: DataFrame, k: int, positive: bool = False, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """Best of tier 0, then of tier 1, ..., then of the rest of the corpus, up to ``k`` a query.

    ``tiers``: (query_id, item_id, tier); the lowest tier of an item counts. Adds rank and from_tier (0/1). ``scored``
    is cut to the k best of each tier below the shuffle.
    """
    low = tiers.groupBy(*by, "item_id").agg(F.min("tier").alias("tier"))
    rows = (scored.where("score > 0") if positive else scored).join(low, [*by, "item_id"], "left")
    rows = rows.withColumn("tier", F.coalesce("tier", F.lit(2**30)))
    best = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("tier", F.desc("score"), "item_id")))
    return best.where(F.col("rank") <= k).withColumn("from_tier", (F.col("tier") < 2**30).cast("int"))


def pool_top_k(scored: DataFrame, pool: DataFrame, k: int, positive: bool = False) -> DataFrame:
    """As ``tiered_top_k``, with tiers by place: ``scored`` has search_location_id and item_location_id, ``pool``
    (search_location_id, item_location_id, tier). The scores are made once, and joined with place pairs, not with items."""
    places = ["search_location_id", "item_location_id"]
    low = pool.groupBy(*places).agg(F.min("tier").alias("tier"))
    rows = (scored.where("score > 0") if positive else scored).join(low, places, "left").withColumn("tier", F.coalesce("tier", F.lit(2**30)))
    best = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("tier", F.desc("score"), "item_id")))
    return best.where(F.col("rank") <= k).withColumn("from_tier", (F.col("tier") < 2**30).cast("int"))


def city_first(scored: DataFrame, queries: DataFrame, k: int, mode: str = "geo", positive: bool = False) -> DataFrame:
    """One tier: items of the query's own location before all others (``geo``), or no tiers (``all``).

    ``scored``: query_id, item_id, item_location_id, score; ``queries``: query_id, search_location_id.
    """
    if mode == "all":
        return top_k(scored, k, positive=positive)
    own = scored.join(queries.select("query_id", "search_location_id"), "query_id").where(F.col("item_location_id") == F.col("search_location_id"))
    return tiered_top_k(scored, own.select("query_id", "item_id", F.lit(0).alias("tier")), k, positive)


def fill(lists: Sequence[DataFrame], k: int, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """Exactly up to ``k`` items a query from lists (query_id, item_id, rank) by priority; an item counts once."""
    tagged = [x.select(*by, "item_id", F.lit(i).alias("source"), "rank") for i, x in enumerate(lists)]
    first = reduce(DataFrame.unionByName, tagged).groupBy(*by, "item_id").agg(F.min(F.struct("source", "rank")).alias("p"))
    placed = renumber(first.select(*by, "item_id", F.col("p.source").alias("source"), F.col("p.rank").alias("old")), ["source", "old", "item_id"], by)
    return placed.where(F.col("rank") <= k).select(*by, "item_id", "source", "rank")


def fill_global(queries: DataFrame, personal: Sequence[DataFrame], everyone: DataFrame, k: int) -> DataFrame:
    """``fill`` where the last list (item_id, rank) is the same for all queries: only its first k matter."""
    common = everyone.where(F.col("rank") <= k)
    spread = queries.select("query_id").distinct().withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(k)))).join(common.withColumnRenamed("rank", "_r"), "_r").withColumnRenamed("_r", "rank")
    return fill([*personal, spread.select("query_id", "item_id", "rank")], k)


def resort(cands: DataFrame, new_score: Column, keep: int | None = None) -> DataFrame:
    """Candidates by a new score, equal ones in their old order."""
    rows = cands.withColumn("_new", new_score).withColumn("_old", F.col("rank")).drop("rank", "score")
    out = renumber(rows, [F.desc("_new"), "_old", "item_id"]).withColumnRenamed("_new", "score").drop("_old")
    return out.where(F.col("rank") <= keep) if keep else out


def quota(cands: DataFrame, reserve: int = 5, top: int = 50, match: str = "m_all", active: str = "q_any") -> DataFrame:
    """In the first ``top`` places the best matching items, then ``reserve`` others; either side lends free places.

    Queries without ``active`` keep their order. The rest follows in the old order.
    """
    q = Window.partitionBy("query_id")
    kind = Window.partitionBy("query_id", match).orderBy("rank", "item_id")
    rows = cands.withColumn("_in", F.row_number().over(kind)).withColumn("_m", F.count_if(F.col(match)).over(q)).withColumn("_n", F.count_if(~F.col(match)).over(q))
    take_m = F.least(F.col("_m"), F.lit(top) - F.least(F.lit(reserve), F.col("_n")))
    take_n = F.least(F.lit(top) - take_m, F.col("_n"))
    place = F.when(~F.col(active), 0).when(F.col(match) & (F.col("_in") <= take_m), 1).when(~F.col(match) & (F.col("_in") <= take_n), 2).otherwise(3)
    rows = rows.withColumn("_class", place).withColumn("_old", F.col("rank")).drop("rank")
    out = renumber(rows, ["_class", "_old", "item_id"])
    return out.drop("_in", "_m", "_n", "_class", "_old").withColumn("score", 1 / (60 + F.col("rank")))


def top_lists(cands: DataFrame, k: int) -> DataFrame:
    """(query_id, items): ids of the first ``k`` in rank order."""
    rows = cands.where(F.col("rank") <= k).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id"))).alias("x"))
    return rows.select("query_id", F.transform("x", lambda s: s["item_id"]).alias("items"))


def random_subset(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` keys in seeded order: a smaller n gives a subset of a larger one's."""
    from ..functions.numeric import seeded_order

    keys = df.select(key).distinct().orderBy(seeded_order(key, seed=seed), key).limit(n)
    return df.join(keys, key, "left_semi")


__all__ = ["top_k", "tiered_top_k", "pool_top_k", "city_first", "fill", "fill_global", "resort", "quota", "top_lists", "random_subset", "head"]
