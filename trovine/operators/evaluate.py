"""Recall and its uncertainty, splits, error classes, invariants."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import seeded_order


class InvalidAnswer(ValueError):
    """An answer breaks a rule of the metric."""


def require_none(bad: DataFrame, message: str) -> None:
    """Raises if ``bad`` has a row, with one as the example."""
    row = bad.limit(1).collect()
    if row:
        raise InvalidAnswer(f"{message}: {row[0].asDict()}")


def unique_and_complete(df: DataFrame, keys: Sequence[str], not_null: Sequence[str] = ()) -> DataFrame:
    """``df``, after a check that ``keys`` are unique and ``not_null`` columns are filled."""
    require_none(df.groupBy(*keys).count().where("count > 1"), "keys repeat")
    for c in not_null:
        require_none(df.where(F.col(c).isNull()), f"{c} is null")
    return df


def recall_at_k(answers: DataFrame, labels: DataFrame, k: int = 50, strict: bool = True) -> DataFrame:
    """(query_id, recall) for every labelled query; one without an answer has 0.

    ``answers``: (query_id, item_id); more than ``k`` items of a query, or an item twice, raise if ``strict``.
    """
    if strict:
        require_none(answers.groupBy("query_id").count().where(F.col("count") > k), f"more than {k} items")
        require_none(answers.groupBy("query_id", "item_id").count().where("count > 1"), "an item repeats")
    hits = labels.select("query_id", "item_id").distinct().join(answers.select("query_id", "item_id").distinct().withColumn("_hit", F.lit(1)), ["query_id", "item_id"], "left")
    return hits.groupBy("query_id").agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("recall"))


def recall_curve(cands: DataFrame, labels: DataFrame, at: Sequence[int] = (10, 50, 100, 300)) -> DataFrame:
    """One row: mean recall at each K; labels outside the candidates count as missed."""
    rows = labels.select("query_id", "item_id").distinct().join(cands.select("query_id", "item_id", "rank"), ["query_id", "item_id"], "left")
    per = rows.groupBy("query_id").agg(*(F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))).alias(f"r{k}") for k in at))
    return per.agg(F.count("*").alias("queries"), *(F.avg(f"r{k}").alias(f"r{k}") for k in at))


def threshold_recall(scored: DataFrame, labels: DataFrame, k: int = 50) -> DataFrame:
    """Recall by the k-th best score: an item counts if it is not below it; an old rank breaks ties by 1e-12 a place."""
    rows = scored.withColumn("_s", F.col("score") - F.col("rank") * F.lit(1e-12))
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("_s"), "rank")))
    last = F.min(F.when(F.col("_r") <= k, F.col("_s"))).over(Window.partitionBy("query_id"))
    return recall_at_k(ranked.withColumn("_last", last).where(F.col("_s") >= F.col("_last")), labels, k, strict=False)


def oracle_ceiling(lists: Sequence[DataFrame], labels: DataFrame, k: int) -> DataFrame:
    """Recall of the union of the lists' first ``k``."""
    rows = None
    for x in lists:
        part = x.where(F.col("rank") <= k).select("query_id", "item_id")
        rows = part if rows is None else rows.unionByName(part)
    return recall_at_k(rows.distinct(), labels, strict=False)


def bootstrap(per_query: DataFrame, metric: str, rounds: int = 2000, seed: int = 0) -> DataFrame:
    """One row: mean, low and high (2.5 and 97.5 percentiles of resampled means).

    Every query gets in every round a Poisson(1) weight from an MD5 of (seed, round, query), so the rounds are
    independent of partitioning and are sums that combine before the shuffle.
    """
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("round").cast("string"), F.col("query_id").cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    # The distribution function of a Poisson variable of mean 1, to 1e-8.
    cdf = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975, 0.99999887, 0.99999989)
    weight = sum((u >= c).cast("int") for c in cdf)
    rows = per_query.select("query_id", F.col(metric).alias("m"), F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")).withColumn("w", weight)
    means = rows.groupBy("round").agg((F.sum(F.col("m") * F.col("w")) / F.nullif(F.sum("w"), F.lit(0))).alias("mean"))
    ci = means.agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"))
    return per_query.agg(F.count("*").alias("queries"), F.avg(metric).alias("mean")).crossJoin(ci)  # one row each


def paired(a: DataFrame, b: DataFrame, metric: str = "recall") -> DataFrame:
    """(query_id, diff) for ``bootstrap``."""
    return a.select("query_id", F.col(metric).alias("_a")).join(b.select("query_id", F.col(metric).alias("_b")), "query_id").select("query_id", (F.col("_a") - F.col("_b")).alias("diff"))


def stratified_split(eligible: DataFrame, target: DataFrame, n: int, strata: Sequence[str], seed: int = 42) -> DataFrame:
    """Keys for a hold-out that is like ``target`` (strata, share): (query_key, text_norm, strata).

    One key a text, in seeded order; a stratum's quota is its share of ``n``, rounded half to even; what rounding leaves
    goes to the largest stratum; a stratum with fewer keys gives all.
    """
    one = eligible.withColumn("_o", seeded_order("query_key", seed=seed))
    one = one.withColumn("_r", F.row_number().over(Window.partitionBy("text_norm").orderBy("_o", "query_key"))).where("_r = 1")
    everything = Window.partitionBy(F.lit(0))  # a row per stratum
    quota = target.withColumn("_q", F.bround(F.col("share") * n).cast("long"))
    first = F.row_number().over(everything.orderBy(F.desc("share"), *strata))
    quota = quota.withColumn("_q", F.col("_q") + F.when(first == 1, F.lit(n) - F.sum("_q").over(everything)).otherwise(0))
    placed = one.withColumn("_p", F.row_number().over(Window.partitionBy(*strata).orderBy(F.md5(F.concat(F.lit("s"), "_o")), "query_key")))
    return placed.join(quota.select(*strata, "_q"), list(strata)).where(F.col("_p") <= F.col("_q")).select("query_key", "text_norm", *strata)


def text_folds(queries: DataFrame, folds: int = 5, seed: int = 42, unseen: float = 0.6) -> DataFrame:
    """(text_norm, fold, mode): folds by a hash of the text; mode says whether the text is new to the rest of the log.

    ``queries``: text_norm, other (queries of the text outside the pool). Texts without others are unseen_nat; of the
    rest, those with the fewest others are unseen_forced until the wanted share is met.
    """
    texts = queries.groupBy("text_norm").agg(F.max("other").alias("other"))
    order = seeded_order("text_norm", seed=seed)
    texts = texts.withColumn("fold", (F.conv(F.substring(order, 1, 8), 16, 10).cast("long") % folds).cast("int")).withColumn("_o", order)
    row = texts.agg(F.count("*"), F.count_if(F.col("other") == 0)).first()
    need = max(0, int(unseen * row[0]) - row[1])
    forced = texts.where("other > 0").orderBy("other", "_o", "text_norm").limit(need).select("text_norm", F.lit(True).alias("_f"))
    mode = F.when(F.col("other") == 0, "unseen_nat").when(F.col("_f"), "unseen_forced").otherwise("seen")
    return texts.join(forced, "text_norm", "left").select("text_norm", "fold", mode.alias("mode"))


def excluded_folds(log: DataFrame, query_folds: DataFrame, texts: DataFrame) -> DataFrame:
    """``log`` with excl_fold: the fold whose training must not see the row, or -1.

    Rows of a pool query go with its fold; rows of a forced text with the text's. ``query_folds``: query_key, fold.
    """
    forced = texts.where("mode = 'unseen_forced'").select("text_norm", F.col("fold").alias("_tf"))
    rows = log.join(query_folds.select("query_key", F.col("fold").alias("_qf")), "query_key", "left").join(forced, "text_norm", "left")
    return rows.withColumn("excl_fold", F.coalesce("_qf", "_tf", F.lit(-1)).cast("int")).drop("_qf", "_tf")


def without_keys(log: DataFrame, held: DataFrame, key: str = "query_key") -> DataFrame:
    """Training rows: no row of a held-out key. A key, not a row's position, decides."""
    return log.join(held.select(key).distinct(), key, "left_anti")


def flags(queries: DataFrame, train_texts: DataFrame, region_ids: DataFrame) -> DataFrame:
    """Queries with text_in_train, has_filter and is_region relative to the given training texts."""
    from ..functions.text import has_filter

    seen = train_texts.select("text_norm").distinct().withColumn("_t", F.lit(True))
    region = region_ids.select("search_location_id").distinct().withColumn("_r", F.lit(True))
    rows = queries.join(seen, "text_norm", "left").join(region, "search_location_id", "left")
    return rows.withColumn("text_in_train", F.col("_t").isNotNull()).withColumn("has_filter", has_filter("filters")).withColumn("is_region", F.col("_r").isNotNull()).drop("_t", "_r")


def sampling_schemes(log: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """Mean log10 frequency of texts that three sampling schemes draw: by text, by query, by row."""
    rows = log.select("text_norm", "query_key", "row_id")
    freq = rows.groupBy("text_norm").agg(F.count("*").alias("n"))

    def draw(keys: Sequence[str], name: str) -> DataFrame:
        picked = rows.select("text_norm", *[k for k in keys if k != "text_norm"]).distinct().orderBy(seeded_order(*keys, seed=seed), *keys).limit(n)
        return picked.join(freq, "text_norm").agg(F.lit(name).alias("scheme"), F.count("*").alias("drawn"), F.avg(F.log10(F.col("n").cast("double"))).alias("log_freq"))

    return draw(["text_norm"], "text").unionByName(draw(["query_key"], "query")).unionByName(draw(["row_id"], "row"))


def leak_check(pool: DataFrame, val: DataFrame, features: Sequence[str], strata: Sequence[str]) -> DataFrame:
    """Means of the positives' features in matched strata of training pool and validation, and their difference."""
    def means(df: DataFrame, tag: str) -> DataFrame:
        return df.where("y = 1").groupBy(*strata).agg(F.count("*").alias(f"n_{tag}"), *(F.avg(f).alias(f"{f}_{tag}") for f in features))

    both = means(pool, "pool").join(means(val, "val"), list(strata))
    return both.select(*strata, "n_pool", "n_val", *(c for f in features for c in (f"{f}_pool", f"{f}_val", (F.col(f"{f}_pool") - F.col(f"{f}_val")).alias(f"{f}_diff"))))


def first_matching(classes: Mapping[str, Column], otherwise: str = "other") -> Column:
    """The name of the first class whose condition holds."""
    out = None
    for name, condition in classes.items():
        out = F.when(condition, name) if out is None else out.when(condition, name)
    return out.otherwise(otherwise)


def best_rank_buckets(cands: DataFrame, labels: DataFrame, edges: Sequence[int] = (50, 100, 200, 300)) -> DataFrame:
    """(bucket, n): labelled queries by the best rank of a label; ``absent`` if none is among the candidates."""
    best = labels.select("query_id", "item_id").distinct().join(cands.select("query_id", "item_id", "rank"), ["query_id", "item_id"], "left").groupBy("query_id").agg(F.min("rank").alias("r"))
    name = F.when(F.col("r").isNull(), "absent")
    for e in edges:
        name = name.when(F.col("r") <= e, f"<={e}")
    return best.groupBy(name.otherwise(f">{edges[-1]}").alias("bucket")).agg(F.count("*").alias("n"))


def twins(cands: DataFrame, items: DataFrame, labels: DataFrame, k: int = 50) -> DataFrame:
    """Labelled items missed by the first ``k`` that have a twin (same title and location) there: (query_id, item_id)."""
    keyed = items.select("item_id", "title_key", "item_location_id")
    top = cands.where(F.col("rank") <= k).select("query_id", "item_id")
    missed = labels.select("query_id", "item_id").distinct().join(top, ["query_id", "item_id"], "left_anti").join(keyed, "item_id")
    shown = top.join(keyed, "item_id").select("query_id", "title_key", "item_location_id").distinct()
    return missed.join(shown, ["query_id", "title_key", "item_location_id"], "left_semi").select("query_id", "item_id")


def rank_neighbours(cands: DataFrame, targets: DataFrame, reach: int = 10) -> DataFrame:
    """Candidates within ``reach`` places of a target (query_id, item_id) of their query: (query_id, target, item_id, rank)."""
    at = targets.join(cands.select("query_id", "item_id", F.col("rank").alias("_r0")), ["query_id", "item_id"]).select("query_id", F.col("item_id").alias("target"), "_r0")
    # Blocks of reach + 1 places: neighbours are in the same block or the next, so the join is on keys.
    width = reach + 1
    at = at.withColumn("_b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("_r0") / width) + d)))
    rows = cands.withColumn("_b", F.floor(F.col("rank") / width)).join(at, ["query_id", "_b"])
    return rows.where(F.abs(F.col("rank") - F.col("_r0")) <= reach).select("query_id", "target", "item_id", "rank")
