"""The whole way from a log, a corpus and queries to an answer file, in the column names of the domain.

Folder: ``train.parquet`` (the log), ``benchmark_items.parquet`` (the corpus), ``benchmark_queries.parquet``. Schemes:
``hybrid`` (retrieval only), ``meta`` (class, filter and feedback bonuses), ``ltr`` (features and rankers fitted on
held-out queries of the log). Any encoder can take the place of the offline one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import filters as P
from .functions import text as X
from .operators import dense as D
from .operators import evaluate as E
from .operators import fusion as U
from .operators import geo as G
from .operators import ml
from .operators import rerank as R
from .operators import sparse as S
from .operators import topk as K
from .operators import windows as W
from .operators.aggregates import class_weights
from .sources import io


@dataclass(frozen=True)
class Config:
    k1: float = 1.5
    b: float = 0.75
    n_cands: int = 300
    top_k: int = 50
    rrf_k: float = 60.0
    rules: dict = field(default_factory=lambda: dict(G.DEFAULTS))
    meta: dict = field(default_factory=lambda: dict(R.META_WEIGHTS))
    desc_chars: int = 500
    vector_size: int = 1 << 12
    held: int = 200
    models: int = 3
    ranker: str = "trees"  # or "linear"
    trees: int = 40
    class_model: str = "logistic"  # or "bayes"


@dataclass
class Data:
    """The tables with short names; ids of items and queries are numbered for the vector search."""

    log: DataFrame
    items: DataFrame
    queries: DataFrame


def load(spark: SparkSession, folder: str) -> Data:
    items = io.coordinates(spark.read.parquet(f"{folder}/benchmark_items.parquet")).select(
        "item_id",
        F.col("item_title_raw").alias("title"),
        F.col("item_infm_params_text").alias("params"),
        F.col("item_description_raw").alias("description"),
        "item_location_id",
        "lat",
        "lon",
        F.col("item_microcat_id").cast("string").alias("class"),
        F.col("item_rating").cast("double").alias("rating"),
        F.col("item_rating_reviews_count").cast("double").alias("reviews"),
        F.col("item_price").cast("double").alias("price"),
        F.col("item_is_phone_hidden").alias("phone_hidden"),
        F.col("item_is_message_forbidden").alias("msg_forbidden"),
    )
    search = [
        "search_query",
        "search_location_id",
        F.col("search_infm_params_text").alias("filters"),
        F.coalesce(F.col("search_is_delivery_search").cast("int"), F.lit(0)).alias("delivery"),
    ]
    log = io.coordinates(spark.read.parquet(f"{folder}/train.parquet")).select(*search, "item_id", "item_location_id", "lat", "lon", F.col("item_microcat_id").cast("string").alias("class"))
    queries = spark.read.parquet(f"{folder}/benchmark_queries.parquet").select("query_id", *search)

    def keyed(df: DataFrame) -> DataFrame:
        df = df.withColumn("text_norm", X.normalise("search_query"))
        return df.withColumn("query_key", X.query_key(F.col("text_norm"), F.col("search_location_id"), F.col("filters")))

    return Data(keyed(log), items, keyed(queries))


class Pipeline:
    def __init__(self, data: Data, config: Config = Config(), encoder: Callable[[DataFrame, str, str], DataFrame] | None = None, work: str | None = None):
        self.data, self.config, self.encoder = data, config, encoder
        self.work, self._step = (work or io.work_folder(data.log.sparkSession)), 0
        self.items = self.keep(data.items.withColumn("doc", X.item_text(F.col("title"), X.clean_params("params"), F.col("description"), config.desc_chars)).withColumn("num", F.xxhash64("item_id")))
        for df, key in ((self.items.select("item_id"), "item_id"), (data.queries.select("query_id"), "query_id")):
            clash = df.groupBy(F.xxhash64(key).alias("num")).agg(F.min(key).alias("a"), F.max(key).alias("b")).where("a <> b")
            E.require_none(clash, f"two values of {key} have one number")

    def keep(self, df: DataFrame) -> DataFrame:
        """``df``, written to the work folder and read back: later steps share it, and their plans stay short."""
        self._step += 1
        return io.stage(df, f"{self.work}/{self._step:03d}")

    def close(self) -> None:
        """Removes the work folder; results of ``run`` that are still needed must have been written elsewhere."""
        io.remove(self.data.log.sparkSession, self.work)

    def maps(self, log: DataFrame) -> dict[str, DataFrame]:
        """Regions, shares and centroids; only ``log`` teaches them, the corpus gives places."""
        places = self.items.select("item_id", "item_location_id", "lat", "lon").unionByName(log.select("item_id", "item_location_id", "lat", "lon"))
        regions = G.regions(log, places)
        regions = self.keep(regions)
        made = {"cent": G.centroids(places), "region_shares": G.region_map(log, regions, self.items), "pairs": G.city_pairs(log, regions, self.items), "shares": G.pair_share(log)}
        return {"regions": regions} | {name: self.keep(df) for name, df in made.items()}

    def pools(self, queries: DataFrame, maps: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
        """Location pairs with tiers, and with bonuses, of all queries by their rule."""
        places = queries.select("search_location_id").distinct()
        kinds = places.join(maps["regions"].withColumn("_r", F.lit(True)), "search_location_id", "left")
        kinds = kinds.withColumn("rule", G.classify(F.col("search_location_id"), F.coalesce("_r", F.lit(False)), self.config.rules))
        tiers = bonus = None
        for rule in sorted(set(self.config.rules.values())):
            own = kinds.where(F.col("rule") == rule)
            t = G.pool(rule, own, maps["regions"], maps["region_shares"], maps["pairs"], maps["cent"], self.items)
            b = G.soft_bonus(rule, own, maps["regions"], maps["region_shares"])
            tiers, bonus = (t, b) if tiers is None else (tiers.unionByName(t), bonus.unionByName(b))
        return self.keep(tiers), self.keep(bonus)

    def _vectors(self, df: DataFrame, key: str, text_col: str) -> DataFrame:
        if self.encoder is not None:
            return self.encoder(df, key, text_col)
        return D.encode(df, key, text_col, self.config.vector_size, idf_from=self.items.select(F.col("doc").alias(text_col)))

    def retrieve(self, queries: DataFrame, log: DataFrame) -> DataFrame:
        """Candidates: query_id, item_id, score, rank, with the sources' scores and global ranks."""
        c, maps = self.config, self.maps(log)
        tiers, bonus = self.pools(queries, maps)
        q = queries.withColumn("num", F.xxhash64("query_id"))
        docs = self.items.select(F.col("num").alias("item_id"), F.col("doc").alias("text"))
        sparse = S.score_all(docs, q.select(F.col("num").alias("query_id"), F.col("search_query").alias("text")), c.k1, c.b)
        sparse = self.keep(sparse.where("score > 0").withColumn("bm25_grank", W.global_rank("score")))
        places = q.select(F.col("num").alias("query_id"), "search_location_id")
        located = sparse.join(places, "query_id").join(self.items.select(F.col("num").alias("item_id"), "item_location_id"), "item_id")
        top_sparse = self.keep(K.pool_top_k(located, tiers, c.n_cands, positive=True).select("query_id", "item_id", "score", "rank"))
        vectors = self._vectors(q.select("num", X.query_text(F.col("search_query"), X.clean_params("filters")).alias("text")), "num", "text").join(q.select("num", "search_location_id"), "num").withColumnRenamed("num", "query_id")
        corpus = self._vectors(self.items.select("num", F.col("doc").alias("text")), "num", "text").join(self.items.select("num", "item_location_id"), "num").withColumnRenamed("num", "item_id")
        vectors, corpus = self.keep(vectors), self.keep(corpus)
        top_dense = self.keep(D.search_pools(vectors, corpus, tiers, c.n_cands))
        both = top_sparse.select("query_id", "item_id").unionByName(top_dense.select("query_id", "item_id")).distinct()
        places = both.join(self.items.select(F.col("num").alias("item_id"), "item_location_id"), "item_id").join(q.select(F.col("num").alias("query_id"), "search_location_id"), "query_id")
        extra = places.join(bonus, ["search_location_id", "item_location_id"]).select("query_id", "item_id", "bonus")
        fused = U.rrf([top_sparse, top_dense], c.rrf_k, c.n_cands, extra)
        key = ["query_id", "item_id"]
        # Every candidate gets both sources' scores and ranks in the whole corpus, from whichever list it comes.
        fused = self.keep(fused)
        cos = D.pair_ranks(D.pair_scores(fused, vectors, corpus), vectors, corpus).select(*key, F.col("score").alias("cos"), F.col("grank").alias("cos_grank"))
        positive = sparse.groupBy("query_id").agg((F.count("*") + 1).alias("after_all"))
        fused = fused.join(sparse.select(*key, F.col("score").alias("bm25"), "bm25_grank"), key, "left").join(cos, key).join(positive, "query_id", "left")
        # What has no common term stands behind all that have one.
        fused = fused.withColumn("bm25_grank", F.coalesce("bm25_grank", "after_all", F.lit(1))).fillna({"bm25": 0.0})
        named = fused.join(self.items.select(F.col("num").alias("item_id"), F.col("item_id").alias("_i")), "item_id").join(q.select(F.col("num").alias("query_id"), F.col("query_id").alias("_q")), "query_id")
        return self.keep(named.select(F.col("_q").alias("query_id"), F.col("_i").alias("item_id"), "score", "rank", "bm25", "bm25_grank", "cos", "cos_grank"))

    def classes(self, queries: DataFrame, log: DataFrame) -> DataFrame:
        """P(class | query) from a model of the log's query documents."""
        rows = log.withColumn("doc", ml.query_document("search_query", "filters"))
        fitted = ml.ClassModel(self.config.class_model).fit(class_weights(rows.select("doc", "class")))
        return self.keep(fitted.predict(queries.withColumn("doc", ml.query_document("search_query", "filters"))))

    def matched(self, cands: DataFrame, queries: DataFrame, classes: DataFrame) -> DataFrame:
        rows = P.filter_match(cands, queries.select("query_id", "filters"), self.items.select("item_id", "params"))
        return self.keep(ml.attach_classes(R.prf(rows, self.items, 20), self.items, classes))

    def rerank_meta(self, cands: DataFrame, queries: DataFrame, log: DataFrame) -> DataFrame:
        return R.meta_bonus(self.matched(cands, queries, self.classes(queries, log)), self.config.meta)

    def features(self, cands: DataFrame, queries: DataFrame, log: DataFrame) -> DataFrame:
        maps = self.maps(log)
        flagged = E.flags(queries, log, maps["regions"]).withColumn("is_country", F.col("search_location_id") == G.COUNTRY)
        anchors = flagged.select("search_location_id", "is_region").distinct().join(G.main_city(maps["shares"]), "search_location_id", "left")
        anchors = anchors.select("search_location_id", F.when(F.col("is_region"), F.col("main_city")).otherwise(F.col("search_location_id")).alias("anchor"))
        rows = P.filter_match(cands, queries.select("query_id", "filters"), self.items.select("item_id", "params"))
        # Without a second encoder its columns stand for the first one's.
        rows = rows.withColumns({"ft_cos": F.col("cos"), "ft_cos_grank": F.col("cos_grank"), "ft_rank": F.col("cos_grank"), "is_new": F.lit(0)})
        cols = ["query_id", "search_query", "filters", "search_location_id", "delivery", "text_in_train", "is_region", "is_country"]
        return self.keep(R.features(rows, self.items.drop("doc", "num"), flagged.select(*cols), maps["shares"], maps["cent"], anchors, self.classes(queries, log)))

    def rerank_ltr(self, cands: DataFrame, queries: DataFrame) -> DataFrame:
        """Rankers of several seeds, fitted on held-out queries of the log, whose rows the features then do not see."""
        log = self.data.log
        corpus = self.items.select("item_id")
        eligible = log.join(corpus, "item_id", "left_semi").select("query_key", "text_norm").distinct().withColumn("stratum", F.lit(0))
        held = self.keep(E.stratified_split(eligible, log.sparkSession.createDataFrame([(0, 1.0)], "stratum int, share double"), self.config.held, ["stratum"]))
        fit = E.without_keys(log, held)
        picked = log.join(held.select("query_key"), "query_key", "left_semi")
        asked = W.first_per(picked, ["query_key"], ["item_id"]).withColumn("query_id", F.col("query_key")).drop("item_id", "item_location_id", "lat", "lon", "class")
        labels = picked.join(corpus, "item_id", "left_semi").select(F.col("query_key").alias("query_id"), "item_id").distinct().withColumn("y", F.lit(1))
        rows = self.features(self.retrieve(asked, fit), asked, fit).join(labels, ["query_id", "item_id"], "left").fillna({"y": 0})
        scored = self.features(cands, queries, log)
        seeds = range(1, self.config.models + 1)
        if self.config.ranker == "trees":
            mean = ml.seed_ensemble(rows, scored, lambda seed: ml.TreeRanker(R.FEATURES, trees=self.config.trees, seed=seed), seeds)
        else:
            wide = scored
            for k in seeds:
                wide = ml.PairwiseRanker(R.FEATURES, seed=k).fit(rows).transform(wide, f"m{k}")
            mean = ml.ensemble(wide, [f"m{k}" for k in seeds])
        mean = self.keep(mean)
        return K.resort(cands.select("query_id", "item_id", "score", "rank").join(mean, ["query_id", "item_id"]), F.round("pred", 9), keep=self.config.n_cands).select("query_id", "item_id", "score", "rank")

    def run(self, scheme: str = "meta") -> DataFrame:
        cands = self.retrieve(self.data.queries, self.data.log)
        if scheme == "hybrid":
            return cands.select("query_id", "item_id", "score", "rank")
        if scheme == "meta":
            return self.rerank_meta(cands, self.data.queries, self.data.log)
        if scheme == "ltr":
            return self.rerank_ltr(cands, self.data.queries)
        raise ValueError(f"no scheme {scheme!r}")
