"""Class probabilities, rankers, cross-fitting, ensembles and training pairs, on pyspark.ml."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filters import core_filters, parse_filters
from ..functions.numeric import seeded_order
from ..functions.text import text
from .ngrams import Vectorizer
from .windows import zscore


def query_document(query: str | Column, filters: str | Column) -> Column:
    """Text for the classifier: the query and the values of its core filters."""
    core = F.array_join(F.flatten(F.map_values(core_filters(parse_filters(filters)))), " ")
    return F.translate(F.lower(F.regexp_replace(F.concat(text(query), F.lit(" | "), core), r"^[ |]+|[ |]+$", "")), "ё", "е")


class ClassModel:
    """TF-IDF (tf as 1 + ln tf) of word and character n-grams, and a probabilistic classifier: the log-loss model, or bayes."""

    def __init__(self, kind: str = "logistic", words: int = 100_000, chars: int = 100_000):
        self.kind, self.sizes = kind, (words, chars)

    def fit(self, rows: DataFrame) -> ClassModel:
        """``rows``: doc, class, w. The vocabularies, of bounded size, are on the driver."""
        from ..sources.io import remove, stage, work_folder

        spark, folder = rows.sparkSession, work_folder(rows.sparkSession)
        # Whole texts make much work of few rows: they are dealt out, once for the passes to come.
        data = stage(rows.where("class IS NOT NULL").repartition(spark.sparkContext.defaultParallelism), f"{folder}/rows")
        self.index = StringIndexer(inputCol="class", outputCol="_y", stringOrderType="alphabetAsc").fit(data)
        self.vectors = Vectorizer(self.sizes).fit(data, "doc", folder)
        data = self.vectors.transform(self.index.transform(data).select("_y", "w", "doc"), "doc")
        if self.kind == "logistic":
            model = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="w", probabilityCol="_p", maxIter=30, regParam=1e-3, family="multinomial")
        else:
            model = NaiveBayes(featuresCol="_x", labelCol="_y", weightCol="w", probabilityCol="_p", smoothing=0.1)
        self.model = model.fit(data.select("_x", "_y", "w"))
        remove(spark, folder)
        return self

    def predict(self, docs: DataFrame, id_col: str = "query_id") -> DataFrame:
        """(id, class, p, class_rank) for every class, p summing to 1; distinct texts are scored once."""
        texts = self.model.transform(self.vectors.transform(docs.select("doc").distinct(), "doc"))
        names = F.array(*(F.lit(x) for x in self.index.labels))
        scored = texts.select("doc", F.explode(F.arrays_zip(names.alias("class"), vector_to_array("_p").alias("p"))).alias("x")).select("doc", F.col("x.class"), F.col("x.p"))
        ranked = scored.withColumn("class_rank", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("p"), "class")))
        return docs.select(id_col, "doc").join(ranked, "doc").select(id_col, "class", "p", "class_rank")


def count_classes(log: DataFrame, smoothing: float = 1.0) -> DataFrame:
    """(search_query, class, p, class_rank) from counts: (n + smoothing) / (total + smoothing x classes seen with it)."""
    n = log.groupBy("search_query", "class").agg(F.count("*").alias("n"))
    w = Window.partitionBy("search_query")
    p = (F.col("n") + smoothing) / (F.sum("n").over(w) + smoothing * F.count("*").over(w))
    rows = n.withColumn("p", p)
    return rows.withColumn("class_rank", F.row_number().over(w.orderBy(F.desc("p"), "class"))).select("search_query", "class", "p", "class_rank")


def attach_classes(cands: DataFrame, items: DataFrame, classes: DataFrame, unknown: int = 10_000) -> DataFrame:
    """Candidates with p_mc and mc_rank of their item's class."""
    rows = cands.join(items.select("item_id", "class"), "item_id", "left").join(classes.select("query_id", "class", "p", "class_rank"), ["query_id", "class"], "left")
    return rows.withColumn("p_mc", F.coalesce("p", F.lit(0.0))).withColumn("mc_rank", F.coalesce("class_rank", F.lit(unknown))).drop("p", "class_rank", "class")


class PairwiseRanker:
    """A linear ranker: logistic regression on differences of features within a query.

    Each positive is paired with ``negatives`` seeded candidates of its query, so pairs grow with the positives. Features
    are standardised; nulls are 0 after that.
    """

    def __init__(self, features: Sequence[str], negatives: int = 8, reg: float = 1e-4, seed: int = 1):
        self.features, self.negatives, self.reg, self.seed = list(features), negatives, reg, seed

    def _scaled(self, df: DataFrame) -> Column:
        cells = [F.coalesce((F.col(f).cast("double") - F.lit(m)) / F.lit(s), F.lit(0.0)) for f, (m, s) in zip(self.features, self.scale, strict=True)]
        return F.array(*cells)

    def fit(self, rows: DataFrame) -> PairwiseRanker:
        """``rows``: query_id, item_id, y (0/1), features."""
        stats = rows.agg(*(x for f in self.features for x in (F.avg(f), F.stddev_samp(f)))).first()
        self.scale = [(stats[2 * i] or 0.0, stats[2 * i + 1] or 1.0) for i in range(len(self.features))]
        data = rows.select("query_id", "item_id", "y", self._scaled(rows).alias("x"))
        order = Window.partitionBy("query_id").orderBy(seeded_order("query_id", "item_id", seed=self.seed), "item_id")
        neg = data.where("y = 0").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= self.negatives)
        pairs = data.where("y = 1").select("query_id", F.col("x").alias("a")).join(neg.select("query_id", "_n", F.col("x").alias("b")), "query_id")
        sign = F.when(F.col("_n") % 2 == 0, -1.0).otherwise(1.0)
        diff = pairs.select(F.zip_with("a", "b", lambda p, q: p - q).alias("d"), sign.alias("s")).select(array_to_vector(F.transform("d", lambda v: v * F.col("s"))).alias("features"), F.when(F.col("s") > 0, 1.0).otherwise(0.0).alias("label"))
        model = LogisticRegression(fitIntercept=False, regParam=self.reg, maxIter=50, standardization=False).fit(diff)
        self.weights = model.coefficients.toArray().tolist()
        return self

    def transform(self, rows: DataFrame, name: str = "pred") -> DataFrame:
        w = F.array(*(F.lit(x) for x in self.weights))
        return rows.withColumn(name, F.aggregate(F.zip_with(self._scaled(rows), w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))

    def importance(self) -> dict[str, float]:
        """Absolute weights of the standardised features."""
        return {f: abs(w) for f, w in zip(self.features, self.weights, strict=True)}


class SoftmaxRanker(PairwiseRanker):
    """Conditional logit: softmax over a query's candidates; gradients by aggregation, steps on the driver."""

    def fit(self, rows: DataFrame, steps: int = 100, tolerance: float = 1e-5) -> SoftmaxRanker:
        """L-BFGS on the exact gradient until no part of it is above ``tolerance``; ``steps`` at most."""
        from ..sources.io import remove, stage, work_folder

        stats = rows.agg(*(x for f in self.features for x in (F.avg(f), F.stddev_samp(f)))).first()
        self.scale = [(stats[2 * i] or 0.0, stats[2 * i + 1] or 1.0) for i in range(len(self.features))]
        n, q = len(self.features), Window.partitionBy("query_id")
        folder = work_folder(rows.sparkSession)
        has = rows.withColumn("_any", F.max("y").over(q)).where("_any > 0")
        data = stage(has.select("query_id", "y", self._scaled(has).alias("x")), folder)
        queries = max(1, data.select("query_id").distinct().count())

        def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
            s = F.aggregate(F.zip_with("x", F.array(*(F.lit(float(v)) for v in w)), lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)
            e = data.withColumn("s", s).withColumn("e", F.exp(F.col("s") - F.max("s").over(q)))
            share = F.col("e") / F.sum("e").over(q)
            r = e.withColumn("t", F.col("y") / F.sum("y").over(q)).withColumn("p", share)
            row = r.agg(-F.sum(F.col("t") * F.log("p")), *(F.sum((F.col("p") - F.col("t")) * F.col("x")[i]) for i in range(n))).first()
            return (row[0] or 0.0) / queries + self.reg / 2 * float(w @ w), np.array([g or 0.0 for g in row[1:]]) / queries + self.reg * w

        self.weights = lbfgs(loss, np.zeros(n), steps, tolerance).tolist()
        remove(rows.sparkSession, folder)
        return self


def lbfgs(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, steps: int, tolerance: float, memory: int = 8) -> np.ndarray:
    """The minimum of a smooth function from its value and gradient: limited-memory BFGS with halved steps."""
    value, grad = loss(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        if np.abs(grad).max(initial=0) <= tolerance:
            break
        d, used = grad.copy(), []
        for s, y, rho in reversed(past):
            a = rho * (s @ d)
            used.append(a)
            d -= a * y
        if past:
            d *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1])
        for (s, y, rho), a in zip(past, reversed(used), strict=True):
            d += (a - rho * (y @ d)) * s
        size = 1.0 if past else min(1.0, 1 / np.abs(grad).sum())
        while True:
            new = w - size * d
            v, g = loss(new)
            if v <= value - 1e-4 * size * (grad @ d) or size < 1e-8:
                break
            size /= 2
        if (new - w) @ (g - grad) > 1e-12:
            past = [*past, (new - w, g - grad, 1 / ((new - w) @ (g - grad)))][-memory:]
        if size < 1e-8:
            break
        w, value, grad = new, v, g
    return w


def _pull(y: np.ndarray, score: np.ndarray, truncation: int, g: np.ndarray, h: np.ndarray) -> None:
    """Adds LambdaRank's gradients and curvatures of one query's rows, which are in the order of their ids, to ``g`` and ``h``."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return
    place = np.empty(len(y), np.int64)
    place[np.argsort(-score, kind="stable")] = np.arange(1, len(y) + 1)
    gain, most = 1 / np.log2(place + 1.0), (1 / np.log2(np.arange(2, len(good) + 2))).sum()
    step = max(1, 4_000_000 // len(good))
    for at in range(0, len(bad), step):
        own = bad[at : at + step]
        with np.errstate(over="ignore"):
            rho = 1 / (1 + np.exp(score[good][None, :] - score[own][:, None]))
        change = np.abs(gain[good][None, :] - gain[own][:, None]) / most
        change[(place[own][:, None] > truncation) & (place[good][None, :] > truncation)] = 0.0
        pull, bend = rho * change, rho * (1 - rho) * change
        g[good] += pull.sum(0)
        h[good] += bend.sum(0)
        g[own] -= pull.sum(1)
        h[own] += bend.sum(1)


class TreeRanker:
    """Boosted trees on LambdaRank gradients, with truncation, early stopping and seeds.

    A round ranks each query's candidates by their score and sums over its pairs of a positive and another, of which one
    at least stands in the first ``truncation`` places, the gradient and the curvature of the pair's logistic loss, times
    what an exchange of the two would change of the query's NDCG. A tree fitted on gradient / curvature with the curvature
    as weight has Newton's steps as its leaves. Features that are null are below all others. Rows and columns are sampled
    by the seed. Scores are written to the work folder every round, so plans do not grow.
    """

    MISSING = -1e9

    def __init__(self, features: Sequence[str], trees: int = 40, depth: int = 4, rate: float = 0.1, truncation: int = 50, patience: int = 8, seed: int = 1, sample: float = 0.8, columns: float = 0.8, least: int = 10):
        self.features, self.trees, self.depth, self.rate, self.truncation, self.patience = list(features), trees, depth, rate, truncation, patience
        self.seed, self.sample, self.columns, self.least = seed, sample, columns, least

    def _array(self) -> Column:
        return F.array(*(F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(None)), F.lit(self.MISSING)) for f in self.features))

    def _vector(self) -> Column:
        return array_to_vector(self._array())

    def gradients(self, data: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
        """query_id, item_id, g, h of ``data`` (query_id, item_id, y, score), and its columns ``carry``; rows without a pair are
        left out. A query's pairs are a block in memory of its places times its positives, never rows."""
        lists = data.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("item_id", "y", "score", *carry))).alias("x"))
        types, truncation = dict(data.dtypes), self.truncation

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for big in batches:
                for at in range(0, len(big), 64):
                    batch = big.slice(at, 64)
                    rows, sizes = batch.column(1).flatten(), batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
                    y, score = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("y", "score"))
                    g, h, low = np.zeros(len(rows)), np.zeros(len(rows)), 0
                    for n in sizes.tolist():
                        own = slice(low, low + n)
                        _pull(y[own], score[own], truncation, g[own], h[own])
                        low += n
                    kept = pa.array(np.flatnonzero(h > 0))
                    ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(batch)), sizes))).take(kept)
                    cells = [rows.field(c).take(kept) for c in ("item_id", *carry)]
                    yield pa.RecordBatch.from_arrays([ids, *cells, pa.array(g).take(kept), pa.array(h).take(kept)], ["query_id", "item_id", *carry, "g", "h"])

        return lists.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in ("query_id", "item_id", *carry)) + ", g double, h double")

    @staticmethod
    def ndcg(scored: DataFrame, k: int = 50) -> float:
        """Mean NDCG@k over queries with a positive."""
        ranked = scored.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")))
        per = ranked.groupBy("query_id").agg(F.sum(F.when(F.col("_r") <= k, F.col("y") / F.log2(F.col("_r") + 1.0)).otherwise(0.0)).alias("d"), F.least(F.sum("y"), F.lit(k)).cast("int").alias("n")).where("n > 0")
        ideal = F.aggregate(F.sequence(F.lit(1), F.col("n")), F.lit(0.0), lambda s, n: s + 1 / F.log2(n + 1.0))
        return per.agg(F.avg(F.col("d") / ideal)).first()[0] or 0.0

    def fit(self, rows: DataFrame, valid: DataFrame | None = None) -> TreeRanker:
        """``rows``: query_id, item_id, y (0/1), features. With ``valid`` the rounds end when its NDCG has not risen for
        ``patience`` of them, and the trees after the best round are dropped."""
        from ..sources.io import remove, stage, work_folder

        spark, folder = rows.sparkSession, work_folder(rows.sparkSession)

        def start(df: DataFrame, name: str) -> DataFrame:
            return stage(df.select("query_id", "item_id", "y", self._array().alias("x"), F.lit(0.0).alias("score")), f"{folder}/{name}")

        data, held = start(rows, "rows"), start(valid, "valid") if valid is not None else None
        trees, best, kept = [], -1.0, 0
        for k in range(self.trees):
            # Written once: a tree's growth reads it several times.
            target = stage(self.gradients(data, ("x",)).select("x", (F.col("g") / F.col("h")).alias("t"), "h"), f"{folder}/target-{k}")
            target = target.select(array_to_vector("x").alias("features"), "t", "h")
            grow = RandomForestRegressor(labelCol="t", weightCol="h", numTrees=1, maxDepth=self.depth, minInstancesPerNode=self.least, maxBins=64, bootstrap=False,
                                         subsamplingRate=self.sample, featureSubsetStrategy=str(self.columns), seed=self.seed * 1000 + k)
            tree = grow.fit(target).trees[0]
            trees.append(tree)

            def step(df: DataFrame, name: str, tree=tree, k=k) -> DataFrame:
                moved = tree.transform(df.withColumn("features", array_to_vector("x")))
                return stage(moved.select("query_id", "item_id", "y", "x", (F.col("score") + self.rate * F.col("prediction")).alias("score")), f"{folder}/{name}-{k}")

            remove(spark, f"{folder}/target-{k}")
            data = step(data, "rows")
            if held is not None:
                held = step(held, "valid")
                now = self.ndcg(held)
                if now > best:
                    best, kept = now, k + 1
                elif k + 1 - kept >= self.patience:
                    break
        trees = trees[:kept] if held is not None else trees
        jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        own = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees))
        weights = gateway.new_array(jvm.double, len(trees))
        for k, tree in enumerate(trees):
            own[k], weights[k] = tree._java_obj, self.rate
        self.model = GBTRegressionModel(jvm.org.apache.spark.ml.regression.GBTRegressionModel(f"lambda-{self.seed}", own, weights))
        remove(spark, folder)
        return self

    def transform(self, rows: DataFrame, name: str = "pred") -> DataFrame:
        scored = self.model.transform(rows.withColumn("features", self._vector()))
        return scored.withColumn(name, F.col("prediction")).drop("features", "prediction")

    def importance(self) -> dict[str, float]:
        return dict(zip(self.features, self.model.featureImportances.toArray().tolist(), strict=True))


def seed_ensemble(rows: DataFrame, scored: DataFrame, make: Callable[[int], TreeRanker], seeds: Sequence[int], folds: int = 5, by: str = "query_id") -> DataFrame:
    """query_id, item_id, pred: mean of within-query z-scores of one ranker a seed, each stopped early on its own fold.

    Folds are of ``by`` (a text, so that equal texts are in one), in seeded order; a ranker is not fitted on its fold.
    """
    fold = (F.conv(F.substring(seeded_order(by, seed=11), 1, 6), 16, 10).cast("long") % folds).alias("_fold")
    data, wide = rows.select("*", fold), scored
    for k, seed in enumerate(seeds):
        ranker = make(seed).fit(data.where(F.col("_fold") != k % folds), data.where(F.col("_fold") == k % folds))
        wide = ranker.transform(wide, f"_m{k}")
    return ensemble(wide, [f"_m{k}" for k in range(len(seeds))])


def peeking_auc(pool: DataFrame, val: DataFrame, features: Sequence[str], parts: int = 2) -> float:
    """How well a classifier tells the positives of the training pool from those of the validation: 0.5 is no leak.

    A logistic model on the standardised features, fitted on the queries of one half by MD5 and tested on the other.
    """
    both = pool.where("y = 1").select("query_id", *features, F.lit(0.0).alias("_l")).unionByName(val.where("y = 1").select("query_id", *features, F.lit(1.0).alias("_l")))
    cells = F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features))
    half = F.conv(F.substring(seeded_order("query_id", seed=4), 1, 6), 16, 10).cast("long") % parts
    data = both.select(array_to_vector(cells).alias("features"), "_l", half.alias("_h"))
    model = LogisticRegression(labelCol="_l", regParam=1e-3, maxIter=50).fit(data.where("_h > 0"))
    # The area from counts of scores rounded to 1e-4: at most 10 001 of them are ordered.
    p = F.round(vector_to_array("probability")[1], 4)
    cells = model.transform(data.where("_h = 0")).groupBy(p.alias("p")).agg(F.sum("_l").alias("pos"), F.sum(1 - F.col("_l")).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    row = cells.withColumn("won", F.col("pos") * (below + F.col("neg") / 2)).agg(F.sum("won"), F.sum("pos"), F.sum("neg")).first()
    return row[0] / (row[1] * row[2]) if row[1] and row[2] else 0.5


def cross_fit(rows: DataFrame, make: Callable[[], PairwiseRanker], folds: int = 2, seed: int = 3, keep: Sequence[str] = ()) -> DataFrame:
    """(query_id, item_id, fold, pred, keep): each query is scored by a model that has not seen its fold."""
    fold = (F.conv(F.substring(seeded_order("query_id", seed=seed), 1, 6), 16, 10).cast("long") % folds).cast("int")
    data = rows.withColumn("fold", fold)
    parts = [make().fit(data.where(F.col("fold") != k)).transform(data.where(F.col("fold") == k)).select("query_id", "item_id", "fold", "pred", *keep) for k in range(folds)]
    return reduce(DataFrame.unionByName, parts)


def ensemble(preds: DataFrame, models: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Mean of within-query z-scores (epsilon 1e-9) of several predictions: query_id, item_id, pred, and the columns ``keep``."""
    z = [F.coalesce(zscore(m, epsilon=1e-9), F.lit(0.0)) for m in models]
    return preds.select("query_id", "item_id", (sum(z[1:], z[0]) / len(z)).alias("pred"), *keep)


def permutation_importance(rows: DataFrame, ranker: PairwiseRanker, metric: Callable[[DataFrame], float], seed: int = 5) -> dict[str, float]:
    """Loss of ``metric`` (of scored rows) when a feature's values are dealt out anew within each query."""
    from ..sources.io import stage, work_folder

    # All features are dealt out in one order: the rows by item and those by seed, side by side, of each query at once.
    names = [f"_d{n}" for n in range(len(ranker.features))]
    values = [F.col(f).alias(d) for f, d in zip(ranker.features, names, strict=True)]
    by_item, by_seed = F.struct("item_id", F.struct(*rows.columns).alias("_r")), F.struct(seeded_order("item_id", seed=seed).alias("_o"), "item_id", F.struct(*values).alias("_v"))
    both = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(by_item)).alias("_a"), F.sort_array(F.collect_list(by_seed)).alias("_b"))
    placed = both.select(F.explode(F.arrays_zip("_a", "_b")).alias("_x")).select("_x._a._r.*", "_x._b._v.*")
    dealt = stage(placed, work_folder(rows.sparkSession))
    base = metric(ranker.transform(dealt.drop(*names)))
    return {f: base - metric(ranker.transform(dealt.withColumn(f, F.col(d)).drop(*names))) for f, d in zip(ranker.features, names, strict=True)}


def grid_search(cands: DataFrame, labels: DataFrame, grid: DataFrame, score: Column, k: int = 50) -> DataFrame:
    """(params..., recall) for each row of ``grid`` (a small table), where ``score`` may use its columns."""
    names = grid.columns
    rows = cands.crossJoin(F.broadcast(grid)).withColumn("_s", F.round(score, 12))
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*names, "query_id").orderBy(F.desc("_s"), "rank", "item_id"))).where(F.col("_r") <= k)
    wanted = labels.select("query_id", "item_id").distinct().crossJoin(F.broadcast(grid))
    hit = wanted.join(ranked.select(*names, "query_id", "item_id", F.lit(1).alias("_h")), [*names, "query_id", "item_id"], "left")
    return hit.groupBy(*names, "query_id").agg(F.avg(F.coalesce("_h", F.lit(0))).alias("r")).groupBy(*names).agg(F.avg("r").alias("recall"))


def coordinate_ascent(cands: DataFrame, labels: DataFrame, steps: dict[str, Sequence[float]], score: Column, k: int = 50, passes: int = 1) -> dict[str, float]:
    """One parameter at a time to its best value, the others fixed; a pass over all, again ``passes`` times."""
    spark = cands.sparkSession
    best = {name: values[0] for name, values in steps.items()}
    for _ in range(passes):
        for name, values in steps.items():
            table = spark.createDataFrame([tuple((best | {name: float(v)})[n] for n in steps) for v in values], ", ".join(f"{n} double" for n in steps))
            row = grid_search(cands, labels, table, score, k).orderBy(F.desc("recall"), name).first()
            best[name] = row[name]
    return best


def training_pairs(log: DataFrame, items: DataFrame, cap: int = 20, seed: int = 9) -> DataFrame:
    """(q, d, tn, item_id, dh): distinct query and item texts, at most ``cap`` a normalised query in seeded order; dh is
    the item text's MD5. Item texts are joined after the cut."""
    rows = log.select("q", "tn", "item_id").distinct()
    order = Window.partitionBy("tn").orderBy(seeded_order("q", "item_id", seed=seed), "q", "item_id")
    kept = rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= cap)
    return kept.join(items.select("item_id", F.col("text").alias("d")), "item_id").select("q", "d", "tn", "item_id", F.md5("d").alias("dh"))


def no_duplicate_batches(pairs: DataFrame, size: int, seed: int = 9) -> DataFrame:
    """Pairs with batch: no batch holds one query or one document text twice.

    Pairs of one query get consecutive numbers from a start that its hash chooses, so they fall into different batches;
    what still meets in a batch with an equal document moves to batches of its own, by its place among the equals.
    """
    n = max(1, -(-pairs.count() // size))
    start = F.conv(F.substring(seeded_order("tn", seed=seed), 1, 8), 16, 10).cast("long")
    place = F.row_number().over(Window.partitionBy("tn").orderBy("dh", "q"))
    rows = pairs.withColumn("_b", (start + place - 1) % n + n * F.floor((place - 1) / n))
    again = F.row_number().over(Window.partitionBy("_b", "dh").orderBy("tn", "q"))
    rows = rows.withColumn("_a", again - 1)
    rows = rows.withColumn("batch", F.when(F.col("_a") == 0, F.concat_ws("-", F.col("_b").cast("string"))).otherwise(F.concat_ws("-", F.col("_b").cast("string"), F.col("_a").cast("string"))))
    return rows.drop("_b", "_a")


def score_pairs(pairs: DataFrame, load: Callable[[], Callable[[list[str], list[str]], Sequence[float]]], cache: DataFrame | None = None) -> DataFrame:
    """(query_id, item_id, ce) of (query_id, item_id, q, d), by any pair model; pairs in ``cache`` are not scored again."""
    todo = pairs.join(cache.select("query_id", "item_id"), ["query_id", "item_id"], "left_anti") if cache is not None else pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in batches:
            ce = np.asarray(model(batch.column(2).to_pylist(), batch.column(3).to_pylist()), np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ce)], ["query_id", "item_id", "ce"])

    new = todo.select("query_id", "item_id", "q", "d").mapInArrow(run, f"query_id {dict(todo.dtypes)['query_id']}, item_id {dict(todo.dtypes)['item_id']}, ce double")
    return cache.select("query_id", "item_id", "ce").unionByName(new) if cache is not None else new


def stack_features(a: DataFrame, b: DataFrame) -> DataFrame:
    """Features for a stacker of two rankings: ranks, reciprocal ranks and scores of both, 0 where absent."""
    x = a.select("query_id", "item_id", F.col("rank").alias("r1"), F.col("score").alias("s1"))
    y = b.select("query_id", "item_id", F.col("rank").alias("r2"), F.col("score").alias("s2"))
    both = x.join(y, ["query_id", "item_id"], "outer")
    cells = [c for i in "12" for c in (F.coalesce(1 / (60 + F.col(f"r{i}")), F.lit(0.0)).alias(f"rr{i}"), F.coalesce(f"s{i}", F.lit(0.0)).alias(f"s{i}"), F.col(f"r{i}").isNotNull().cast("double").alias(f"in{i}"))]
    return both.select("query_id", "item_id", *cells)


def contrastive_training(*_args, **_options) -> None:
    """Fine-tuning an encoder needs model weights and accelerators that this library does not ship."""
    raise NotImplementedError("no encoder is bundled; build pairs with training_pairs and no_duplicate_batches")
