"""Queries on classifiers, rankers and their evaluation. Fitted models have no SQL; their effects are tested."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import ml
from ..operators import rerank as R
from ..operators import topk as K
from ..sources import io
from . import roles
from .ranking import feature_inputs
from .registry import query

_SOME = ("g_score_max", "bm25_pct", "cos", "title_overlap", "same_city", "prf20", "p_mc", "ft_cos_pct")


def _rows(t, wanted):
    """Candidates with the ``wanted`` features and y: the item was returned in large quantities to the query. Written once, a
    query's rows together: fits read it often."""
    labels = roles.of(t, "LABELS").withColumn("y", F.lit(1))
    cands, *tables = feature_inputs(t)
    cands = cands.join(labels, ["query_id", "item_id"], "left").withColumn("y", F.coalesce("y", F.lit(0)))
    return io.stage(R.features(cands, *tables, keep=("y",), wanted=wanted), io.work_folder(t.spark))


@query("microcat_proba")
def microcat_proba(t):
    """Classes of benchmark texts by a model of all labelled documents' whole texts."""
    docs = t.documents.join(t.labels.select("doc_id"), "doc_id", "left_semi").select(F.col("text").alias("doc"), F.col("lang").alias("class"), F.lit(1.0).alias("w")).where("doc <> ''")
    model = ml.ClassModel().fit(docs)
    return model.predict(t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("doc")))


@query("ranker_scores")
def ranker_scores(t):
    rows = _rows(t, ("g_score", *_SOME))
    both = ml.cross_fit(rows, lambda: ml.PairwiseRanker(_SOME), 2, keep=("rank", "g_score")).withColumnRenamed("g_score", "score")
    return K.resort(both, F.round("pred", 9)).select("query_id", "item_id", "score", "rank")


@query("tree_ranker")
def tree_ranker(t):
    """Two boosted rankers of different seeds, stopped early on folds of their own; mean of their z-scores."""
    rows = _rows(t, _SOME)
    return ml.seed_ensemble(rows, rows, lambda seed: ml.TreeRanker(_SOME, trees=8, patience=3, seed=seed), (1, 2))


@query("softmax_ranker")
def softmax_ranker(t):
    rows = _rows(t, _SOME[:4])
    return ml.cross_fit(rows, lambda: ml.SoftmaxRanker(_SOME[:4]), 2).select("query_id", "item_id", "pred")


@query("crossfit")
def crossfit(t):
    return ml.cross_fit(_rows(t, _SOME), lambda: ml.PairwiseRanker(_SOME), 2)


@query("stacker")
def stacker(t):
    rows = ml.stack_features(roles.of(t, "LIST_A"), roles.of(t, "LIST_B"))
    rows = rows.join(roles.of(t, "LABELS").withColumn("y", F.lit(1)), ["query_id", "item_id"], "left").withColumn("y", F.coalesce("y", F.lit(0)))
    # Written once, a query's rows together: every pass of the fits would join the lists anew.
    rows = io.stage(rows.repartition("query_id"), io.work_folder(t.spark))
    return ml.cross_fit(rows, lambda: ml.PairwiseRanker(["rr1", "s1", "in1", "rr2", "s2", "in2"]), 2)


@query("pipeline_ltr")
def pipeline_ltr(t):
    """Features, three rankers on different seeds, mean of their z-scores, re-sorted."""
    rows = _rows(t, ("g_score", *_SOME))
    scored = rows
    for k in (1, 2, 3):
        scored = ml.PairwiseRanker(_SOME, seed=k).fit(rows).transform(scored, f"m{k}")
    both = ml.ensemble(scored, ["m1", "m2", "m3"], keep=("rank", "g_score")).withColumnRenamed("g_score", "score")
    return K.resort(both, F.round("pred", 9), keep=300).select("query_id", "item_id", "score", "rank")


@query("importance")
def importance(t):
    rows = _rows(t, ("g_score", *_SOME[:3]))
    model = ml.PairwiseRanker(_SOME[:3]).fit(rows)
    labels = roles.of(t, "LABELS")

    def metric(df):
        top = K.resort(df.withColumnRenamed("g_score", "score"), F.round("pred", 9), keep=50)
        return E.recall_at_k(top, labels, 50).agg(F.avg("recall")).first()[0]

    found = ml.permutation_importance(rows, model, metric)
    return t.spark.createDataFrame([(f, float(v), float(model.importance()[f])) for f, v in found.items()], "feature string, loss double, weight double")


_GRID = """SELECT w, round(avg(r), 6) AS recall FROM (SELECT g.w, l.query_id, avg(CASE WHEN x.r <= 50 THEN 1 ELSE 0 END) AS r FROM labels_ l CROSS JOIN (VALUES (0.0::DOUBLE), (10.0::DOUBLE), (100.0::DOUBLE)) g(w)
LEFT JOIN (SELECT w, query_id, item_id, row_number() OVER (PARTITION BY w, query_id ORDER BY round(score + w * CASE WHEN item_id % 3 = 0 THEN 1 ELSE 0 END, 12) DESC, rank, item_id) AS r FROM list_a CROSS JOIN (VALUES (0.0::DOUBLE), (10.0::DOUBLE), (100.0::DOUBLE)) v(w)) x
ON x.w = g.w AND x.query_id = l.query_id AND x.item_id = l.item_id GROUP BY 1, 2) y GROUP BY 1"""


@query("grid_search", roles.sql(_GRID, "LIST_A", "LABELS").replace("labels AS", "labels_ AS"))
def grid_search(t):
    grid = t.spark.createDataFrame([(0.0,), (10.0,), (100.0,)], "w double")
    score = F.col("score") + F.col("w") * (F.col("item_id") % 3 == 0).cast("int")
    return ml.grid_search(roles.of(t, "LIST_A"), roles.of(t, "LABELS"), grid, score).withColumn("recall", F.round("recall", 6))


@query("coordinate_ascent")
def coordinate_ascent(t):
    score = F.col("score") + F.col("a") * (F.col("item_id") % 3 == 0).cast("int") + F.col("b") * (F.col("item_id") % 5 == 0).cast("int")
    best = ml.coordinate_ascent(roles.of(t, "LIST_A"), roles.of(t, "LABELS"), {"a": [0.0, 20.0], "b": [0.0, 20.0]}, score)
    return t.spark.createDataFrame([(k, float(v)) for k, v in best.items()], "parameter string, value double")


@query("pair_scores", "SELECT p_partkey % 50 AS query_id, p_partkey AS item_id, round(len(list_intersect(q, d)) / CAST(len(q) AS DOUBLE), 6) AS ce FROM (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS q, list_distinct(string_split(string_split(p_name, ' ')[1 + p_size % 2] || ' ' || p_type, ' ')) AS d FROM part) x")
def pair_scores(t):
    """A pair model (here: share of common words) with a cache: pairs scored before are not scored again."""

    def load():
        def model(a, b):
            return [len(set(x.split()) & set(y.split())) / max(1, len(set(x.split()))) for x, y in zip(a, b, strict=True)]

        return model

    pairs = t.part.select((F.col("p_partkey") % 50).alias("query_id"), F.col("p_partkey").alias("item_id"), F.col("p_name").alias("q"), F.concat_ws(" ", F.get(F.split("p_name", " "), F.col("p_size") % 2), "p_type").alias("d"))
    first = ml.score_pairs(pairs.where("item_id % 2 = 0"), load)
    return ml.score_pairs(pairs, load, first).withColumn("ce", F.round("ce", 6))
