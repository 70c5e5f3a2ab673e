"""Queries against their SQL on small tables made for a fault, and the plans and sizes of what grows with the input."""

import hashlib
import math
import re
from collections import Counter
from datetime import datetime

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from trovine.operators import dense as D
from trovine.operators import geo as G
from trovine.operators import ml, ngrams, postings
from trovine.operators import rerank as R
from trovine.operators import sparse as S
from trovine.operators import windows as W
from trovine.plans import learning, ranking, registry


def same_as_sql(spark, folder, name):
    """The query's rows and those of its SQL over the Parquet files in ``folder``, both sorted."""
    df = registry.queries()[name](spark, f"file://{folder}")
    with duckdb.connect() as con:
        for path in folder.glob("*.parquet"):
            con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
        want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.oracle_sql()[name]}) x").fetchall()
    got, want = sorted(tuple(r) for r in df.collect()), sorted(want)
    assert got == want
    return got


def lineitem(folder, rows):
    """``rows``: part, supplier, line number, quantity, price."""
    part, supp, line, quantity, price = (list(x) for x in zip(*rows, strict=True))
    n = len(rows)
    table = {"l_orderkey": list(range(n)), "l_partkey": part, "l_suppkey": supp, "l_linenumber": pa.array(line, pa.int32()), "l_quantity": quantity, "l_extendedprice": price,
             "l_discount": [0.0] * n, "l_tax": [0.0] * n, "l_returnflag": ["R"] * n, "l_linestatus": ["O"] * n, "l_shipdate": pa.array([datetime(2020, 1, 1)] * n, pa.timestamp("us"))}
    pq.write_table(pa.table(table), folder / "lineitem.parquet")


def test_fused_z_scores_that_agree_to_eight_digits_are_tied(spark, tmp_path):
    lineitem(tmp_path, [(1, 1, 3, 10.0, 100.0), (2, 1, 3, 10.0, 100.001), (3, 1, 3, 20.0, 2e6)])
    got = same_as_sql(spark, tmp_path, "fuse_weighted_z")
    assert {r[1]: r[3] for r in got} == {3: 1, 1: 2, 2: 3}


def places(folder, customers, parts):
    """``customers``: key, nation; ``parts``: keys."""
    pq.write_table(pa.table({"c_custkey": [c for c, _ in customers], "c_nationkey": pa.array([n for _, n in customers], pa.int32()), "c_mktsegment": ["MACHINERY"] * len(customers)}), folder / "customer.parquet")
    pq.write_table(pa.table({"n_nationkey": pa.array(range(25), pa.int32()), "n_regionkey": pa.array([n % 5 for n in range(25)], pa.int32())}), folder / "nation.parquet")
    n = len(parts)
    pq.write_table(pa.table({"p_partkey": parts, "p_name": ["a b"] * n, "p_type": ["t"] * n, "p_brand": ["B"] * n, "p_size": pa.array([1] * n, pa.int32()), "p_retailprice": [5.0] * n}), folder / "part.parquet")


def test_pools_are_counted_without_their_pairs(spark, tmp_path, monkeypatch):
    # Queries with one id in two places, parts of one id, a place without parts (nation 24).
    places(tmp_path, [(1, 3), (1, 4), (2, 3), (3, 24)], [3, 3, 23, 4])
    lineitem(tmp_path, [(3, 1, 3, 41.0, 1.0), (4, 2, 3, 50.0, 1.0)])
    monkeypatch.setattr(G, "pool_rows", None)
    assert same_as_sql(spark, tmp_path, "geo_pool_retrieval") == [(1, 4, 0), (2, 3, 0)]


def test_the_pool_report_counts_without_pairs(spark, tmp_path, monkeypatch):
    places(tmp_path, [(1, 3), (1, 4), (2, 3), (3, 24)], [3, 3, 23, 4])
    lineitem(tmp_path, [(3, 1, 3, 41.0, 1.0), (4, 2, 3, 50.0, 1.0)])
    monkeypatch.setattr(G, "pool_rows", None)
    assert same_as_sql(spark, tmp_path, "pool_report") == [(1, 4), (2, 3), (3, 0)]
    queries = spark.createDataFrame([(1, 7), (2, 8)], "query_id int, search_location_id int")
    pool = spark.createDataFrame([(7, 1, 0), (7, 2, 1), (8, 2, 0)], "search_location_id int, item_location_id int, tier int")
    items = spark.createDataFrame([(10, 1), (11, 2), (12, 3)], "item_id int, item_location_id int")
    labels = spark.createDataFrame([(1, 10), (1, 12), (2, 11), (2, 99)], "query_id int, item_id int")
    assert sorted(map(tuple, G.pool_report(queries, pool, items, labels).collect())) == [(1, 2, 0.5), (2, 1, 0.5)]


def plan_of(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_a_percentile_rank_needs_one_sort(spark):
    df = spark.range(9).select((F.col("id") % 2).alias("query_id"), F.col("id").cast("double").alias("a"))
    assert plan_of(df.select("query_id", W.percentile_rank("a"))).count("Sort [") == 1


def test_candidates_with_texts_travel_to_their_query_once(spark, sf):
    """Classes are looked up at the query: no exchange by (query, class) for a join, and only the features asked for are made."""
    plan = plan_of(R.features(*ranking.feature_inputs(registry.Tables(spark, sf))))
    assert not re.search(r"Join \[query_id#\d+L?, class#", plan)
    assert R.features(*ranking.feature_inputs(registry.Tables(spark, sf)), wanted=("cos", "p_mc")).columns == ["query_id", "item_id", "rank", "cos", "p_mc"]


def test_the_stacker_fits_on_written_rows(spark, sf):
    assert not [f for f in registry.queries()["stacker"](spark, sf).inputFiles() if "lineitem" in f]


@pytest.mark.parametrize("name", ["ranker_scores", "pipeline_ltr"])
def test_scores_are_not_joined_back_to_their_rows(spark, sf, name):
    assert "Join" not in plan_of(registry.queries()[name](spark, sf))


def test_only_what_a_ranker_needs_is_written(spark, sf):
    assert set(learning._rows(registry.Tables(spark, sf), ("cos",)).columns) == {"query_id", "item_id", "rank", "y", "cos"}


def test_features_are_dealt_out_in_one_pass(spark, monkeypatch):
    rows = [(q, i, float((q * 7 + i * 3) % 5), float(i)) for q in range(4) for i in range(6)]
    df = spark.createDataFrame(rows, "query_id int, item_id int, a double, b double")
    ranker = ml.PairwiseRanker(["a", "b"])
    ranker.scale, ranker.weights = [(0.0, 1.0)] * 2, [1.0, 2.0]
    seen = []
    monkeypatch.setattr(type(df), "join", None)
    ml.permutation_importance(df, ranker, lambda d: seen.append({(r.query_id, r.item_id): r.pred for r in d.collect()}) or 0.0)
    order = lambda i: (hashlib.md5(f"5|{i}".encode()).hexdigest(), i)
    dealt = [sorted(range(6), key=order)[i] for i in range(6)]
    own = {(q, i): (a, b) for q, i, a, b in rows}
    want = [{k: a + 2 * b for k, (a, b) in own.items()}, {(q, i): own[q, dealt[i]][0] + 2 * b for (q, i), (_, b) in own.items()}, {(q, i): a + 2 * own[q, dealt[i]][1] for (q, i), (a, _) in own.items()}]
    assert seen == want


def test_ranks_of_many_pairs_equal_numpy(spark, monkeypatch):
    """Several blocks of queries and of the corpus; nulls on both sides; no vector travels with a pair."""
    monkeypatch.setattr(D, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(D, "dot", None)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 6)).round(1)
    corpus = spark.createDataFrame([(i, x[i].tolist() if i != 7 else None, i % 4 if i != 9 else None) for i in range(90)], "item_id long, vector array<double>, label int")
    queries = corpus.where("item_id % 2 = 0").withColumnRenamed("item_id", "query_id").withColumn("vector", F.when(F.col("query_id") != 4, F.col("vector")))
    pairs = queries.select("query_id").crossJoin(corpus.select("item_id")).where("(query_id + item_id) % 3 = 0")
    got = {(r.query_id, r.item_id): (r.score, r.grank) for r in D.pair_ranks(D.pair_scores(pairs, queries, corpus), queries, corpus).collect()}
    full = np.delete(np.round(x @ x.T, 6), 7, axis=1)
    want = {}
    for r in pairs.collect():
        score = 0.0 if r.query_id == 4 or r.item_id == 7 else float(np.round(x[r.query_id] @ x[r.item_id], 6))
        want[r.query_id, r.item_id] = (score, 1 if r.query_id == 4 else 1 + int((full[r.query_id] > score).sum()))
    assert got == want
    best = {r.query_id: r.best for r in D.rank_of_best_alike(queries, corpus).collect()}
    own = {q: [g for i in range(90) if i not in (7, 9, q) and i % 4 == q % 4 for g in [1 + int((full[q] > np.round(x[q] @ x[i], 6)).sum())]] for q in range(0, 90, 2)}
    assert best == {q: min(v) for q, v in own.items() if q != 4}


def test_large_sql_search_is_the_block_search(spark, monkeypatch):
    corpus = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(30)], "item_id long, vector array<double>")
    queries = corpus.where("item_id < 5").withColumnRenamed("item_id", "query_id")
    want = sorted(map(tuple, D.search_sql(queries, corpus, 4).select("query_id", "item_id", "score", "rank").collect()))
    monkeypatch.setattr(D, "PAIRS", 10)
    monkeypatch.setattr(D, "dot", None)
    assert sorted(map(tuple, D.search_sql(queries, corpus, 4).select("query_id", "item_id", "score", "rank").collect())) == want


def test_gradients_make_no_rows_of_pairs(spark):
    df = spark.createDataFrame([(1, i, int(i < 2), float(-i), [float(i)]) for i in range(5)], "query_id int, item_id int, y int, score double, x array<double>")
    out = ml.TreeRanker([]).gradients(df, ("x",))
    assert "Join" not in plan_of(out) and {(r.item_id, r.x[0]) for r in out.collect()} == {(i, float(i)) for i in range(5)}


def test_ngram_vectors_equal_plain_python_without_rows_of_ngrams(spark, tmp_path, monkeypatch):
    """Small slices; nulls, empty and long words; no transformer that takes lists of n-grams."""
    monkeypatch.setattr(ml, "CountVectorizer", None, raising=False)
    monkeypatch.setattr(ngrams, "CHARS", 20)
    texts = ["Ab ab, ab", "ab xaaaaay 𝄞б", None, "", " б  ab\txaaaaay ", "ab ab б", "Ёж еж ab, x", "ab, ёж"]
    df = spark.createDataFrame([(k, x, "u" if k % 2 else "v", 1.0) for k, x in enumerate(texts)], "id long, doc string, class string, w double")

    def grams(x, kind):
        words = re.findall(r"\w+", (x or "").lower().replace("ё", "е"))
        if kind == 0:
            return words + [" ".join(p) for p in zip(words, words[1:], strict=False)]
        return [p[i : i + n] for w in (x or "").split() for p in [f" {w} "] for n in (3, 4, 5) for i in range(len(p) - n + 1)]

    want, width = [{} for _ in texts], 0
    for kind, least in ((0, 2), (1, 3)):
        counts = [Counter(grams(x, kind)) for x in texts]
        tf, df_ = Counter(), Counter()
        for c in counts:
            tf.update(c)
            df_.update(c.keys())
        names = sorted((g for g in tf if df_[g] >= least), key=lambda g: (-tf[g], g))[:9]
        for own, c in zip(want, counts, strict=True):
            v = {width + k: (1 + math.log(c[g])) * math.log((len(texts) + 1) / (df_[g] + 1)) for k, g in enumerate(names) if g in c}
            size = math.sqrt(sum(x * x for x in v.values())) or 1.0
            own.update({k: x / size for k, x in v.items()})
        width += len(names)
    made = ngrams.Vectorizer((9, 9)).fit(df, "doc", f"file://{tmp_path}")
    got = {r.id: r._x for r in made.transform(df.select("id", "doc"), "doc").collect()}
    for k, own in enumerate(want):
        assert got[k].size == width and dict(zip(got[k].indices.tolist(), got[k].values.tolist(), strict=True)) == pytest.approx(own)
    assert ml.ClassModel(words=9, chars=9).fit(df).predict(df.select(F.col("id").alias("query_id"), "doc").where("doc <> ''")).count() == 12


def test_bm25_makes_no_rows_of_pairs(spark, tmp_path, monkeypatch):
    """Terms are not joined; ids that occur twice or are null, texts without words, ties, and blocks of queries equal the SQL."""
    monkeypatch.setattr(S, "TERMS", 3)
    monkeypatch.setattr(postings, "PAIRS", 4)
    docs = [(1, "red apple apple"), (1, "red Ёж"), (None, "red pear"), (None, "pear"), (2, None), (3, " , "), (4, "blue apple"), (5, "blue apple"), (16, "еж ёж"), (25, "red apple blue pear")]
    asked = [(1, "red red apple"), (5, "pear blue"), (6, "nothing"), (5, "еж"), (26, "")]
    pq.write_table(pa.table({"doc_id": [k for k, _ in docs], "text": [x for _, x in docs]}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": [k for k, _ in asked], "text": [x for _, x in asked]}), tmp_path / "benchmark.parquet")
    assert len(same_as_sql(spark, tmp_path, "bm25_top50")) == 9
    assert len(same_as_sql(spark, tmp_path, "source_scores")) == 3
    tables = registry.Tables(spark, f"file://{tmp_path}")
    assert "Join" not in plan_of(S.score_all(tables.documents.withColumnRenamed("doc_id", "item_id"), tables.benchmark.withColumnRenamed("item_id", "query_id")))


@pytest.mark.parametrize("name", ["hybrid_geo", "answer_rows", "pipeline_meta"])
def test_the_hybrid_reads_written_lists(spark, sf, name):
    assert not [f for f in registry.queries()[name](spark, sf).inputFiles() if "embeddings" in f]
