"""Operators on small fixtures with known results, plan shapes, and errors."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trovine.operators import aggregates as A
from trovine.operators import dense as D
from trovine.operators import evaluate as E
from trovine.operators import fusion as U
from trovine.operators import geo as G
from trovine.operators import ml
from trovine.operators import sparse as S
from trovine.operators import topk as K
from trovine.operators import validate as V
from trovine.operators import windows as W

LIST = "query_id string, item_id string, score double, rank int"


def ranked(spark, lists):
    return spark.createDataFrame([(q, i, 1.0 / (k + 1), k + 1) for q, items in lists.items() for k, i in enumerate(items)], LIST)


def ids(df):
    out = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        out[r.query_id].append(r.item_id)
    return dict(out)


def brute_bm25(items, queries, k1=1.5, b=0.75):
    from math import log

    words = {i: (t or "").lower().split() for i, t in items}
    n, avg = len(words), sum(map(len, words.values())) / len(words)
    out = {}
    for q, text in queries:
        for i, w in words.items():
            score = 0.0
            for term in set(text.lower().split()):
                df = sum(term in x for x in words.values())
                if term in w:
                    score += log(1 + (n - df + 0.5) / (df + 0.5)) * w.count(term) / (w.count(term) + k1 * (1 - b + b * len(w) / avg))
            if score > 0:
                out[q, i] = round(score, 6)
    return out


def test_bm25_and_its_stored_index(spark, tmp_path):
    rng = random.Random(2)
    items = [("d1", "a a b"), ("d2", "b c"), ("d3", "c c c d"), ("d4", None), ("d5", "")] + [(f"r{k}", " ".join(rng.choices("abcdefgh", k=rng.randrange(12)))) for k in range(60)]
    queries = [("q", "a b b"), ("r", "c"), ("s", "zzz")]
    df, asked = spark.createDataFrame(items, "item_id string, text string"), spark.createDataFrame(queries, "query_id string, text string")
    want = brute_bm25(items, queries)
    assert {(r.query_id, r.item_id): r.score for r in S.bm25_search(df, asked, 100).collect()} == pytest.approx(want, abs=2e-6)
    index = S.Index.build(df, f"file://{tmp_path}/i", files=3)
    assert {(r.query_id, r.item_id): r.score for r in S.Index(spark, index.folder).search(asked, 100).collect()} == pytest.approx(want, abs=2e-6)
    assert index.table("stats").first()["n"] == len(items) and index.table("terms").where("term = 'a'").first().df == sum("a" in (t or "").split() for _, t in items)


def test_top_k_is_cut_before_the_shuffle(spark):
    df = K.top_k(spark.range(1000).select((F.col("id") % 7).alias("query_id"), F.col("id").alias("item_id"), F.rand(1).alias("score")), 3)
    assert df.count() == 21
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()


def test_tiered_top_k(spark):
    scores = {"p1": 0.1, "p2": 0.9, "p3": 0.5, "p4": 0.8, "p5": 0.7}
    scored = spark.createDataFrame([("q", i, s) for i, s in scores.items()], "query_id string, item_id string, score double")
    tiers = spark.createDataFrame([("q", "p1", 0), ("q", "p3", 0), ("q", "p5", 1), ("q", "p3", 1)], "query_id string, item_id string, tier int")
    got = K.tiered_top_k(scored, tiers, 4)
    assert ids(got) == {"q": ["p3", "p1", "p5", "p2"]} and got.agg(F.sum("from_tier")).first()[0] == 3


def test_pool_top_k_equals_tiered_top_k(spark):
    rng = random.Random(6)
    rows = [(q, i, round(rng.random(), 2) - 0.1, q % 3, i % 5) for q in range(9) for i in range(40)]
    scored = spark.createDataFrame(rows, "query_id int, item_id int, score double, search_location_id int, item_location_id int")
    pool = spark.createDataFrame([(s, (s + d) % 5, d) for s in range(3) for d in (0, 1)] + [(0, 1, 0)], "search_location_id int, item_location_id int, tier int")
    tiers = scored.join(pool, ["search_location_id", "item_location_id"]).select("query_id", "item_id", "tier")
    a, b = (sorted(map(tuple, x.select("query_id", "item_id", "rank", "from_tier").collect())) for x in (K.pool_top_k(scored, pool, 12, True), K.tiered_top_k(scored, tiers, 12, True)))
    assert a == b and len(a) == 9 * 12


def test_rrf_with_bonus_and_ties(spark):
    a, b = ranked(spark, {"q": ["x", "y", "z"]}), ranked(spark, {"q": ["y", "w", "x"]})
    got = {r.item_id: round(r.score, 6) for r in U.rrf([a, b]).collect()}
    assert got == {"y": 0.032522, "x": 0.032266, "w": 0.016129, "z": 0.015873}
    bonus = spark.createDataFrame([("q", "w", 0.015), ("q", "z", 0.015)], "query_id string, item_id string, bonus double")
    assert ids(U.rrf([a, b], bonus=bonus, n=3)) == {"q": ["y", "x", "w"]}
    assert ids(U.rrf([ranked(spark, {"q": ["m", "n"]}), ranked(spark, {"q": ["n", "m"]})])) == {"q": ["m", "n"]}


def test_interleave_late_and_head(spark):
    a, b = ranked(spark, {"q": ["x", "y", "z"]}), ranked(spark, {"q": ["y", "w", "x"]})
    assert ids(U.interleave(a, b)) == {"q": ["x", "y", "w", "z"]}
    assert ids(U.late(a, b)) == {"q": ["y", "x", "w", "z"]}
    ce = spark.createDataFrame([("q", "x", 0.1), ("q", "y", 0.9)], "query_id string, item_id string, ce double")
    assert ids(U.rerank_head(a, ce, "ce", top=2)) == {"q": ["y", "x", "z"]}
    assert ids(U.rerank_head(a, ce, "keep", top=2, keep=1)) == {"q": ["x", "y", "z"]}
    assert ids(U.rerank_head(a, ce, "rrf", top=2)) == {"q": ["x", "y", "z"]}


def test_union_candidates(spark):
    fused = ranked(spark, {"q": ["a", "b", "c", "d"]})
    extra = ranked(spark, {"q": ["d", "b", "n"]})
    got = {r.item_id: (r.rank, r.ft_rank, r.is_new) for r in U.union_candidates(fused, extra, k=2).collect()}
    assert got == {"a": (1, 4, 0), "b": (2, 2, 0), "d": (4, 1, 1), "n": (6, 3, 1)}


def test_within_query_windows(spark):
    df = spark.createDataFrame([("q", str(k), v) for k, v in enumerate([10.0, 20.0, 20.0, 5.0, None])], "query_id string, item_id string, v double")
    got = df.select("item_id", W.percentile_rank("v").alias("p"), W.gap_to_max("v").alias("g"), W.ratio_to_max("v").alias("r"), W.zscore("v").alias("z")).orderBy("item_id").collect()
    assert [r.p for r in got] == [0.5, 0.875, 0.875, 0.25, None]
    assert [r.g for r in got] == [-10, 0, 0, -15, None] and [r.r for r in got] == [0.5, 1, 1, 0.25, 0]
    assert [None if r.z is None else round(r.z, 5) for r in got] == [-0.5, 0.83333, 0.83333, -1.16667, None]
    single = spark.createDataFrame([("q", "a", 1.0)], "query_id string, item_id string, v double")
    row = single.select(W.zscore("v").alias("z"), W.min_max("v").alias("m"), W.z_norm("v").alias("n")).first()
    assert (row.z, row.m, row.n) == (None, 1.0, 0.0)


def test_quota(spark):
    flags = [False, True, True, False, True, True]
    df = spark.createDataFrame([("q", str(k + 1), 1.0, k + 1, m, True) for k, m in enumerate(flags)], LIST + ", m_all boolean, q_any boolean")
    assert ids(K.quota(df, reserve=1, top=4)) == {"q": ["2", "3", "5", "1", "4", "6"]}
    assert ids(K.quota(df.withColumn("q_any", F.lit(False)), 1, 4)) == {"q": ["1", "2", "3", "4", "5", "6"]}


def test_fill_lists(spark):
    a, b = ranked(spark, {"q": ["x", "y"]}), ranked(spark, {"q": ["y", "z", "w"], "r": ["v"]})
    assert ids(K.fill([a, b], 3)) == {"q": ["x", "y", "z"], "r": ["v"]}
    everyone = spark.createDataFrame([("m", 1), ("x", 2), ("n", 3)], "item_id string, rank int")
    assert ids(K.fill_global(a, [a], everyone, 3)) == {"q": ["x", "y", "m"]}


def test_recall(spark):
    labels = spark.createDataFrame([("q1", "a"), ("q1", "b"), ("q2", "c"), ("q3", "d")], "query_id string, item_id string")
    answers = spark.createDataFrame([("q1", "a"), ("q1", "x"), ("q2", "c")], "query_id string, item_id string")
    assert {r.query_id: r.recall for r in E.recall_at_k(answers, labels, 2).collect()} == {"q1": 0.5, "q2": 1.0, "q3": 0.0}
    with pytest.raises(E.InvalidAnswer):
        E.recall_at_k(answers.union(answers), labels, 4)
    with pytest.raises(E.InvalidAnswer):
        E.recall_at_k(answers, labels, 1)


def test_shares_go_before_absent_locations(spark):
    log = spark.createDataFrame([(1, 1)] * 6 + [(1, 2)] * 3 + [(1, 9)], "search_location_id int, item_location_id int")
    items = spark.createDataFrame([(1,), (2,)], "item_location_id int")
    none = spark.createDataFrame([], "search_location_id int")
    got = [(r.item_location_id, round(r.share, 6)) for r in G.city_pairs(log, none, items).collect()]
    assert got == [(2, 0.3)]
    assert G.main_city(G.pair_share(log)).first().main_city == 1


def test_neighbours_equal_all_pairs(spark):
    rng = random.Random(4)
    pts = [(k, rng.uniform(-89, 89), rng.uniform(-180, 180)) for k in range(150)] + [(200, 10.0, 179.95), (201, 10.0, -179.95), (202, None, None)]
    cent = spark.createDataFrame(pts, "item_location_id int, clat double, clon double")

    def km(a, b):
        la, lo, lb, lp = map(np.radians, (a[1], a[2], b[1], b[2]))
        return 2 * 6371 * np.arcsin(np.sqrt(min(1, np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin((lp - lo) / 2) ** 2)))

    for radius in (30, 900, 9000):
        want = {(a[0], b[0]) for a in pts for b in pts if a[0] != b[0] and a[1] is not None and b[1] is not None and km(a, b) <= radius}
        assert {(r.loc, r.near) for r in G.neighbours(cent, radius).collect()} == want


def test_named_city_prefers_long_names(spark):
    names = spark.createDataFrame([("казань",), ("нижний новгород",)], "name string")
    q = spark.createDataFrame([(1, "из казани в Нижний Новгород"), (2, "мск и казань"), (3, None), (4, "казанский")], "query_id int, search_query string")
    assert dict(G.named_city(q, G.city_forms(names)).collect()) == {1: "нижний новгород", 2: "москва"}


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(k, [round(float(x), 1) for x in rng.normal(size=3)]) for k in range(400)]  # coarse, so that scores tie
    corpus = spark.createDataFrame([*rows, (999, None)], "item_id long, vector array<float>").withColumn("item_location_id", F.col("item_id") % 6).repartition(5)
    return dict(rows), corpus, spark.createDataFrame(rows[:40], "query_id long, vector array<float>").withColumn("search_location_id", F.col("query_id") % 4)


def brute_scores(rows):
    v = {k: np.array(x, np.float32).astype(float) for k, x in rows.items()}
    return {(q, i): round(float(v[q] @ v[i]), 6) for q in range(40) for i in v}


@pytest.mark.parametrize("block", [64 << 20, 2000])
def test_dense_search_equals_sql_and_brute_force(spark, vectors, monkeypatch, block):
    """In one pass and in many."""
    rows, corpus, queries = vectors
    monkeypatch.setattr(D, "BLOCK_BYTES", block)
    scores = brute_scores(rows)
    best = {(q, i) for q in range(40) for i in sorted(rows, key=lambda i: (-scores[q, i], i))[:9]}
    got = D.search(queries, corpus, 9).collect()
    assert {(r.query_id, r.item_id) for r in got} == best and all(r.score == pytest.approx(scores[r.query_id, r.item_id], abs=1e-6) for r in got)
    a, b = (sorted(map(tuple, x.select("query_id", "item_id", "rank").collect())) for x in (D.search(queries, corpus, 9), D.search_sql(queries, corpus.where("vector IS NOT NULL"), 9)))
    assert a == b
    tiers = {(s, i): t for s in range(4) for i, t in ((s, 0), (s + 1, 1), (5, 1))}
    pool = spark.createDataFrame([(s, i, t) for (s, i), t in tiers.items()] + [(0, 0, 3)], "search_location_id int, item_location_id int, tier int")
    want = {(q, i) for q in range(40) for i in sorted(rows, key=lambda i: (tiers.get((q % 4, i % 6), 9), -scores[q, i], i))[:90]}
    for most in (1000, 4):
        assert {(r.query_id, r.item_id) for r in D.search_pools(queries, corpus, pool, 90, most=most).collect()} == want
    with pytest.raises(ValueError):
        D.search(queries.union(spark.createDataFrame([(7777, [1.0], 0)], queries.schema)), corpus, 3)
    with pytest.raises(ValueError):
        D.search_sql(queries, corpus, 3, most_mb=0)


@pytest.mark.parametrize("block", [64 << 20, 2000])
def test_ranks_of_given_pairs(spark, vectors, monkeypatch, block):
    rows, corpus, queries = vectors
    monkeypatch.setattr(D, "BLOCK_BYTES", block)
    scores, rng = brute_scores(rows), random.Random(3)
    pairs = [(q, i) for q in range(40) for i in rng.sample(range(400), 12)]
    df = spark.createDataFrame([*pairs, (3, 999), (12345, 5)], "query_id long, item_id long")
    got = {(r.query_id, r.item_id): (r.score, r.grank) for r in D.pair_ranks(D.pair_scores(df, queries, corpus), queries, corpus).collect()}
    assert len(got) == len(pairs) + 2 and got[12345, 5] == (0.0, 1)
    for q, i in pairs:
        assert got[q, i] == (pytest.approx(scores[q, i], abs=1e-6), 1 + sum(scores[q, j] > scores[q, i] for j in rows))
    best = {r.query_id: r.best for r in D.rank_of_best(df.where("query_id < 40"), queries, corpus).collect()}
    assert all(best[q] == min(got[a, i][1] for a, i in got if a == q) for q in range(40))


def test_encoders(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, "alpha gamma"), (3, None)], "item_id long, text string")
    v = {r.item_id: np.array(r.vector) for r in D.encode(df, "item_id", "text", 64).collect()}
    assert np.linalg.norm(v[1]) == pytest.approx(1) and np.linalg.norm(v[3]) == 0
    got = D.encode_with(df, "item_id", "text", lambda: lambda texts: np.array([[len(t), 1.0] for t in texts]))
    assert all(abs(np.linalg.norm(r.vector) - 1) < 1e-6 for r in got.collect())


def test_answer_check(spark):
    answer = spark.createDataFrame([("q1", "a  b"), ("q2", " ".join(f"{k:016x}" for k in range(51))), ("q3", "x x"), ("q3", "y"), ("q9", "")], "query_id string, answer string")
    queries = spark.createDataFrame([("q1",), ("q2",), ("q3",), ("q4",)], "query_id string")
    got = {r.rule: (r.severity, r.n) for r in V.check_answer(answer, queries, spark.createDataFrame([("a",)], "item_id string")).collect()}
    assert {k for k, v in got.items() if v[0] == "FAIL"} == {"spacing", "too many ids", "id repeats", "query repeats", "query missing", "query unknown"}
    assert got["too few ids"] == ("WARN", 4) and "id format" in got and "id unknown" in got


def test_answer_file(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbfquery_id,answer\nq,a\n")
    (tmp_path / "b.csv").write_bytes(b"id,answer\n\xff\n")
    assert V.check_file(spark, f"file://{tmp_path}/a.csv") == [("FAIL", "byte-order mark")]
    assert V.check_file(spark, f"file://{tmp_path}/b.csv") == [("FAIL", "not UTF-8")]


def test_bytes_behind_the_first_megabyte_count(spark, tmp_path):
    (tmp_path / "c.csv").write_bytes(b"query_id,answer\n" + b"q,a\n" * 400_000 + b"\xff\n")
    (tmp_path / "d.csv").write_bytes(b"query_id,answer\r\n" + b"q,a\n" * 400_000)
    assert V.check_file(spark, f"file://{tmp_path}/c.csv") == [("FAIL", "not UTF-8")] and V.check_file(spark, f"file://{tmp_path}/d.csv") == []


def test_threshold_recall_counts_ties(spark):
    cands = spark.createDataFrame([("q", f"i{k}", 1.0 if k < 4 else 0.5, 1) for k in range(6)], LIST)
    labels = spark.createDataFrame([("q", f"i{k}") for k in range(6)], "query_id string, item_id string")
    assert E.threshold_recall(cands, labels, 2).first().recall == pytest.approx(4 / 6)


def test_big_cities_are_known_without_items(spark):
    items = spark.createDataFrame([(k, 1, "Место оказания услуг Край, Казань, ул. Баумана 5 Тип x") for k in range(6)], "item_id int, item_location_id int, params string")
    names = G.city_names(items, items.groupBy("item_location_id").agg(F.count("*").alias("n_items")))
    got = {r.name: r.item_location_id for r in names.collect()}
    assert got["казань"] == 1 and got["ростов-на-дону"] is None and len(got) == len(G.BIG_CITIES)
    q = spark.createDataFrame([(1, "няня ростов-на-дону"), (2, "ремонт в белом"), (3, "мастер в Казани")], "query_id int, search_query string")
    assert dict(G.named_city(q, G.city_forms(names)).collect()) == {1: "ростов-на-дону", 3: "казань"}


def test_long_city_names(spark):
    names = spark.createDataFrame([("новый город на большой реке",), ("казань",)], "name string")
    q = spark.createDataFrame([(1, "казань новый город на большой реке")], "query_id int, search_query string")
    assert dict(G.named_city(q, G.city_forms(names)).collect()) == {1: "новый город на большой реке"}


def test_invariants(spark):
    V.require_full_lists(ranked(spark, {"q": ["a", "b"]}), 2)
    with pytest.raises(E.InvalidAnswer):
        V.require_full_lists(ranked(spark, {"q": ["a", "b"]}), 3)
    with pytest.raises(E.InvalidAnswer):
        E.unique_and_complete(spark.createDataFrame([(1, None), (2, "x")], "k int, v string"), ["k"], ["v"])


def test_split_quotas(spark):
    rows = [(k, k // 2, k % 3) for k in range(300)]
    eligible = spark.createDataFrame(rows, "query_key int, text_norm int, stratum int")
    target = spark.createDataFrame([(0, 0.5), (1, 0.25), (2, 0.25)], "stratum int, share double")
    got = E.stratified_split(eligible, target, 30, ["stratum"]).collect()
    assert len(got) == 30 == len({r.text_norm for r in got})
    assert sorted(sum(r.stratum == s for r in got) for s in range(3)) == [8, 8, 14]  # 7.5 goes to 8; the largest gives one


def test_folds_exclude_forced_texts(spark):
    q = spark.createDataFrame([(f"t{k}", k % 5) for k in range(50)], "text_norm string, other int")
    texts = E.text_folds(q, unseen=0.6)
    modes = {r.text_norm: r.mode for r in texts.collect()}
    assert sum(m != "seen" for m in modes.values()) == 30 and all((m == "unseen_nat") == (int(t[1:]) % 5 == 0) for t, m in modes.items())
    log = spark.createDataFrame([(f"t{k}", f"k{k}") for k in range(50)], "text_norm string, query_key string")
    folds = texts.where("mode = 'seen'").select(F.concat(F.lit("k"), F.substring("text_norm", 2, 9)).alias("query_key"), "fold")
    out = {r.text_norm: r.excl_fold for r in E.excluded_folds(log, folds, texts).collect()}
    assert all((v == -1) == (modes[t] == "unseen_nat") for t, v in out.items())


def test_bootstrap_covers_the_mean(spark):
    df = spark.createDataFrame([(k, float(k % 2)) for k in range(400)], "query_id int, m double")
    row = E.bootstrap(df, "m", 300).first()
    assert row["mean"] == 0.5 and 0.43 < row.low < 0.5 < row.high < 0.57


def test_rankers_learn(spark):
    rng = random.Random(0)
    rows = [(q, i, int(i == 3), float(i == 3) + rng.gauss(0, 0.3), rng.random()) for q in range(40) for i in range(8)]
    df = spark.createDataFrame(rows, "query_id int, item_id int, y int, good double, noise double")
    for make in (ml.PairwiseRanker, ml.SoftmaxRanker):
        model = make(["good", "noise"]).fit(df)
        assert abs(model.weights[0]) > 3 * abs(model.weights[1])
    scored = ml.cross_fit(df, lambda: ml.PairwiseRanker(["good", "noise"]), 2)
    top = K.top_k(scored.withColumnRenamed("pred", "score"), 1).where("item_id = 3").count()
    assert scored.count() == len(rows) and top > 34


def test_conditional_logit_converges(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 6, 2))
    y = [int(np.argmax(row @ [1.5, -0.7] + rng.gumbel(size=6))) for row in x]
    df = spark.createDataFrame([(q, i, int(i == y[q]), float(x[q, i, 0]), float(x[q, i, 1])) for q in range(60) for i in range(6)], "query_id int, item_id int, y int, a double, b double")
    model = ml.SoftmaxRanker(["a", "b"]).fit(df)
    z = (x - x.reshape(-1, 2).mean(0)) / x.reshape(-1, 2).std(0, ddof=1)

    def grad(w):
        p = np.exp(z @ w)
        p /= p.sum(1, keepdims=True)
        return sum((p[q][:, None] * z[q]).sum(0) - z[q, y[q]] for q in range(60)) / 60 + model.reg * w

    assert np.abs(grad(np.array(model.weights))).max() < 1e-4


def test_gradients_equal_brute_force(spark):
    from math import exp, log2

    rng = random.Random(4)
    rows = [(q, i, int(rng.random() < 0.3), round(rng.gauss(0, 1), 3)) for q in range(6) for i in range(9)]
    got = {(r.query_id, r.item_id): (r.g, r.h) for r in ml.TreeRanker([], truncation=4).gradients(spark.createDataFrame(rows, "query_id int, item_id int, y int, score double")).collect()}
    want = defaultdict(lambda: [0.0, 0.0])
    for q in range(6):
        own = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[3], r[1]))
        most = sum(1 / log2(k + 2) for k in range(sum(r[2] for r in own)))
        for a, good in enumerate(own):
            for b, bad in enumerate(own):
                if good[2] == 1 and bad[2] == 0 and min(a, b) < 4:
                    rho, d = 1 / (1 + exp(good[3] - bad[3])), abs(1 / log2(a + 2) - 1 / log2(b + 2)) / most
                    for r, sign in ((good, 1), (bad, -1)):
                        want[q, r[1]][0] += sign * rho * d
                        want[q, r[1]][1] += rho * (1 - rho) * d
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(tuple(v)) for k, v in want.items())


def test_trees_beat_the_linear_ranker_on_held_out_queries(spark):
    """Relevance is high in the middle of a feature and where two signs differ: nothing a weighted sum can say."""
    rng = random.Random(7)
    rows = []
    for q in range(160):
        for i in range(12):
            a, b, c = rng.uniform(-1, 1), rng.uniform(-1, 1), rng.uniform(-1, 1)
            rows.append((q, i, int(abs(a) < 0.3 and b * c < 0 and rng.random() < 0.9), a, b, c if rng.random() < 0.95 else None))
    df = spark.createDataFrame(rows, "query_id int, item_id int, y int, a double, b double, c double").where("y >= 0")
    fit, valid, test = df.where("query_id < 90"), df.where("query_id between 90 and 119"), df.where("query_id >= 120")
    trees = ml.TreeRanker(["a", "b", "c"], trees=14, rate=0.3, patience=4, columns=1.0).fit(fit, valid)
    line = ml.PairwiseRanker(["a", "b", "c"]).fit(fit)
    scores = [ml.TreeRanker.ndcg(m.transform(test).withColumnRenamed("pred", "score"), 5) for m in (trees, line)]
    assert scores[0] > scores[1] + 0.2, scores
    assert len(trees.model.trees) <= 14 and set(trees.importance()) == {"a", "b", "c"}


def test_peeking_classifier_sees_a_leak(spark):
    rng = random.Random(1)
    make = lambda shift: spark.createDataFrame([(q, 1, rng.gauss(0, 1), rng.gauss(shift, 1)) for q in range(300)], "query_id int, y int, a double, b double")
    clean, leaky = make(0.0), make(2.0)
    assert ml.peeking_auc(make(0.0), clean, ["a", "b"]) < 0.6 and ml.peeking_auc(clean, leaky, ["a", "b"]) > 0.85


def test_class_model(spark):
    docs = spark.createDataFrame([("ремонт квартиры под ключ", "fix", 1.0), ("ремонт дома", "fix", 1.0), ("уборка квартиры", "clean", 1.0), ("уборка дома после ремонта", "clean", 1.0)] * 4, "doc string, class string, w double")
    for kind in ("logistic", "bayes"):
        got = ml.ClassModel(kind, 200, 200).fit(docs).predict(spark.createDataFrame([(1, "уборка офиса")], "query_id int, doc string")).collect()
        assert abs(sum(r.p for r in got) - 1) < 1e-6 and next(r for r in got if r.class_rank == 1)["class"] == "clean"


def test_batches_hold_no_text_twice(spark):
    rng = random.Random(1)
    pairs = spark.createDataFrame(list({(f"q{k % 17}", f"d{rng.randrange(40)}") for k in range(300)}), "tn string, dh string").withColumn("q", F.col("tn"))
    for b in ml.no_duplicate_batches(pairs, 16).groupBy("batch").agg(F.count("*").alias("n"), F.count_distinct("tn").alias("a"), F.count_distinct("dh").alias("b")).collect():
        assert b.n == b.a == b.b
    with pytest.raises(NotImplementedError):
        ml.contrastive_training()


def test_aggregates_edges(spark):
    empty = spark.createDataFrame([], "query_id int, a double, b double")
    assert A.win_rate(empty, "a", "b").first().queries == 0
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 3.0, 3.0), (2, None, 1.0)], "query_id int, a double, b double")
    assert A.win_rate(df, "a", "b").first().win_rate == 0.25


def test_microcat_proba_reads_whole_texts(spark):
    from types import SimpleNamespace

    from trovine.plans.learning import microcat_proba

    same = "one opening that all of the documents share " * 4
    docs = [(k, same + ("red apples " if k % 2 else "blue stones ") * 3, "x" if k % 2 else "y") for k in range(12)]
    t = SimpleNamespace(
        documents=spark.createDataFrame(docs, "doc_id long, text string, lang string"),
        labels=spark.createDataFrame([(k,) for k in range(12)], "doc_id long"),
        benchmark=spark.createDataFrame([(1, "red apples"), (2, "blue stones")], "item_id long, text string"),
    )
    got = {r.query_id: (r["class"], r.p) for r in microcat_proba(t).where("class_rank = 1").collect()}
    assert got[1][0] == "x" and got[2][0] == "y" and min(p for _, p in got.values()) > 0.55, got
