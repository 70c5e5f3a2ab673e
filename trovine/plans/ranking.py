"""Queries on within-query windows, top-k, fusion and rerankers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fusion as U
from ..operators import ml
from ..operators import rerank as R
from ..operators import topk as K
from ..operators import windows as W
from . import roles
from .registry import query

A, B, C = ("LIST_A", "LIST_B", "LIST_C")


def _lists(t, *names):
    return [roles.of(t, n) for n in names]


def _window(name, expr, sql_expr, digits=6):
    """One window column over list a, rounded."""

    @query(name, roles.sql(f"SELECT query_id, item_id, round({sql_expr}, {digits}) AS value FROM (SELECT a.*, CASE WHEN item_id % 9 = 0 THEN NULL ELSE score END AS s FROM list_a a) a", A))
    def run(t):
        rows = roles.of(t, A).withColumn("s", F.when(F.col("item_id") % 9 != 0, F.col("score")))
        return rows.select("query_id", "item_id", F.round(expr(), digits).alias("value"))

    return run


_Q = "OVER (PARTITION BY query_id)"
_window("pct_rank_avg", lambda: W.percentile_rank("s"), f"CASE WHEN s IS NOT NULL THEN (rank() OVER (PARTITION BY query_id ORDER BY s NULLS LAST) + (count(*) OVER (PARTITION BY query_id, s) - 1) / 2.0::DOUBLE) / count(s) {_Q} END")
_window("ratio_to_max", lambda: W.ratio_to_max("s"), f"coalesce(s / nullif(max(s) {_Q}, 0), 0)")
_window("gap_to_max", lambda: W.gap_to_max("s"), f"s - max(s) {_Q}")
_window("zscore", lambda: W.zscore("s"), f"(s - avg(s) {_Q}) / (stddev_samp(s) {_Q} + 0.000001::DOUBLE)", 5)
_window("score_gap50", lambda: W.gap_to_place("score"), f"score - coalesce(max(CASE WHEN rank = 50 THEN score END) {_Q}, 0)")
_window("global_rank", lambda: W.global_rank("s").cast("double"), "CAST(rank() OVER (PARTITION BY query_id ORDER BY s DESC NULLS LAST) AS DOUBLE)")
_window("minmax_norm", lambda: W.min_max("s"), f"CASE WHEN max(s) {_Q} > min(s) {_Q} THEN (s - min(s) {_Q}) / (max(s) {_Q} - min(s) {_Q}) ELSE 1 END")
_window("z_norm", lambda: W.z_norm("s"), f"CASE WHEN stddev_pop(s) {_Q} > 0 THEN (s - avg(s) {_Q}) / stddev_pop(s) {_Q} ELSE 0 END", 5)


@query("location_share", roles.sql("SELECT query_id, item_id, round(count(*) OVER (PARTITION BY query_id, item_id % 20) / count(*) OVER (PARTITION BY query_id)::DOUBLE, 6) AS value FROM list_a", A))
def location_share(t):
    rows = roles.of(t, A).withColumn("item_location_id", F.col("item_id") % 20)
    return rows.select("query_id", "item_id", F.round(W.location_share(), 6).alias("value"))


@query("group_median", roles.sql("SELECT a.query_id, item_id, round(m, 6) AS median FROM list_a a JOIN (SELECT query_id, median(score) AS m FROM list_a GROUP BY 1) x ON a.query_id = x.query_id", A))
def group_median(t):
    return W.group_median(roles.of(t, A), "score").select("query_id", "item_id", F.round("median", 6).alias("median"))


@query("head_per_group", "SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY md5('1|' || l_orderkey || '|' || l_linenumber), l_orderkey, l_linenumber) AS r FROM lineitem) x WHERE r <= 20")
def head_per_group(t):
    from ..functions.numeric import seeded_order

    return W.head(t.lineitem, ["l_suppkey"], [seeded_order("l_orderkey", "l_linenumber", seed=1), "l_orderkey", "l_linenumber"], 20).select("l_suppkey", "l_orderkey", "l_linenumber")


_TIERS = "SELECT query_id, item_id, CAST(item_id % 3 AS INT) AS tier FROM list_a WHERE item_id % 4 < 3"


@query("tiered_topk", roles.sql(f"SELECT query_id, item_id, CAST(r AS INT) AS rank, CASE WHEN tier < 9 THEN 1 ELSE 0 END AS from_tier FROM (SELECT a.query_id, a.item_id, coalesce(tier, 9) AS tier, row_number() OVER (PARTITION BY a.query_id ORDER BY coalesce(tier, 9), score DESC, a.item_id) AS r FROM list_a a LEFT JOIN ({_TIERS}) t ON t.query_id = a.query_id AND t.item_id = a.item_id) x WHERE r <= 300", A))
def tiered_topk(t):
    a = roles.of(t, A).drop("rank")
    tiers = a.where("item_id % 4 < 3").select("query_id", "item_id", (F.col("item_id") % 3).cast("int").alias("tier"))
    return K.tiered_top_k(a, tiers, 300).select("query_id", "item_id", "rank", "from_tier")


@query("city_first", roles.sql("SELECT query_id, item_id, CAST(r AS INT) AS rank FROM (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN item_id % 20 = query_id % 20 THEN 0 ELSE 1 END, score DESC, item_id) AS r FROM list_a WHERE score > 0) x WHERE r <= 100", A))
def city_first(t):
    a = roles.of(t, A).drop("rank").withColumn("item_location_id", F.col("item_id") % 20)
    q = a.select("query_id", (F.col("query_id") % 20).alias("search_location_id")).distinct()
    return K.city_first(a, q, 100, positive=True).select("query_id", "item_id", "rank")


@query("topn_fallback", roles.sql("SELECT query_id, item_id, CAST(source AS INT) AS source, CAST(row_number() OVER (PARTITION BY query_id ORDER BY source, old, item_id) AS INT) AS rank FROM (SELECT query_id, item_id, min(p) // 100000 AS source, min(p) % 100000 AS old FROM (SELECT query_id, item_id, rank AS p FROM list_a WHERE rank <= 20 UNION ALL SELECT query_id, item_id, 100000 + rank FROM list_b) y GROUP BY 1, 2) x QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY source, old, item_id) <= 50", A, B))
def topn_fallback(t):
    a, b = _lists(t, A, B)
    return K.fill([a.where("rank <= 20"), b], 50)


@query("fill_popular", roles.sql("SELECT query_id, item_id, CAST(rank AS INT) AS rank FROM (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY min(p), item_id) AS rank FROM (SELECT query_id, item_id, rank AS p FROM list_a WHERE rank <= 20 UNION ALL SELECT q.query_id, g.item_id, 100000 + g.rank FROM (SELECT DISTINCT query_id FROM list_a) q, (SELECT l_partkey AS item_id, row_number() OVER (ORDER BY count(*) DESC, l_partkey) AS rank FROM lineitem GROUP BY 1 ORDER BY rank LIMIT 50) g) y GROUP BY 1, 2) x WHERE rank <= 50", A))
def fill_popular(t):
    from ..operators.aggregates import popularity

    a = roles.of(t, A)
    everyone = popularity(t.lineitem.select(F.col("l_partkey").alias("item_id")), k=50)
    return K.fill_global(a, [a.where("rank <= 20").select("query_id", "item_id", "rank")], everyone, 50).select("query_id", "item_id", "rank")


_QUOTA = """SELECT query_id, item_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cls, rank, item_id) AS INT) AS rank FROM (
SELECT *, CASE WHEN query_id % 4 = 0 THEN 0 WHEN m AND i <= least(nm, 50 - least(5, nn)) THEN 1 WHEN NOT m AND i <= least(50 - least(nm, 50 - least(5, nn)), nn) THEN 2 ELSE 3 END AS cls FROM (
SELECT query_id, item_id, rank, item_id % 3 = 0 AS m, row_number() OVER (PARTITION BY query_id, item_id % 3 = 0 ORDER BY rank, item_id) AS i, count(*) FILTER (item_id % 3 = 0) OVER (PARTITION BY query_id) AS nm, count(*) FILTER (item_id % 3 <> 0) OVER (PARTITION BY query_id) AS nn FROM list_a) x) y"""


@query("quota_rerank", roles.sql(_QUOTA, A))
def quota_rerank(t):
    a = roles.of(t, A).withColumn("m_all", F.col("item_id") % 3 == 0).withColumn("q_any", F.col("query_id") % 4 != 0)
    return K.quota(a).select("query_id", "item_id", "rank")


@query("top_lists", roles.sql("SELECT query_id, list(item_id ORDER BY rank) AS items FROM list_a WHERE rank <= 10 GROUP BY 1", A))
def top_lists(t):
    return K.top_lists(roles.of(t, A), 10)


_RRF = """SELECT query_id, item_id, round(score, 9) AS score, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first, item_id) AS r FROM (
SELECT query_id, item_id, sum(w / (60.0::DOUBLE + rank)){0} AS score, min(list * 1000000000 + rank) AS first FROM (
SELECT query_id, item_id, rank, 0 AS list, {1}::DOUBLE AS w FROM list_a UNION ALL SELECT query_id, item_id, rank, 1, {2}::DOUBLE FROM list_b) u GROUP BY 1, 2) y) x WHERE r <= 300"""


@query("rrf", roles.sql(_RRF.format("", 1.0, 1.0), A, B))
def rrf(t):
    return U.rrf(_lists(t, A, B)).withColumn("score", F.round("score", 9))


@query("rrf_weighted", roles.sql(_RRF.format("", 0.7, 1.3), A, B))
def rrf_weighted(t):
    return U.rrf(_lists(t, A, B), weights=[0.7, 1.3]).withColumn("score", F.round("score", 9))


@query("rrf_bonus", roles.sql(_RRF.format(" + CASE WHEN item_id % 20 = query_id % 20 THEN 0.015::DOUBLE ELSE 0 END", 1.0, 1.0), A, B))
def rrf_bonus(t):
    a, b = _lists(t, A, B)
    bonus = a.select("query_id", "item_id").union(b.select("query_id", "item_id")).distinct().where("item_id % 20 = query_id % 20").withColumn("bonus", F.lit(0.015))
    return U.rrf([a, b], bonus=bonus).withColumn("score", F.round("score", 9))


_FUSE = """SELECT query_id, item_id, round(score, 6) AS score, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, item_id) AS r FROM (
SELECT query_id, item_id, 0.5::DOUBLE * coalesce(sa, min(sa) OVER (PARTITION BY query_id), 0) + 0.5::DOUBLE * coalesce(sb, min(sb) OVER (PARTITION BY query_id), 0) AS score FROM (
SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.item_id, b.item_id) AS item_id, sa, sb FROM (SELECT query_id, item_id, {0} AS sa FROM list_a) a
FULL JOIN (SELECT query_id, item_id, {0} AS sb FROM list_b) b ON a.query_id = b.query_id AND a.item_id = b.item_id) u) y) x WHERE r <= 300"""


@query("fuse_weighted_minmax", roles.sql(_FUSE.format(f"CASE WHEN max(score) {_Q} > min(score) {_Q} THEN (score - min(score) {_Q}) / (max(score) {_Q} - min(score) {_Q}) ELSE 1 END"), A, B))
def fuse_minmax(t):
    a, b = _lists(t, A, B)
    return U.weighted(a, b).withColumn("score", F.round("score", 6))


@query("fuse_weighted_z", roles.sql(_FUSE.format(f"CASE WHEN stddev_pop(score) {_Q} > 0 THEN (score - avg(score) {_Q}) / stddev_pop(score) {_Q} ELSE 0 END").replace("round(score, 6) AS score", "round(score, 4) AS score").replace("round(score, 12)", "round(score, 8)"), A, B))
def fuse_z(t):
    a, b = _lists(t, A, B)
    return U.weighted(a, b, norm="z", digits=8).withColumn("score", F.round("score", 4))


@query("interleave", roles.sql("SELECT query_id, item_id, CAST(r AS INT) AS rank FROM (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY min(p), item_id) AS r FROM (SELECT query_id, item_id, 2 * rank - 1 AS p FROM list_a UNION ALL SELECT query_id, item_id, 2 * rank FROM list_b) u GROUP BY 1, 2) x WHERE r <= 300", A, B))
def interleave(t):
    return U.interleave(*_lists(t, A, B)).select("query_id", "item_id", "rank")


@query("late_fusion", roles.sql("SELECT query_id, item_id, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, r1 NULLS LAST, r2 NULLS LAST, item_id) AS INT) AS rank FROM (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.item_id, b.item_id) AS item_id, a.rank AS r1, b.rank AS r2, coalesce(1 / (60.0::DOUBLE + a.rank), 0) + coalesce(0.5::DOUBLE / (60.0::DOUBLE + b.rank), 0) AS score FROM list_a a FULL JOIN list_b b ON a.query_id = b.query_id AND a.item_id = b.item_id) x", A, B))
def late_fusion(t):
    a, b = _lists(t, A, B)
    return U.late(a, b, 0.5).withColumn("score", F.round("score", 9))


_CE = """SELECT query_id, item_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY head DESC, {0}, rank) AS INT) AS rank FROM (
SELECT *, row_number() OVER (PARTITION BY query_id, head ORDER BY ce DESC NULLS LAST, rank) AS cer FROM (SELECT query_id, item_id, rank, rank <= 100 AS head, CASE WHEN rank <= 100 THEN CAST(item_id % 997 AS DOUBLE) END AS ce FROM list_a) x) y"""


def _ce(t, mode, keep=0):
    a = roles.of(t, A)
    ce = a.where("rank <= 100").select("query_id", "item_id", (F.col("item_id") % 997).cast("double").alias("ce"))
    return U.rerank_head(a, ce, mode, 100, keep).select("query_id", "item_id", "rank")


query("pair_rerank", roles.sql(_CE.format("CASE WHEN head THEN cer ELSE rank END"), A))(lambda t: _ce(t, "ce"))
query("pair_rerank_rrf", roles.sql(_CE.format("CASE WHEN head THEN round(-(1 / (60.0::DOUBLE + rank) + 1 / (60.0::DOUBLE + cer)), 12) ELSE rank END"), A))(lambda t: _ce(t, "rrf"))
query("pair_rerank_keep", roles.sql(_CE.format("CASE WHEN head AND rank <= 10 THEN rank - 1000000000 WHEN head THEN cer ELSE rank END"), A))(lambda t: _ce(t, "keep", 10))


_UNION = """SELECT query_id, item_id, round(coalesce(s, 0), 6) AS score, CAST(coalesce(r, n + t) AS INT) AS rank, CAST(coalesce(ft, 101) AS INT) AS ft_rank, CAST(is_new AS INT) AS is_new FROM (
SELECT *, row_number() OVER (PARTITION BY query_id, is_new ORDER BY ft NULLS LAST, item_id) AS t FROM (
SELECT coalesce(f.query_id, e.query_id) AS query_id, coalesce(f.item_id, e.item_id) AS item_id, f.score AS s, f.rank AS r, e.rank AS ft, CASE WHEN f.rank <= 150 THEN 0 ELSE 1 END AS is_new
FROM list_a f FULL JOIN (SELECT * FROM list_c WHERE rank <= 100) e ON f.query_id = e.query_id AND f.item_id = e.item_id WHERE f.rank IS NULL OR f.rank <= 150 OR e.rank IS NOT NULL) x) y
JOIN (SELECT query_id AS q, max(rank) AS n FROM list_a GROUP BY 1) z ON y.query_id = z.q"""


@query("union_candidates", roles.sql(_UNION, A, C))
def union_candidates(t):
    a, c = _lists(t, A, C)
    return U.union_candidates(a, c.where("rank <= 100"), k=150).withColumn("score", F.round("score", 6))


_VAR = _RRF.format("", 1.0, 1.0).replace("x WHERE r <= 300", "x WHERE r <= 20")


@query(
    "fusion_variants",
    roles.sql("SELECT 'ab' AS variant, * FROM (" + _VAR + ") v1 UNION ALL SELECT 'ac', * FROM (" + _VAR.replace("list_b", "list_c") + ") v2", A, B, C),
)
def fusion_variants(t):
    a, b, c = _lists(t, A, B, C)
    return U.variants({"ab": [a, b], "ac": [a, c]}, n=20).withColumn("score", F.round("score", 9))


_HITS = "SELECT l.query_id, l.item_id, EXISTS (SELECT 1 FROM list_a a WHERE a.rank <= 50 AND a.query_id = l.query_id AND a.item_id = l.item_id) AS ina, EXISTS (SELECT 1 FROM list_b b WHERE b.rank <= 50 AND b.query_id = l.query_id AND b.item_id = l.item_id) AS inb FROM labels_ l"


@query("set_overlap", roles.sql(f"SELECT count(*) FILTER (ina AND inb) AS both_, count(*) FILTER (ina AND NOT inb) AS only_a, count(*) FILTER (NOT ina AND inb) AS only_b, count(*) FILTER (NOT ina AND NOT inb) AS none_ FROM ({_HITS}) x", A, B, "LABELS").replace("labels AS", "labels_ AS"))
def set_overlap(t):
    a, b, labels = _lists(t, A, B, "LABELS")
    return U.overlap(a, b, labels).withColumnsRenamed({"both": "both_", "none": "none_"})


@query("moved_answers", roles.sql("SELECT l.query_id, l.item_id, CASE WHEN coalesce(b.rank <= 50, false) THEN 'in' ELSE 'out' END AS move, a.rank AS rank_a, b.rank AS rank_b FROM labels_ l LEFT JOIN list_a a ON a.query_id = l.query_id AND a.item_id = l.item_id LEFT JOIN list_b b ON b.query_id = l.query_id AND b.item_id = l.item_id WHERE coalesce(a.rank <= 50, false) <> coalesce(b.rank <= 50, false)", A, B, "LABELS").replace("labels AS", "labels_ AS"))
def moved_answers(t):
    return U.moved(*_lists(t, A, B, "LABELS"))


@query("same_top", roles.sql("SELECT coalesce(a.query_id, b.query_id) AS query_id, count(*) FILTER (a.item_id IS NOT NULL AND b.item_id IS NOT NULL) AS shared, count(*) FILTER (a.item_id IS NULL OR b.item_id IS NULL) = 0 AS equal_sets FROM (SELECT * FROM list_a WHERE rank <= 50) a FULL JOIN (SELECT * FROM list_b WHERE rank <= 50) b ON a.query_id = b.query_id AND a.item_id = b.item_id GROUP BY 1", A, B))
def same_top(t):
    return U.same_top(*_lists(t, A, B))


_QUALITY = """SELECT item_id, round(ln(1 + coalesce(reviews, 0)), 6) AS rev_log, CAST(coalesce(reviews, 0) > 0 AS DOUBLE) AS has_rev, CAST(coalesce(rating > 0, false) AS DOUBLE) AS has_rating,
CASE WHEN rating > 0 THEN rating ELSE 0 END AS rating_f, CASE WHEN rating > 0 THEN rating - 4.5 ELSE 0 END AS rating_c, CAST(coalesce(price, -1) <= 1 AS DOUBLE) AS price_stub,
round(CASE WHEN price > 1 THEN ln(1 + price) ELSE 0 END, 6) AS price_log, CAST(phone_hidden AS DOUBLE) AS phone_hidden, CAST(msg_forbidden AS DOUBLE) AS msg_forbidden,
round(ln(1 + length(description)), 6) AS desc_log, CAST(length(title) AS DOUBLE) AS title_len FROM items"""


@query("quality_features", roles.sql(_QUALITY, "ITEMS"))
def quality_features(t):
    out = R.item_quality(roles.of(t, "ITEMS"))
    return out.select(*(F.round(c, 6).alias(c) if c in ("rev_log", "price_log", "desc_log") else F.col(c) for c in out.columns))


_PCT = "(rank() OVER (PARTITION BY query_id ORDER BY {0}) + (count(*) OVER (PARTITION BY query_id, {0}) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY query_id)"


@query("quality_rerank", roles.sql(f"SELECT query_id, item_id, round(round(s, 12) + 0.0000000000001::DOUBLE, 9) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, rank, item_id) AS INT) AS rank FROM (SELECT query_id, item_id, rank, score / 1000 + 0.0025::DOUBLE * {_PCT.format('ln(1 + reviews)')} + 0.0019::DOUBLE * {_PCT.format('CASE WHEN rating > 0 THEN rating ELSE 0 END')} AS s FROM list_a JOIN items USING (item_id)) x", A, "ITEMS"))
def quality_rerank(t):
    a = roles.of(t, A).withColumn("score", F.col("score") / 1000)
    # A hair above halves, so that both engines round alike.
    return R.quality_bonus(a, R.item_quality(roles.of(t, "ITEMS"))).withColumn("score", F.round(F.round("score", 12) + 1e-13, 9))


#: Class probabilities from counts of the log, by query text; a supplier's text is that of the part with its key.
_CLASSES = "SELECT q.p_partkey AS query_id, x.class, (x.n + 1) / CAST(sum(x.n) OVER w + count(*) OVER w AS DOUBLE) AS p, row_number() OVER (PARTITION BY q.p_partkey ORDER BY x.n DESC, x.class) AS class_rank FROM part q JOIN (SELECT p_name, p_brand AS class, count(*) AS n FROM part GROUP BY 1, 2) x ON q.p_name = x.p_name WINDOW w AS (PARTITION BY q.p_partkey)"


def _classes(t, only=None):
    """Classes of every part's text as a query, or of the queries in ``only``."""
    log = t.part.select(F.col("p_name").alias("search_query"), F.col("p_brand").alias("class"))
    q = t.part.select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("search_query"))
    q = q.join(only, "query_id", "left_semi") if only is not None else q
    return q.join(ml.count_classes(log), "search_query").select("query_id", "class", "p", "class_rank")


@query("class_probability", f"SELECT query_id, class, round(p, 6) AS p, CAST(class_rank AS INT) AS class_rank FROM ({_CLASSES}) x")
def class_probability(t):
    return _classes(t).withColumn("p", F.round("p", 6))


_META = f"""SELECT query_id, item_id, round(s, 9) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, rank, item_id) AS INT) AS rank FROM (
SELECT a.query_id, a.item_id, a.rank, a.score / 1000 + 0.003::DOUBLE * CASE WHEN a.item_id % 3 = 0 THEN 1 ELSE 0 END + 0.0015::DOUBLE * CASE WHEN a.item_id % 5 = 0 THEN 1 ELSE 0 END + 0.007::DOUBLE * coalesce(c.p, 0) + 0.002::DOUBLE * coalesce(k / n::DOUBLE, 0) AS s
FROM list_a a JOIN items i ON a.item_id = i.item_id LEFT JOIN ({_CLASSES}) c ON c.query_id = a.query_id AND c.class = i.class
LEFT JOIN (SELECT query_id, class, count(*) AS k FROM list_a JOIN items USING (item_id) WHERE rank <= 20 GROUP BY 1, 2) h ON h.query_id = a.query_id AND h.class = i.class
LEFT JOIN (SELECT query_id, count(*) AS n FROM list_a WHERE rank <= 20 GROUP BY 1) z ON z.query_id = a.query_id) x"""


@query("meta_bonus", roles.sql(_META, A, "ITEMS"))
def meta_bonus(t):
    items = roles.of(t, "ITEMS")
    a = roles.of(t, A).withColumn("score", F.col("score") / 1000)
    rows = R.prf(a, items, 20).withColumn("m_vid", F.col("item_id") % 3 == 0).withColumn("m_tip", F.col("item_id") % 5 == 0)
    return R.meta_bonus(ml.attach_classes(rows, items, _classes(t))).withColumn("score", F.round("score", 9))


@query("pool_weights", "WITH r AS (SELECT c_custkey AS query_id, c_nationkey % 2 AS stratum, pow(count(*) OVER (PARTITION BY c_nationkey)::DOUBLE, -0.5::DOUBLE) AS w FROM customer), m AS (SELECT stratum, sum(w) AS m FROM r GROUP BY 1), v AS (SELECT query_id, w * CASE WHEN r.stratum = 0 THEN 0.3::DOUBLE ELSE 0.7::DOUBLE END / (m / (SELECT sum(w) FROM r)) AS w FROM r JOIN m ON r.stratum = m.stratum) SELECT query_id, round(w / (SELECT avg(w) FROM v), 6) AS weight FROM v")
def pool_weights(t):
    pool = t.customer.select(F.col("c_custkey").alias("query_id"), F.col("c_nationkey").cast("string").alias("text_norm"), (F.col("c_nationkey") % 2).alias("stratum"))
    target = t.spark.createDataFrame([(0, 0.3), (1, 0.7)], "stratum int, share double")
    return R.pool_weights(pool, target).withColumn("weight", F.round("weight", 6))


def feature_inputs(t):
    """Candidates of list a with all sources, and the tables that the features need."""
    items = roles.of(t, "ITEMS")
    log = roles.of(t, "LOG")
    a, b, c = _lists(t, A, B, C)
    key = ["query_id", "item_id"]
    cands = a.join(b.select(*key, F.col("score").alias("bm25"), F.col("rank").alias("bm25_grank")), key, "left")
    cands = cands.join(c.select(*key, F.col("score").alias("ft_cos"), F.col("rank").alias("ft_cos_grank")), key, "left")
    cands = cands.select(
        *key, "score", "rank",
        F.coalesce("bm25", F.lit(0.0)).alias("bm25"), F.coalesce("bm25_grank", F.lit(9999)).alias("bm25_grank"),
        (F.col("item_id") % 101 / 101).alias("cos"), (F.col("item_id") % 101 + 1).alias("cos_grank"),
        F.coalesce("ft_cos", F.lit(0.0)).alias("ft_cos"), F.coalesce("ft_cos_grank", F.lit(9999)).alias("ft_cos_grank"),
        F.least(F.coalesce("ft_cos_grank", F.lit(101)), F.lit(101)).alias("ft_rank"), (F.col("rank") > 80).cast("int").alias("is_new"),
        (F.col("query_id") % 4 > 0).alias("q_vid"), (F.col("query_id") % 4 == 2).alias("q_tip"), (F.col("item_id") % 3 == 0).alias("m_vid"), (F.col("item_id") % 5 == 0).alias("m_tip"), (F.col("item_id") % 15 == 0).alias("m_all"),
    )
    q = t.part.select(
        F.col("p_partkey").alias("query_id"), F.col("p_name").alias("search_query"), F.expr("CASE WHEN p_size % 2 = 0 THEN p_type END").alias("filters"), (F.col("p_partkey") % 25).cast("int").alias("search_location_id"),
        (F.col("p_size") % 3 == 0).alias("delivery"), (F.col("p_size") % 5 == 0).alias("text_in_train"), (F.col("p_partkey") % 25 >= 20).alias("is_region"), (F.col("p_partkey") % 25 == 24).alias("is_country"),
    )
    from ..operators import geo as G

    anchors = q.select("search_location_id", (F.col("search_location_id") % 20).alias("anchor")).distinct()
    only = t.lineitem.select(F.col("l_suppkey").alias("query_id")).distinct()
    return cands, items, q.join(only, "query_id", "left_semi"), G.pair_share(log), G.centroids(items), anchors, _classes(t, only)


def _features_sql() -> str:
    pct = "CASE WHEN {0} IS NOT NULL THEN (rank() OVER (PARTITION BY query_id ORDER BY {0} NULLS LAST) + (count(*) OVER (PARTITION BY query_id, {0}) - 1) / 2.0::DOUBLE) / count({0}) OVER q END"
    z = "({0} - avg({0}) OVER q) / (stddev_samp({0}) OVER q + 0.000001::DOUBLE)"
    words = "list_distinct(list_transform(list_filter(regexp_extract_all(replace(lower({0}), 'ё', 'е'), '[а-яa-z0-9]+'), lambda x: length(x) > 1), lambda x: x[1:5]))"
    over = "CASE WHEN len({0}) > 0 THEN len(list_intersect({0}, {1})) / len({0})::DOUBLE ELSE 0 END"
    body = "title || ' ' || params || ' ' || substr(description, 1, 500)"
    km = "2 * 6371 * asin(sqrt(least(1.0::DOUBLE, pow(sin((radians(lat) - radians(clat)) / 2), 2) + cos(radians(clat)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(clon)) / 2), 2))))"
    made = {
        "g_rank": "rank", "g_score": "score", "g_score_max": "coalesce(score / nullif(max(score) OVER q, 0), 0)", "g_gap50": "score - coalesce(max(CASE WHEN rank = 50 THEN score END) OVER q, 0)",
        "bm25": "bm25", "bm25_grank": "ln(1 + bm25_grank)", "bm25_pct": pct.format("bm25"), "bm25_max": "coalesce(bm25 / nullif(max(bm25) OVER q, 0), 0)", "bm25_zero": "CASE WHEN bm25 <= 0 THEN 1 ELSE 0 END",
        "cos": "cos", "cos_grank": "ln(1 + cos_grank)", "cos_pct": pct.format("cos"), "cos_gap": "cos - max(cos) OVER q", "cos_z": z.format("cos"),
        "log_reviews": "ln(1 + coalesce(reviews, 0))", "rating": "rating", "has_rating": "CASE WHEN rating IS NOT NULL THEN 1 ELSE 0 END", "price_stub": "CASE WHEN coalesce(price, -1) <= 1 THEN 1 ELSE 0 END", "log_price": "log_price",
        "phone_hidden": "CAST(phone_hidden AS DOUBLE)", "msg_forbidden": "CAST(msg_forbidden AS DOUBLE)", "desc_len": "length(description)", "title_len": "length(title)",
        "title_overlap": over.format(words.format("search_query"), words.format("title")), "q_words": "len(string_split(search_query, ' '))", "q_has_filter": "CASE WHEN filters IS NULL THEN 0 ELSE 1 END",
        "q_text_in_train": "CAST(text_in_train AS DOUBLE)", "q_delivery": "CAST(delivery AS DOUBLE)", "q_region": "CAST(is_region AS DOUBLE)", "q_russia": "CAST(is_country AS DOUBLE)",
        "same_city": "CASE WHEN sl = item_location_id THEN 1 ELSE 0 END", "loc_share": "loc_share", "loc_share_log": "log10(loc_share + 0.0001::DOUBLE)", "dist_log": f"ln(1 + {km})",
        "loc_in_cands": "count(*) OVER (PARTITION BY query_id, item_location_id) / count(*) OVER q", "q_vid": "CASE WHEN query_id % 4 > 0 THEN 1 ELSE 0 END", "q_tip": "CASE WHEN query_id % 4 = 2 THEN 1 ELSE 0 END",
        "m_vid": "m_vid", "m_tip": "m_tip", "m_all": "CASE WHEN item_id % 15 = 0 THEN 1 ELSE 0 END", "p_mc": "p_mc", "mc_rank": "ln(1 + coalesce(class_rank, 10000))", "p_mc_top": "p_top", "p_mc_rel": "p_mc / greatest(p_top, 0.000001::DOUBLE)",
        "prf20": "prf20", "prf50": "prf50", "manual": "manual", "manual_pct": pct.format("manual"), "phrase_title": "CASE WHEN contains(lower(title), lower(search_query)) THEN 1 ELSE 0 END",
        "phrase_text": f"CASE WHEN contains(lower({body}), lower(search_query)) THEN 1 ELSE 0 END", "text_overlap": over.format(words.format("search_query"), words.format(body)), "price_rel": "log_price - median(log_price) OVER q",
        "ft_cos": "ft_cos", "ft_cos_grank": "ln(1 + ft_cos_grank)", "ft_rank": "least(ft_rank, 101)", "ft_cos_pct": pct.format("ft_cos"), "ft_cos_gap": "ft_cos - max(ft_cos) OVER q", "ft_cos_z": z.format("ft_cos"), "is_new": "CASE WHEN rank > 80 THEN 1 ELSE 0 END",
    }
    # A hair above halves, so that sums of terminating decimals round alike in both engines.
    cells = ", ".join(f"round(CAST({made[f]} AS DOUBLE) + 0.0000000001::DOUBLE, 8) AS {f}" for f in R.FEATURES)
    base = f"""SELECT a.query_id, a.item_id, a.rank, a.score, i.title, i.params, i.description, i.item_location_id, i.lat, i.lon, i.class, i.rating, i.reviews, i.price, i.phone_hidden, i.msg_forbidden,
    coalesce(b.score, 0) AS bm25, coalesce(b.rank, 9999) AS bm25_grank, a.item_id % 101 / 101.0::DOUBLE AS cos, a.item_id % 101 + 1 AS cos_grank, coalesce(c.score, 0) AS ft_cos, coalesce(c.rank, 9999) AS ft_cos_grank, coalesce(c.rank, 101) AS ft_rank,
    CASE WHEN a.item_id % 3 = 0 THEN 1 ELSE 0 END AS m_vid, CASE WHEN a.item_id % 5 = 0 THEN 1 ELSE 0 END AS m_tip, CASE WHEN coalesce(i.price, -1) > 1 THEN ln(1 + i.price) END AS log_price,
    p.p_name AS search_query, CASE WHEN p.p_size % 2 = 0 THEN p.p_type END AS filters, CAST(p.p_partkey % 25 AS INT) AS sl, p.p_size % 3 = 0 AS delivery, p.p_size % 5 = 0 AS text_in_train, p.p_partkey % 25 >= 20 AS is_region, p.p_partkey % 25 = 24 AS is_country
    FROM list_a a JOIN items i ON i.item_id = a.item_id JOIN part p ON p.p_partkey = a.query_id LEFT JOIN list_b b ON b.query_id = a.query_id AND b.item_id = a.item_id LEFT JOIN list_c c ON c.query_id = a.query_id AND c.item_id = a.item_id"""
    wide = f"""SELECT x.*, coalesce(s.share, 0) AS loc_share, k.clat, k.clon, coalesce(y.p, 0) AS p_mc, y.class_rank, coalesce(max(y.p) OVER (PARTITION BY x.query_id), 0) AS p_seen, coalesce(t.p_top, 0) AS p_top,
    sum(CASE WHEN rank <= 20 THEN 1 ELSE 0 END) OVER (PARTITION BY x.query_id, x.class) / CAST(sum(CASE WHEN rank <= 20 THEN 1 ELSE 0 END) OVER (PARTITION BY x.query_id) AS DOUBLE) AS prf20,
    sum(CASE WHEN rank <= 50 THEN 1 ELSE 0 END) OVER (PARTITION BY x.query_id, x.class) / CAST(sum(CASE WHEN rank <= 50 THEN 1 ELSE 0 END) OVER (PARTITION BY x.query_id) AS DOUBLE) AS prf50
    FROM base x LEFT JOIN shares s ON s.search_location_id = x.sl AND s.item_location_id = x.item_location_id LEFT JOIN cent k ON k.item_location_id = x.sl % 20
    LEFT JOIN classes y ON y.query_id = x.query_id AND y.class = x.class LEFT JOIN (SELECT query_id, max(p) AS p_top FROM classes GROUP BY 1) t ON t.query_id = x.query_id"""
    full = "SELECT w.*, score + 0.003::DOUBLE * m_vid + 0.0015::DOUBLE * m_tip + 0.007::DOUBLE * p_mc + 0.002::DOUBLE * prf20 AS manual FROM wide w"
    return roles.sql("{0}", "LOG", "ITEMS", A, B, C, "SHARES", "CENT").replace(" {0}", f", classes AS ({_CLASSES}), base AS ({base}), wide AS ({wide}), full_ AS ({full}) SELECT query_id, item_id, rank, {cells} FROM full_ WINDOW q AS (PARTITION BY query_id)")


@query("features_59", _features_sql())
def features_59(t):
    out = R.features(*feature_inputs(t))
    return out.select("query_id", "item_id", "rank", *(F.round(F.col(f).cast("double") + 1e-10, 8).alias(f) for f in R.FEATURES))


@query("ensemble_z", roles.sql(f"SELECT query_id, item_id, round((coalesce((score - avg(score) {_Q}) / (stddev_samp(score) {_Q} + 0.000000001::DOUBLE), 0) + coalesce((m - avg(m) {_Q}) / (stddev_samp(m) {_Q} + 0.000000001::DOUBLE), 0)) / 2, 5) AS pred FROM (SELECT *, CAST(item_id % 13 AS DOUBLE) AS m FROM list_a) x", A))
def ensemble_z(t):
    rows = roles.of(t, A).withColumn("m", (F.col("item_id") % 13).cast("double"))
    return ml.ensemble(rows, ["score", "m"]).withColumn("pred", F.round("pred", 5))


@query("ranked_rows", roles.sql("SELECT query_id, item_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY item_id % 7 DESC, rank) AS INT) AS rank FROM list_a", A))
def ranked_rows(t):
    rows = roles.of(t, A).withColumn("old", F.col("rank")).drop("rank")
    return W.renumber(rows, [F.desc(F.col("item_id") % 7), "old"]).select("query_id", "item_id", "rank")
