"""Queries on joins, aggregates and reports over the log and the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import evaluate as E
from ..operators import geo as G
from ..operators import ml
from ..operators import topk as K
from ..operators import windows as W
from ..sources import io
from ..streaming import incremental
from . import roles
from .registry import query

#: Regions and maps of the log, as SQL.
_MAPS = roles.sql("{0}", "LOG", "ITEMS", "REGIONS", "SHARES", "CENT")
_PLACES = _MAPS.format("{0}")


def _maps(t):
    log, items = roles.of(t, "LOG"), roles.of(t, "ITEMS")
    return log, items, G.regions(log, items)


@query("region_locations", roles.sql("SELECT search_location_id FROM regions", "LOG", "ITEMS", "REGIONS"))
def region_locations(t):
    return _maps(t)[2]


@query("centroids_median", roles.sql("SELECT item_location_id, round(clat, 6) AS clat, round(clon, 6) AS clon, n_items FROM cent", "ITEMS", "CENT"))
def centroids_median(t):
    return G.centroids(roles.of(t, "ITEMS")).select("item_location_id", F.round("clat", 6).alias("clat"), F.round("clon", 6).alias("clon"), "n_items")


@query("pair_share", roles.sql("SELECT search_location_id, item_location_id, n, round(share, 6) AS share FROM shares", "LOG", "SHARES"))
def pair_share(t):
    return G.pair_share(roles.of(t, "LOG")).withColumn("share", F.round("share", 6))


@query("region_map", _PLACES.format("SELECT search_location_id, item_location_id, n, round(share, 6) AS share FROM shares WHERE search_location_id IN (SELECT * FROM regions) AND item_location_id IN (SELECT item_location_id FROM items)"))
def region_map(t):
    log, items, regions = _maps(t)
    return G.region_map(log, regions, items).select("search_location_id", "item_location_id", "n", F.round("share", 6).alias("share"))


@query(
    "city_pairs_1pct",
    _PLACES.format("SELECT search_location_id, item_location_id, n, round(share, 6) AS share FROM shares WHERE search_location_id NOT IN (SELECT * FROM regions) AND item_location_id IN (SELECT item_location_id FROM items) AND search_location_id <> item_location_id AND share >= 0.01"),
)
def city_pairs(t):
    log, items, regions = _maps(t)
    return G.city_pairs(log, regions, items, 0.01).select("search_location_id", "item_location_id", "n", F.round("share", 6).alias("share"))


@query("main_city", roles.sql("SELECT search_location_id, item_location_id AS main_city FROM (SELECT *, row_number() OVER (PARTITION BY search_location_id ORDER BY share DESC, item_location_id) AS r FROM shares) x WHERE r = 1", "LOG", "SHARES"))
def main_city(t):
    return G.main_city(G.pair_share(roles.of(t, "LOG")))


@query("popular_by_location", roles.sql("SELECT search_location_id, item_id, n, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY search_location_id ORDER BY n DESC, item_id) AS rank FROM (SELECT search_location_id, item_id, count(*) AS n FROM log GROUP BY 1, 2) y) x WHERE rank <= 20", "LOG"))
def popular_by_location(t):
    return A.popularity(roles.of(t, "LOG"), ["search_location_id"], 20)


@query("popular_global", "SELECT item_id, n, CAST(row_number() OVER (ORDER BY n DESC, item_id) AS INT) AS rank FROM (SELECT l_partkey AS item_id, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, item_id LIMIT 50) x")
def popular_global(t):
    return A.popularity(t.lineitem.select(F.col("l_partkey").alias("item_id")), k=50)


@query("popular_lists", roles.sql("SELECT search_location_id, list(item_id ORDER BY n DESC, item_id)[1:5] AS items FROM (SELECT search_location_id, item_id, count(*) AS n FROM log GROUP BY 1, 2) y GROUP BY 1", "LOG"))
def popular_lists(t):
    return A.popular_lists(roles.of(t, "LOG"), "search_location_id", 5)


@query("prf_share", roles.sql("SELECT a.query_id, a.item_id, round(coalesce(k / n::DOUBLE, 0), 6) AS prf FROM list_a a JOIN items i USING (item_id) LEFT JOIN (SELECT query_id, class, count(*) AS k FROM list_a JOIN items USING (item_id) WHERE rank <= 20 GROUP BY 1, 2) s ON s.query_id = a.query_id AND s.class = i.class LEFT JOIN (SELECT query_id, count(*) AS n FROM list_a WHERE rank <= 20 GROUP BY 1) z ON z.query_id = a.query_id WHERE a.rank <= 100", "LIST_A", "ITEMS"))
def prf_share(t):
    from ..operators.rerank import prf

    out = prf(roles.of(t, "LIST_A"), roles.of(t, "ITEMS"), 20)
    return out.where("rank <= 100").select("query_id", "item_id", F.round("prf", 6).alias("prf"))


@query("strata_shares", "SELECT c_mktsegment, c_nationkey % 2 = 0 AS even, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM customer) AS DOUBLE), 6) AS share FROM customer GROUP BY 1, 2")
def strata_shares(t):
    return A.shares(t.customer.withColumn("even", F.col("c_nationkey") % 2 == 0), "c_mktsegment", "even").withColumn("share", F.round("share", 6))


@query("slice_report", "SELECT slice, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM (SELECT c_acctbal, 'all' AS slice FROM customer UNION ALL SELECT c_acctbal, 'building' FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT c_acctbal, 'low' FROM customer WHERE c_nationkey < 10) x GROUP BY slice")
def slice_report(t):
    groups = {"all": F.lit(True), "building": F.col("c_mktsegment") == "BUILDING", "low": F.col("c_nationkey") < 10}
    return A.slices(t.customer, "c_acctbal", groups).withColumn("mean", F.round("mean", 4))


@query("dup_groups", "SELECT key, count(*) AS groups, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS excess FROM (SELECT 'title' AS key, count(*) AS n FROM part GROUP BY p_name UNION ALL SELECT 'title+type', count(*) FROM part GROUP BY p_name, p_type UNION ALL SELECT 'title+type+brand', count(*) FROM part GROUP BY p_name, p_type, p_brand) x WHERE n > 1 GROUP BY key")
def dup_groups(t):
    return A.duplicate_groups(t.part, {"title": ["p_name"], "title+type": ["p_name", "p_type"], "title+type+brand": ["p_name", "p_type", "p_brand"]})


@query("concentration", "SELECT count(*) FILTER (a >= 1) AS keys_1, round(sum(m) FILTER (a >= 1) / sum(a) FILTER (a >= 1), 6) AS share_1, count(*) FILTER (a >= 2) AS keys_2, round(sum(m) FILTER (a >= 2) / sum(a) FILTER (a >= 2), 6) AS share_2, count(*) FILTER (a >= 5) AS keys_5, round(sum(m) FILTER (a >= 5) / sum(a) FILTER (a >= 5), 6) AS share_5 FROM (SELECT p_name, max(n) AS m, sum(n) AS a FROM (SELECT p_name, p_brand, count(*) AS n FROM part GROUP BY 1, 2) y GROUP BY 1) x")
def concentration(t):
    out = A.concentration(t.part, "p_name", "p_brand")
    return out.select(*(F.round(c, 6).alias(c) if c.startswith("share") else F.col(c) for c in out.columns))


@query("coverage_topn", "SELECT round(sum(n) FILTER (r <= 10) / sum(n), 6) AS top_10, round(sum(n) FILTER (r <= 100) / sum(n), 6) AS top_100, round(sum(n) FILTER (r <= 1000) / sum(n), 6) AS top_1000 FROM (SELECT n, row_number() OVER (ORDER BY n DESC, item_id) AS r FROM (SELECT l_partkey AS item_id, count(*) AS n FROM lineitem GROUP BY 1) y) x")
def coverage_topn(t):
    out = A.coverage(t.lineitem.select(F.col("l_partkey").alias("item_id")))
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query("value_table", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 10")
def value_table(t):
    return A.value_table(t.part, "p_brand", 10)


@query("distinct_per_key", roles.sql("SELECT search_query, count(DISTINCT query_key) AS n FROM log GROUP BY 1", "LOG"))
def distinct_per_key(t):
    return A.distinct_per(roles.of(t, "LOG"), "search_query", "query_key")


@query("class_weights", "SELECT p_name AS doc, p_brand AS class, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY p_name) AS DOUBLE), 6) AS w FROM part GROUP BY 1, 2")
def class_weights(t):
    return A.class_weights(t.part.select(F.col("p_name").alias("doc"), F.col("p_brand").alias("class"))).withColumn("w", F.round("w", 6))


@query("label_sets", roles.sql("SELECT query_id, list(item_id ORDER BY item_id) AS item_ids FROM labels_ GROUP BY 1", "LABELS").replace("labels AS", "labels_ AS"))
def label_sets(t):
    return A.label_sets(roles.of(t, "LABELS"))


@query("query_profile", "SELECT count(*) AS n, round(avg(CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END), 6) AS even, round(avg(len(string_split(p_name, ' '))), 6) AS words FROM part")
def query_profile(t):
    out = A.profile(t.part.select((F.col("p_size") % 2 == 0).alias("even"), F.col("p_name").alias("search_query")), ["even"])
    return out.select("n", F.round("even", 6).alias("even"), F.round("words", 6).alias("words"))


@query("query_stats", "SELECT count(*) AS rows, count(DISTINCT p_name) AS texts, round(avg(length(p_name) - length(replace(p_name, ' ', '')) + 1), 6) AS words, round(avg(length(p_name)), 6) AS chars, 1.0::DOUBLE AS latin, 0.0::DOUBLE AS digits FROM part")
def query_stats(t):
    out = A.query_stats(t.part, "p_name")
    return out.select("rows", "texts", *(F.round(c, 6).alias(c) for c in ("words", "chars", "latin", "digits")))


@query("win_rate", "SELECT count(*) AS queries, round(avg(w), 6) AS win_rate FROM (SELECT l_suppkey, avg(CASE WHEN l_discount > l_tax THEN 1 WHEN l_discount = l_tax THEN 0.5 ELSE 0 END) AS w FROM lineitem GROUP BY 1) x")
def win_rate(t):
    return A.win_rate(t.lineitem, "l_discount", "l_tax", "l_suppkey").select("queries", F.round("win_rate", 6).alias("win_rate"))


_LADDER = """, h AS (SELECT *, CAST('0x' || md5('42|' || query_key)[1:6] AS BIGINT) % 10 = 0 AS out_ FROM log), fit AS (SELECT * FROM h WHERE NOT out_),
e AS (SELECT item_id FROM fit GROUP BY 1 ORDER BY count(*) DESC, item_id LIMIT 50),
l AS (SELECT * FROM (SELECT search_location_id, item_id, row_number() OVER (PARTITION BY search_location_id ORDER BY count(*) DESC, item_id) AS r FROM fit GROUP BY 1, 2) x WHERE r <= 50),
s AS (SELECT * FROM (SELECT search_query, item_id, row_number() OVER (PARTITION BY search_query ORDER BY count(*) DESC, item_id) AS r FROM fit GROUP BY 1, 2) x WHERE r <= 50)
SELECT count(*) AS queries, round(avg(a), 6) AS recall_all, round(avg(b), 6) AS recall_location, round(avg(c), 6) AS recall_text FROM (SELECT query_key, avg(CASE WHEN e.item_id IS NULL THEN 0 ELSE 1 END) AS a, avg(CASE WHEN l.r IS NULL THEN 0 ELSE 1 END) AS b, avg(CASE WHEN s.r IS NULL THEN 0 ELSE 1 END) AS c
FROM (SELECT DISTINCT query_key, search_location_id, search_query, item_id FROM h WHERE out_) t LEFT JOIN e ON e.item_id = t.item_id LEFT JOIN l ON l.search_location_id = t.search_location_id AND l.item_id = t.item_id LEFT JOIN s ON s.search_query = t.search_query AND s.item_id = t.item_id GROUP BY 1) x"""


@query("baseline_ladder", roles.sql(_LADDER, "LOG").replace(") , h AS", "), h AS"))
def baseline_ladder(t):
    out = A.baseline_ladder(roles.of(t, "LOG"), "query_key", "search_location_id", "search_query")
    return out.select("queries", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


@query("history_in_corpus", "SELECT c_custkey AS query_id, n IS NOT NULL AS seen, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT p_name, count(*) AS n FROM part GROUP BY 1) x ON CASE WHEN c_custkey % 2 = 0 THEN 'red widget' ELSE 'none' END = p_name")
def history_in_corpus(t):
    q = t.customer.select(F.col("c_custkey").alias("query_id"), F.expr("CASE WHEN c_custkey % 2 = 0 THEN 'red widget' ELSE 'none' END").alias("search_query"))
    return A.history_in_corpus(q, t.part.select(F.col("p_name").alias("search_query")))


_TWINS = "SELECT DISTINCT l.query_id, l.item_id FROM labels_ l JOIN items i ON i.item_id = l.item_id WHERE NOT EXISTS (SELECT 1 FROM list_a a WHERE a.rank <= 50 AND a.query_id = l.query_id AND a.item_id = l.item_id) AND EXISTS (SELECT 1 FROM list_a a JOIN items j ON j.item_id = a.item_id WHERE a.rank <= 50 AND a.query_id = l.query_id AND lower(j.title) = lower(i.title) AND j.item_location_id = i.item_location_id)"


@query("twins", roles.sql(_TWINS, "LIST_A", "ITEMS", "LABELS").replace("labels AS", "labels_ AS"))
def twins(t):
    from ..functions.text import title_key

    return E.twins(roles.of(t, "LIST_A"), roles.of(t, "ITEMS").withColumn("title_key", title_key("title")), roles.of(t, "LABELS"))


@query("rank_neighbours", roles.sql("SELECT a.query_id, g.item_id AS target, a.item_id, a.rank FROM list_a a JOIN (SELECT * FROM list_a WHERE item_id % 50 = 0) g ON g.query_id = a.query_id AND abs(a.rank - g.rank) <= 10", "LIST_A"))
def rank_neighbours(t):
    a = roles.of(t, "LIST_A")
    return E.rank_neighbours(a, a.where("item_id % 50 = 0").select("query_id", "item_id"))


@query("source_candidates", roles.sql("SELECT a.query_id, a.item_id, i.item_location_id, i.item_location_id = CAST(a.query_id % 20 AS INT) AS city FROM list_a a JOIN items i USING (item_id)", "LIST_A", "ITEMS"))
def source_candidates(t):
    a = roles.of(t, "LIST_A")
    q = a.select("query_id", (F.col("query_id") % 20).cast("int").alias("search_location_id")).distinct()
    return io.source_candidates(a, q, roles.of(t, "ITEMS")).select("query_id", "item_id", "item_location_id", "city")


@query("distinct_items", "SELECT item_id, max(p_name) AS title FROM (SELECT p_partkey AS item_id, p_name FROM part UNION ALL SELECT p_partkey, p_name FROM part) x GROUP BY 1")
def distinct_items(t):
    p = t.part.select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"))
    return io.distinct_items(p, p)


@query("sample_by_key", "SELECT o_orderkey FROM orders WHERE CAST('0x' || md5('42|' || o_orderkey)[1:6] AS BIGINT) % 1000 < 100")
def sample_by_key(t):
    return io.sample_by_key(t.orders, "o_orderkey", 100).select("o_orderkey")


@query("random_subset", "SELECT c_custkey FROM customer ORDER BY md5('42|' || c_custkey), c_custkey LIMIT 100")
def random_subset(t):
    return K.random_subset(t.customer, "c_custkey", 100).select("c_custkey")


@query("radius_neighbours", roles.sql("SELECT loc, near, round(km, 4) AS km FROM (SELECT a.item_location_id AS loc, b.item_location_id AS near, 2 * 6371 * asin(sqrt(least(1.0::DOUBLE, pow(sin((radians(b.clat) - radians(a.clat)) / 2), 2) + cos(radians(a.clat)) * cos(radians(b.clat)) * pow(sin((radians(b.clon) - radians(a.clon)) / 2), 2)))) AS km FROM cent a JOIN cent b ON a.item_location_id <> b.item_location_id) x WHERE km <= 1500", "ITEMS", "CENT"))
def radius_neighbours(t):
    return G.neighbours(G.centroids(roles.of(t, "ITEMS")), 1500).withColumn("km", F.round("km", 4))


@query("filter_loss", roles.sql("SELECT round(avg(CASE WHEN search_location_id = item_location_id THEN 0 ELSE 1 END), 6) AS exact, round(avg(CASE WHEN search_location_id = item_location_id OR km <= 1000 THEN 0 ELSE 1 END), 6) AS radius FROM (SELECT search_location_id, item_location_id, abs(search_location_id - item_location_id) * 300.0 AS km FROM log WHERE search_location_id < 1000) x", "LOG"))
def filter_loss(t):
    log, items, regions = _maps(t)
    rows = log.where("search_location_id < 1000").withColumn("km", F.abs(F.col("search_location_id") - F.col("item_location_id")) * 300.0)
    out = G.filter_loss(rows, G.city_pairs(log, regions, items, 0.01), 1000)
    return out.select(F.round("exact", 6).alias("exact"), F.round("radius", 6).alias("radius"))


def _pool(t, rule, named=False):
    log, items, regions = _maps(t)
    searches = roles.of(t, "SEARCHES").select("search_location_id").distinct()
    if named:
        searches = searches.withColumn("named", F.when(F.col("search_location_id") % 2 == 0, (F.col("search_location_id") % 20).cast("int")))
    out = G.pool(rule, searches, regions, G.region_map(log, regions, items), G.city_pairs(log, regions, items), G.centroids(items), items)
    return out.select("search_location_id", "item_location_id", "tier")


_SEARCH = "(SELECT DISTINCT search_location_id AS s FROM searches) q"
_OWN = f"SELECT s, s AS i, {{0}} AS tier FROM {_SEARCH} WHERE s NOT IN (SELECT * FROM regions)"
_REG = "SELECT search_location_id AS s, item_location_id AS i, {0} AS tier FROM shares WHERE search_location_id IN (SELECT * FROM regions) AND {1}"
_PAIR = "SELECT search_location_id AS s, item_location_id AS i, {0} AS tier FROM shares WHERE search_location_id NOT IN (SELECT * FROM regions) AND search_location_id <> item_location_id AND {1}"
_KM = "2 * 6371 * asin(sqrt(least(1.0::DOUBLE, pow(sin((radians(b.clat) - radians(a.clat)) / 2), 2) + cos(radians(a.clat)) * cos(radians(b.clat)) * pow(sin((radians(b.clon) - radians(a.clon)) / 2), 2))))"
_NEAR = f"SELECT a.item_location_id AS s, b.item_location_id AS i, {{0}} AS tier FROM cent a JOIN cent b ON a.item_location_id <> b.item_location_id WHERE a.item_location_id NOT IN (SELECT * FROM regions) AND {_KM} <= {{1}}"
_NAMED = f"SELECT s, CAST(s % 20 AS INT) AS i, 0 AS tier FROM {_SEARCH} WHERE s IN (SELECT * FROM regions) AND s % 2 = 0"
_BY_SHARE = [_REG.format("{0}", "share >= 0.1"), _REG.format("{1}", "share >= 0.01 AND share < 0.1"), _REG.format("{2}", "share < 0.01")]


def _tiers(*parts: str) -> str:
    body = " UNION ALL ".join(parts)
    return f"SELECT CAST(s AS INT) AS search_location_id, CAST(i AS INT) AS item_location_id, CAST(min(tier) AS INT) AS tier FROM ({body}) x WHERE i IN (SELECT item_location_id FROM items) AND s IN (SELECT search_location_id FROM searches) GROUP BY s, i"


_RANKED = "SELECT search_location_id AS s, item_location_id AS i, CASE WHEN row_number() OVER (PARTITION BY search_location_id ORDER BY share DESC, item_location_id) = 1 THEN 0 ELSE 1 END AS tier FROM shares WHERE search_location_id IN (SELECT * FROM regions) AND item_location_id IN (SELECT item_location_id FROM items)"
_OWN0 = _OWN.format(0)
_RULES = {
    "C0R0": [_OWN0],
    "R1": [_OWN0, _REG.format(0, "true")],
    "R2_0.003": [_OWN0, _REG.format(0, "share >= 0.003")],
    "R2_0.01": [_OWN0, _REG.format(0, "share >= 0.01")],
    "R2_0.02": [_OWN0, _REG.format(0, "share >= 0.02")],
    "R2_0.05": [_OWN0, _REG.format(0, "share >= 0.05")],
    "R2t_0.01": [_OWN0, _REG.format(0, "share >= 0.01"), _REG.format(1, "true")],
    "R32_0.01": [_OWN0, _NAMED, _REG.format(1, "share >= 0.01")],
    "R3": [_OWN0, _NAMED, _REG.format(1, "true")],
    "R4a": [_OWN0, _RANKED],
    "R4b": [_OWN0, *(x.format(0, 1, 2) for x in _BY_SHARE)],
    "R3_4b": [_OWN0, _NAMED, *(x.format(1, 2, 3) for x in _BY_SHARE)],
    "R5": [_OWN0, _NAMED],
    "C1_30": [_OWN0, _NEAR.format(1, 30)],
    "C1_100": [_OWN0, _NEAR.format(1, 100)],
    "C2": [_OWN0, _PAIR.format(1, "true")],
    "C2s": [_OWN0, _PAIR.format(1, "share >= 0.01")],
    "C3": [_OWN0, _NEAR.format(1, 100), _PAIR.format(1, "true")],
    "C3s": [_OWN0, _NEAR.format(1, 100), _PAIR.format(1, "share >= 0.01")],
    "C4": [_OWN0, _NEAR.format(0, 100), _PAIR.format(0, "share >= 0.01")],
    "C4all": [_OWN0, _NEAR.format(0, 100), _PAIR.format(0, "true")],
}
for _rule in G.RULES:
    _parts = _RULES[G.base_rule(_rule)]
    query(
        "geo_pool_" + _rule.replace(".", "_"),
        roles.sql(_tiers(*_parts), "LOG", "ITEMS", "SEARCHES", "REGIONS", "SHARES", "CENT"),
    )(lambda t, rule=_rule: _pool(t, rule, rule in ("R3", "R32_0.01", "R3_4b", "R5")))


@query("soft_bonus", roles.sql("SELECT DISTINCT search_location_id, search_location_id AS item_location_id, 0.015::DOUBLE AS bonus FROM searches WHERE search_location_id NOT IN (SELECT * FROM regions) UNION ALL SELECT search_location_id, item_location_id, 0.02::DOUBLE FROM shares WHERE share >= 0.01 AND search_location_id IN (SELECT * FROM regions) AND search_location_id IN (SELECT search_location_id FROM searches) AND item_location_id IN (SELECT item_location_id FROM items)", "LOG", "ITEMS", "SEARCHES", "REGIONS", "SHARES"))
def soft_bonus(t):
    log, items, regions = _maps(t)
    s, m = roles.of(t, "SEARCHES"), G.region_map(log, regions, items)
    return G.soft_bonus("SOFT_0.015", s, regions, m).unionByName(G.soft_bonus("RSOFT_0.02", s, regions, m))


@query("geo_rule_class", roles.sql("SELECT query_id, CASE WHEN search_location_id = 1001 THEN 'RSOFT_0.005' WHEN search_location_id IN (SELECT * FROM regions) THEN 'RSOFT_0.02' ELSE 'SOFT_0.015' END AS rule FROM searches", "LOG", "ITEMS", "SEARCHES", "REGIONS"))
def geo_rule_class(t):
    _, _, regions = _maps(t)
    s = roles.of(t, "SEARCHES").join(regions.withColumn("r", F.lit(True)), "search_location_id", "left")
    return s.select("query_id", G.classify(F.col("search_location_id"), F.coalesce("r", F.lit(False)), country=1001).alias("rule"))


@query("pool_report", roles.sql("SELECT s.query_id, count(i.item_id) AS pool_size FROM searches s LEFT JOIN items i ON i.item_location_id = s.search_location_id GROUP BY 1", "ITEMS", "SEARCHES"))
def pool_report(t):
    items, s = roles.of(t, "ITEMS"), roles.of(t, "SEARCHES")
    own = s.select("search_location_id", F.col("search_location_id").alias("item_location_id"), F.lit(0).alias("tier")).distinct()
    return G.pool_report(s, own, items, roles.of(t, "LABELS")).select("query_id", "pool_size")


_KM = "abs(search_location_id - item_location_id) * 300.0 AS km"
_HALVES = f""", h AS (SELECT *, CAST('0x' || md5('5|' || query_key)[1:6] AS BIGINT) % 2 AS half, {_KM} FROM log WHERE search_location_id < 1000),
s AS (SELECT half, search_location_id, item_location_id, count(*) / CAST(sum(count(*)) OVER (PARTITION BY half, search_location_id) AS DOUBLE) AS share FROM h GROUP BY 1, 2, 3),
p AS (SELECT * FROM s WHERE share >= 0.01 AND search_location_id <> item_location_id AND item_location_id IN (SELECT item_location_id FROM items) AND search_location_id IN (SELECT item_location_id FROM items))
SELECT CAST(h.half AS INT) AS half, count(*) AS n, round(avg(CASE WHEN h.search_location_id = h.item_location_id THEN 0 ELSE 1 END), 6) AS exact, round(avg(CASE WHEN h.search_location_id = h.item_location_id OR km <= 1000 THEN 0 ELSE 1 END), 6) AS radius,
round(avg(CASE WHEN h.search_location_id = h.item_location_id OR p.share IS NOT NULL THEN 0 ELSE 1 END), 6) AS pair_map, round(avg(CASE WHEN h.search_location_id = h.item_location_id OR km <= 1000 OR p.share IS NOT NULL THEN 0 ELSE 1 END), 6) AS "all"
FROM h LEFT JOIN p ON p.half <> h.half AND p.search_location_id = h.search_location_id AND p.item_location_id = h.item_location_id GROUP BY 1"""


@query("filter_loss_split", roles.sql(_HALVES, "LOG", "ITEMS").replace(") , h AS", "), h AS"))
def filter_loss_split(t):
    log, items, regions = _maps(t)
    rows = log.where("search_location_id < 1000").withColumn("km", F.abs(F.col("search_location_id") - F.col("item_location_id")) * 300.0)
    out = G.filter_loss_split(rows, regions, items, km=1000)
    return out.select("half", "n", *(F.round(c, 6).alias(c) for c in ("exact", "radius", "pair_map", "all")))


@query("source_recall", roles.sql("SELECT source, count(*) AS answers, CAST(sum(p) AS BIGINT) AS answers_in_pool, round(avg(hit), 6) AS recall, round(avg(CASE WHEN p = 1 THEN hit END), 6) AS recall_in_pool FROM (SELECT s.source, CASE WHEN l.item_id % 20 = l.query_id % 20 THEN 1 ELSE 0 END AS p, CASE WHEN r.item_id IS NULL THEN 0 ELSE 1 END AS hit FROM labels_ l CROSS JOIN (VALUES ('a'), ('b')) s(source) LEFT JOIN (SELECT 'a' AS source, * FROM list_a UNION ALL SELECT 'b', * FROM list_b) r ON r.source = s.source AND r.query_id = l.query_id AND r.item_id = l.item_id AND r.rank <= 100) x GROUP BY 1", "LIST_A", "LIST_B", "LABELS").replace("labels AS", "labels_ AS"))
def source_recall(t):
    a, b, labels = (roles.of(t, n) for n in ("LIST_A", "LIST_B", "LABELS"))
    pool = labels.where("item_id % 20 = query_id % 20")
    out = G.source_recall(pool, labels, {"a": a, "b": b}, 100)
    return out.select("source", "answers", "answers_in_pool", F.round("recall", 6).alias("recall"), F.round("recall_in_pool", 6).alias("recall_in_pool"))


_CITY = "SELECT c_custkey AS query_id, CASE c_custkey % 6 WHEN 0 THEN 'ремонт в казани' WHEN 1 THEN 'уборка нижний новгород' WHEN 2 THEN 'няня спб' WHEN 3 THEN 'перевозка самара казань' WHEN 4 THEN 'ключи' ELSE 'мастер Казань' END AS search_query FROM customer"


@query("city_in_text", "SELECT c_custkey AS query_id, CASE c_custkey % 6 WHEN 1 THEN 'нижний новгород' WHEN 2 THEN 'санкт-петербург' WHEN 3 THEN 'самара' ELSE 'казань' END AS name FROM customer WHERE c_custkey % 6 <> 4")
def city_in_text(t):
    names = t.spark.createDataFrame([("казань",), ("самара",), ("нижний новгород",), ("санкт-петербург",)], "name string")
    queries = t.customer.select(F.col("c_custkey").alias("query_id"), F.expr(_CITY.partition(", ")[2].partition(" AS search_query")[0]).alias("search_query"))
    return G.named_city(queries, G.city_forms(names))


@query("city_names", "WITH i AS (SELECT p_partkey % 20 AS loc, CASE WHEN p_size % 10 = 0 THEN (p_partkey + p_size) % 20 ELSE p_partkey % 20 END AS said FROM part), c AS (SELECT loc, lower(translate(n_name, '0123456789', 'abcdefghij')) AS name, count(*) AS k FROM i JOIN nation ON n_nationkey = said WHERE length(n_name) BETWEEN 4 AND 30 GROUP BY 1, 2), b AS (SELECT *, sum(k) OVER (PARTITION BY loc) AS total, row_number() OVER (PARTITION BY loc ORDER BY k DESC, name) AS r FROM c), s AS (SELECT loc, count(*) AS n FROM i GROUP BY 1) SELECT name, CAST(item_location_id AS INT) AS item_location_id FROM (SELECT name, b.loc AS item_location_id, row_number() OVER (PARTITION BY name ORDER BY n DESC, b.loc) AS o FROM b JOIN s ON s.loc = b.loc WHERE r = 1 AND k >= 5 AND k >= 0.2 * total) x WHERE o = 1")
def city_names(t):
    """Addresses of parts name the nation of their place, or sometimes another's."""
    said = F.when(F.col("p_size") % 10 == 0, (F.col("p_partkey") + F.col("p_size")) % 20).otherwise(F.col("p_partkey") % 20)
    items = t.part.select(F.col("p_partkey").alias("item_id"), (F.col("p_partkey") % 20).cast("int").alias("item_location_id"), said.alias("n_nationkey")).join(t.nation.select("n_nationkey", "n_name"), "n_nationkey")
    items = items.withColumn("params", F.concat(F.lit("Место оказания услуг Новая область, "), F.translate("n_name", "0123456789", "abcdefghij"), F.lit(", ул. Баумана 5 Тип x")))
    return G.city_names(items, items.groupBy("item_location_id").agg(F.count("*").alias("n_items")), big=())


@query("unreliable_names", "SELECT lower(n_name) AS name FROM (SELECT c_custkey % 20 AS k, count(*) AS n, avg(CASE WHEN CASE WHEN c_custkey % 20 < 15 AND c_custkey % 3 > 0 THEN c_custkey % 20 ELSE c_nationkey % 20 END = c_custkey % 20 THEN 1 ELSE 0 END) AS share FROM customer GROUP BY 1) x JOIN nation ON n_nationkey = k WHERE n >= 5 AND share < 0.2")
def unreliable_names(t):
    """Customers name a place and choose there, or, those who name a place from 15 on, mostly elsewhere."""
    at = F.when((F.col("c_custkey") % 20 < 15) & (F.col("c_custkey") % 3 > 0), F.col("c_custkey") % 20).otherwise(F.col("c_nationkey") % 20)
    log = t.customer.select(F.col("c_custkey").alias("query_id"), (at * 2.5 - 20).alias("lat"), (at * 7.25 - 60).alias("lon"))
    names = t.nation.where("n_nationkey < 20").select(F.lower("n_name").alias("name"), F.col("n_nationkey").alias("item_location_id"))
    named = t.customer.select(F.col("c_custkey").alias("query_id"), (F.col("c_custkey") % 20).cast("int").alias("item_location_id")).join(names, "item_location_id").select("query_id", "name")
    cent = t.nation.select(F.col("n_nationkey").alias("item_location_id"), (F.col("n_nationkey") * 2.5 - 20).alias("clat"), (F.col("n_nationkey") * 7.25 - 60).alias("clon"))
    return G.unreliable_names(named, log, names, cent)


@query("training_pairs")
def training_pairs(t):
    log = roles.of(t, "LOG").select(F.col("search_query").alias("q"), F.col("search_query").alias("tn"), "item_id")
    items = t.part.select(F.col("p_partkey").alias("item_id"), F.concat_ws(" ", "p_name", "p_brand").alias("text"))
    return ml.no_duplicate_batches(ml.training_pairs(log, items, 20), 64)


@query("event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def event_windows(t):
    return incremental.event_windows(t.events).withColumn("value", F.round("value", 4))


@query("first_per_text", roles.sql("SELECT search_query, row_id FROM (SELECT search_query, row_id, row_number() OVER (PARTITION BY search_query ORDER BY row_id) AS r FROM log) x WHERE r = 1", "LOG"))
def first_per_text(t):
    return W.first_per(roles.of(t, "LOG"), ["search_query"], ["row_id"]).select("search_query", "row_id")
