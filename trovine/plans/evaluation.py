"""Queries on recall, splits, folds, leaks and the answer check."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import evaluate as E
from ..operators import validate as V
from ..sources import io
from . import roles
from .registry import query

_L = "labels AS"


def _sql(body: str, *names: str) -> str:
    return roles.sql(body, *names).replace(_L, "labels_ AS")


_R50 = "SELECT l.query_id, avg(CASE WHEN a.rank <= 50 THEN 1 ELSE 0 END) AS recall FROM labels_ l LEFT JOIN list_a a ON a.query_id = l.query_id AND a.item_id = l.item_id GROUP BY 1"


def _ab(t):
    return roles.of(t, "LIST_A"), roles.of(t, "LIST_B"), roles.of(t, "LABELS")


@query("recall_at_k", _sql(f"SELECT query_id, round(recall, 6) AS recall FROM ({_R50}) x", "LIST_A", "LABELS"))
def recall_at_k(t):
    a, _, labels = _ab(t)
    return E.recall_at_k(a.where("rank <= 50"), labels, 50).withColumn("recall", F.round("recall", 6))


@query("recall_curve", _sql("SELECT count(*) AS queries, round(avg(r10), 6) AS r10, round(avg(r50), 6) AS r50, round(avg(r100), 6) AS r100, round(avg(r300), 6) AS r300 FROM (SELECT l.query_id, avg(CASE WHEN rank <= 10 THEN 1 ELSE 0 END) AS r10, avg(CASE WHEN rank <= 50 THEN 1 ELSE 0 END) AS r50, avg(CASE WHEN rank <= 100 THEN 1 ELSE 0 END) AS r100, avg(CASE WHEN rank <= 300 THEN 1 ELSE 0 END) AS r300 FROM labels_ l LEFT JOIN list_a a ON a.query_id = l.query_id AND a.item_id = l.item_id GROUP BY 1) x", "LIST_A", "LABELS"))
def recall_curve(t):
    a, _, labels = _ab(t)
    out = E.recall_curve(a, labels)
    return out.select("queries", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


_LAST = "SELECT a.*, score - (rank - rank % 4) * 0.000000000001::DOUBLE AS s, min(CASE WHEN rank <= 50 THEN score - (rank - rank % 4) * 0.000000000001::DOUBLE END) OVER (PARTITION BY query_id) AS last FROM list_a a"


@query("threshold_recall", _sql(f"SELECT l.query_id, round(avg(CASE WHEN x.s >= x.last THEN 1 ELSE 0 END), 6) AS recall FROM labels_ l LEFT JOIN ({_LAST}) x ON x.query_id = l.query_id AND x.item_id = l.item_id GROUP BY 1", "LIST_A", "LABELS"))
def threshold_recall(t):
    """Old ranks tie by fours, so that more than 50 items may reach the 50th best score."""
    a, _, labels = _ab(t)
    a = a.withColumn("rank", F.col("rank") - F.col("rank") % 4)
    return E.threshold_recall(a, labels, 50).withColumn("recall", F.round("recall", 6))


@query("oracle_ceiling", _sql("SELECT l.query_id, round(avg(CASE WHEN a.rank <= 50 OR b.rank <= 50 THEN 1 ELSE 0 END), 6) AS recall FROM labels_ l LEFT JOIN list_a a ON a.query_id = l.query_id AND a.item_id = l.item_id LEFT JOIN list_b b ON b.query_id = l.query_id AND b.item_id = l.item_id GROUP BY 1", "LIST_A", "LIST_B", "LABELS"))
def oracle_ceiling(t):
    a, b, labels = _ab(t)
    return E.oracle_ceiling([a, b], labels, 50).withColumn("recall", F.round("recall", 6))


@query("best_rank_buckets", _sql("SELECT CASE WHEN r IS NULL THEN 'absent' WHEN r <= 50 THEN '<=50' WHEN r <= 100 THEN '<=100' WHEN r <= 200 THEN '<=200' WHEN r <= 300 THEN '<=300' ELSE '>300' END AS bucket, count(*) AS n FROM (SELECT l.query_id, min(rank) AS r FROM labels_ l LEFT JOIN list_a a ON a.query_id = l.query_id AND a.item_id = l.item_id GROUP BY 1) x GROUP BY 1", "LIST_A", "LABELS"))
def best_rank_buckets(t):
    a, _, labels = _ab(t)
    return E.best_rank_buckets(a, labels)


_P = "0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975, 0.99999887, 0.99999989"
_BOOT = f"""WITH m AS (SELECT r, sum(m * w) / nullif(sum(w), 0) AS mean FROM (SELECT r, m, len(list_filter([{_P}], lambda c: u >= c::DOUBLE)) AS w FROM (
SELECT r, c_acctbal AS m, CAST('0x' || md5('0|' || r || '|' || c_custkey)[1:8] AS BIGINT) / 4294967296.0::DOUBLE AS u FROM customer, range(1, 101) t(r)) x) y GROUP BY r)
SELECT (SELECT count(*) FROM customer) AS queries, round((SELECT avg(c_acctbal) FROM customer), 4) AS mean, round(quantile_cont(mean, 0.025::DOUBLE), 4) AS low, round(quantile_cont(mean, 0.975::DOUBLE), 4) AS high FROM m"""


@query("bootstrap_ci", _BOOT)
def bootstrap_ci(t):
    out = E.bootstrap(t.customer.select(F.col("c_custkey").alias("query_id"), "c_acctbal"), "c_acctbal", rounds=100)
    return out.select("queries", *(F.round(c, 4).alias(c) for c in ("mean", "low", "high")))


@query("paired_difference", _sql(f"SELECT x.query_id, round(x.recall - y.recall, 6) AS diff FROM ({_R50}) x JOIN ({_R50.replace('list_a', 'list_b')}) y ON x.query_id = y.query_id", "LIST_A", "LIST_B", "LABELS"))
def paired_difference(t):
    a, b, labels = _ab(t)
    one, two = (E.recall_at_k(x.where("rank <= 50"), labels, 50) for x in (a, b))
    return E.paired(one, two).withColumn("diff", F.round("diff", 6))


_SPLIT = """SELECT query_key, text_norm, stratum FROM (SELECT o.*, row_number() OVER (PARTITION BY stratum ORDER BY md5('s' || h), query_key) AS p FROM (
SELECT c_custkey AS query_key, c_custkey // 3 AS text_norm, c_custkey % 2 AS stratum, md5('42|' || c_custkey) AS h, row_number() OVER (PARTITION BY c_custkey // 3 ORDER BY md5('42|' || c_custkey), c_custkey) AS r FROM customer) o WHERE r = 1) x
WHERE p <= CASE WHEN stratum = 1 THEN 65 ELSE 36 END"""


@query("split_stratified", _SPLIT)
def split_stratified(t):
    eligible = t.customer.select(F.col("c_custkey").alias("query_key"), F.floor(F.col("c_custkey") / 3).alias("text_norm"), (F.col("c_custkey") % 2).alias("stratum"))
    target = t.spark.createDataFrame([(0, 0.355), (1, 0.645)], "stratum long, share double")
    return E.stratified_split(eligible, target, 101, ["stratum"])


_FOLDS = """WITH x AS (SELECT DISTINCT p_name AS text_norm, length(p_name) % 4 AS other, md5('42|' || p_name) AS h FROM part), f AS (SELECT text_norm FROM x WHERE other > 0 ORDER BY other, h, text_norm LIMIT greatest(0, (SELECT CAST(floor(0.6 * count(*)) AS BIGINT) - count(*) FILTER (other = 0) FROM x)))
SELECT text_norm, CAST(CAST('0x' || h[1:8] AS BIGINT) % 5 AS INT) AS fold, CASE WHEN other = 0 THEN 'unseen_nat' WHEN text_norm IN (SELECT * FROM f) THEN 'unseen_forced' ELSE 'seen' END AS mode FROM x"""
_FOLDS = _FOLDS.replace("LIMIT greatest(0, (SELECT CAST(floor(0.6 * count(*)) AS BIGINT) - count(*) FILTER (other = 0) FROM x))", "LIMIT (SELECT greatest(0, CAST(floor(0.6 * count(*)) AS BIGINT) - count(*) FILTER (other = 0)) FROM x)")


def _folds(t):
    return E.text_folds(t.part.select(F.col("p_name").alias("text_norm"), (F.length("p_name") % 4).alias("other")))


@query("folds_by_text", _FOLDS)
def folds_by_text(t):
    return _folds(t)


@query("excluded_folds", f"WITH fo AS ({_FOLDS}) SELECT excl_fold, count(*) AS n FROM (SELECT coalesce(CASE WHEN p.p_size % 5 = 0 THEN p.p_size % 5 END, CASE WHEN fo.mode = 'unseen_forced' THEN fo.fold END, -1) AS excl_fold FROM part p LEFT JOIN fo ON fo.text_norm = p.p_name) x GROUP BY 1")
def excluded_folds(t):
    log = t.part.select(F.col("p_name").alias("text_norm"), F.col("p_partkey").alias("query_key"))
    own = t.part.where("p_size % 5 = 0").select(F.col("p_partkey").alias("query_key"), F.lit(0).alias("fold"))
    return E.excluded_folds(log, own, _folds(t)).groupBy("excl_fold").agg(F.count("*").alias("n"))


@query("train_without_held", "SELECT o_orderkey FROM orders WHERE o_custkey % 10 <> 3")
def train_without_held(t):
    held = t.customer.where("c_custkey % 10 = 3").select(F.col("c_custkey").alias("o_custkey"))
    return E.without_keys(t.orders, held, "o_custkey").select("o_orderkey")


@query("query_flags", roles.sql("SELECT query_id, query_id % 3 = 0 AS text_in_train, query_id % 2 = 0 AS has_filter, search_location_id IN (SELECT * FROM regions) AS is_region FROM searches", "LOG", "ITEMS", "SEARCHES", "REGIONS"))
def query_flags(t):
    from ..operators import geo as G

    q = roles.of(t, "SEARCHES").withColumn("text_norm", F.col("query_id").cast("string")).withColumn("filters", F.when(F.col("query_id") % 2 == 0, "x"))
    out = E.flags(q, q.where("query_id % 3 = 0"), G.regions(roles.of(t, "LOG"), roles.of(t, "ITEMS")))
    return out.select("query_id", "text_in_train", "has_filter", "is_region")


_DRAWN = "SELECT '{0}' AS scheme, count(*) AS drawn, round(avg(log10(n)), 6) AS log_freq FROM (SELECT DISTINCT search_query, {1} AS k FROM log ORDER BY md5('7|' || {1}), {1} LIMIT 200) x JOIN f USING (search_query)"
_SCHEMES = ", f AS (SELECT search_query, count(*) AS n FROM log GROUP BY 1) " + " UNION ALL ".join(_DRAWN.format(s, k) for s, k in (("text", "search_query"), ("query", "query_key"), ("row", "row_id")))


@query("sampling_schemes", roles.sql(_SCHEMES, "LOG").replace(") , f AS", "), f AS"))
def sampling_schemes(t):
    log = roles.of(t, "LOG").withColumn("text_norm", F.col("search_query"))
    return E.sampling_schemes(log, 200).withColumn("log_freq", F.round("log_freq", 6))


@query("leak_check", "SELECT s, n_pool, n_val, round(a, 6) AS x_pool, round(b, 6) AS x_val, round(a - b, 6) AS x_diff FROM (SELECT l_linenumber % 2 AS s, count(*) FILTER (l_suppkey % 2 = 0) AS n_pool, count(*) FILTER (l_suppkey % 2 = 1) AS n_val, avg(l_quantity) FILTER (l_suppkey % 2 = 0) AS a, avg(l_quantity) FILTER (l_suppkey % 2 = 1) AS b FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) x")
def leak_check(t):
    rows = t.lineitem.select((F.col("l_linenumber") % 2).alias("s"), F.col("l_quantity").alias("x"), (F.col("l_returnflag") == "R").cast("int").alias("y"), "l_suppkey")
    out = E.leak_check(rows.where("l_suppkey % 2 = 0"), rows.where("l_suppkey % 2 = 1"), ["x"], ["s"])
    return out.select("s", "n_pool", "n_val", *(F.round(c, 6).alias(c) for c in ("x_pool", "x_val", "x_diff")))


@query("error_taxonomy", _sql("SELECT cause, count(*) AS n FROM (SELECT CASE WHEN a.rank <= 50 THEN 'found' WHEN a.rank <= 300 THEN 'ranked low' WHEN b.rank IS NOT NULL THEN 'other source' ELSE 'not retrieved' END AS cause FROM labels_ l LEFT JOIN list_a a ON a.query_id = l.query_id AND a.item_id = l.item_id LEFT JOIN list_b b ON b.query_id = l.query_id AND b.item_id = l.item_id) x GROUP BY 1", "LIST_A", "LIST_B", "LABELS"))
def error_taxonomy(t):
    a, b, labels = _ab(t)
    key = ["query_id", "item_id"]
    rows = labels.join(a.select(*key, F.col("rank").alias("ra")), key, "left").join(b.select(*key, F.col("rank").alias("rb")), key, "left")
    causes = {"found": F.col("ra") <= 50, "ranked low": F.col("ra") <= 300, "other source": F.col("rb").isNotNull()}
    return rows.groupBy(E.first_matching(causes, "not retrieved").alias("cause")).agg(F.count("*").alias("n"))


_BAD = "WITH a AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'a  b' WHEN 1 THEN 'a a' WHEN 2 THEN 'a b c d' ELSE 'a b c' END AS answer FROM customer WHERE c_custkey % 7 > 0) "


@query(
    "answer_check",
    _BAD
    + "SELECT * FROM (SELECT 'FAIL' AS severity, 'spacing' AS rule, count(*) AS n, min(CAST(c_custkey AS VARCHAR)) AS example FROM a WHERE c_custkey % 5 = 0 UNION ALL SELECT 'FAIL', 'id repeats', count(*), min(CAST(c_custkey AS VARCHAR)) FROM a WHERE c_custkey % 5 = 1 UNION ALL SELECT 'FAIL', 'too many ids', count(*), min(CAST(c_custkey AS VARCHAR)) FROM a WHERE c_custkey % 5 = 2 UNION ALL SELECT 'WARN', 'too few ids', count(*), min(CAST(c_custkey AS VARCHAR)) FROM a WHERE c_custkey % 5 < 2 UNION ALL SELECT 'FAIL', 'query missing', count(*), min(CAST(c_custkey AS VARCHAR)) FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT 'WARN', 'id unknown', count(*), 'd' FROM a WHERE c_custkey % 5 = 2) x WHERE n > 0",
)
def answer_check(t):
    answer = t.customer.where("c_custkey % 7 > 0").select(F.col("c_custkey").cast("string").alias("query_id"), F.expr("CASE c_custkey % 5 WHEN 0 THEN 'a  b' WHEN 1 THEN 'a a' WHEN 2 THEN 'a b c d' ELSE 'a b c' END").alias("answer"))
    items = t.spark.createDataFrame([("a",), ("b",), ("c",)], "item_id string")
    return V.check_answer(answer, t.customer.select(F.col("c_custkey").alias("query_id")), items, limit=3, id_format="^[a-z]$")


@query("answer_csv", roles.sql("SELECT query_id, string_agg(CAST(item_id AS VARCHAR), ' ' ORDER BY rank) AS answer FROM list_a WHERE rank <= 50 GROUP BY 1", "LIST_A"))
def answer_csv(t):
    a = roles.of(t, "LIST_A")
    return io.answers(a, a, 50)


@query("error_slices", _sql(f"SELECT slice, count(*) AS n, round(avg(recall), 6) AS mean FROM (SELECT recall, 'all' AS slice FROM ({_R50}) x UNION ALL SELECT recall, 'even' FROM ({_R50}) y WHERE query_id % 2 = 0) z GROUP BY 1", "LIST_A", "LABELS"))
def error_slices(t):
    a, _, labels = _ab(t)
    per = E.recall_at_k(a.where("rank <= 50"), labels, 50)
    return A.slices(per, "recall", {"all": F.lit(True), "even": F.col("query_id") % 2 == 0}).withColumn("mean", F.round("mean", 6))
