"""How the roles of the retrieval domain are played by the given tables, as DataFrames and as SQL for both engines.

The log: order lines are choices (search location: customer's nation; item: part; item location: supplier's nation;
query text: name and type of the part; class: brand). Nations below 20 are cities; the regions' ids are 1000 + region
key, and a search from segment BUILDING counts as one in its region. Coordinates are arithmetic on the nation key.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .registry import Tables

LOG = """
SELECT l.l_orderkey * 10 + l.l_linenumber AS row_id, o.o_orderkey AS order_id,
  CASE WHEN c.c_mktsegment = 'BUILDING' THEN 1000 + n.n_regionkey ELSE c.c_nationkey END AS search_location_id,
  lower(p.p_name) AS search_query, p.p_type AS filters, l.l_partkey AS item_id, s.s_nationkey AS item_location_id,
  p.p_brand AS class, p.p_retailprice AS price, l.l_quantity AS quantity,
  lower(p.p_name) || '|' || CAST(CASE WHEN c.c_mktsegment = 'BUILDING' THEN 1000 + n.n_regionkey ELSE c.c_nationkey END AS VARCHAR(20)) || '|' || p.p_type AS query_key
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN part p ON l.l_partkey = p.p_partkey
"""
ITEMS = """
SELECT p.p_partkey AS item_id, p.p_name AS title, p.p_type || ' ' || p.p_brand AS params, p.p_name || ' ' || p.p_type AS description,
  CAST(p.p_partkey % 20 AS INT) AS item_location_id, CAST(p.p_partkey % 20 * 2.5 - 20.0 AS DOUBLE) AS lat, CAST(p.p_partkey % 20 * 7.25 - 60.0 AS DOUBLE) AS lon,
  p.p_brand AS class, CASE WHEN p.p_size % 7 = 0 THEN NULL ELSE CAST(p.p_size % 6 AS DOUBLE) END AS rating, CAST(p.p_size * 3 AS DOUBLE) AS reviews,
  CASE WHEN p.p_size % 11 = 0 THEN NULL WHEN p.p_size % 13 = 0 THEN CAST(1 AS DOUBLE) ELSE p.p_retailprice END AS price,
  p.p_size % 2 = 0 AS phone_hidden, p.p_size % 5 = 0 AS msg_forbidden
FROM part p
"""
#: Candidate lists: per supplier as query, its parts by quantity sold (a), by revenue (b) and by discount (c).
CANDS = """
SELECT query_id, item_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INT) AS rank FROM (
  SELECT l_suppkey AS query_id, l_partkey AS item_id, round(sum({0}), 6) AS score FROM lineitem WHERE {1} GROUP BY l_suppkey, l_partkey) x
"""
LIST_A, LIST_B = CANDS.format("l_quantity", "l_linenumber <= 5"), CANDS.format("l_extendedprice / 1000", "l_linenumber >= 3")
LIST_C = CANDS.format("l_discount * l_quantity", "l_returnflag <> 'N'")
#: What was right for a query: parts returned in large quantities.
LABELS = "SELECT DISTINCT l_suppkey AS query_id, l_partkey AS item_id FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40"
SEARCHES = """
SELECT c.c_custkey AS query_id, CASE WHEN c.c_mktsegment = 'BUILDING' THEN 1000 + n.n_regionkey ELSE c.c_nationkey END AS search_location_id
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
"""
REGIONS = "SELECT DISTINCT search_location_id FROM log WHERE search_location_id NOT IN (SELECT item_location_id FROM items)"
SHARES = """
SELECT search_location_id, item_location_id, n, n / CAST(sum(n) OVER (PARTITION BY search_location_id) AS DOUBLE) AS share FROM (
  SELECT search_location_id, item_location_id, count(*) AS n FROM log GROUP BY search_location_id, item_location_id) x
"""
CENT = "SELECT item_location_id, median(lat) AS clat, median(lon) AS clon, count(*) AS n_items FROM items GROUP BY item_location_id"


def sql(body: str, *names: str) -> str:
    """``body`` with the named roles as common tables, in the order given."""
    return "WITH " + ", ".join(f"{n.lower()} AS ({globals()[n]})" for n in names) + " " + body


_TABLE = re.compile(r"\b(FROM|JOIN) (lineitem|orders|customer|nation|region|supplier|part)\b")


def of(t: Tables, name: str) -> DataFrame:
    """A role as a DataFrame."""
    body = globals()[name]
    views = {m[2]: getattr(t, m[2]) for m in _TABLE.finditer(body)}
    return t.spark.sql(_TABLE.sub(r"\1 {\2}", body), **views)
