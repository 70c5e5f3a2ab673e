"""Queries on text functions, filters and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import filters as P
from ..functions import numeric as M
from ..functions import stem as S
from ..functions import text as X
from ..operators import aggregates as A
from ..operators import sparse
from ..sources import io
from . import roles
from .registry import query

_NORM = r"trim(regexp_replace(replace(lower(coalesce({0}, '')), 'ё', 'е'), '\s+', ' ', 'g'))"
_TOKENS = r"regexp_extract_all(replace(lower(coalesce({0}, '')), 'ё', 'е'), '[\p{{L}}\p{{N}}_]+')"
_PREFIX = "list_transform(list_filter(regexp_extract_all(replace(lower(coalesce({0}, '')), 'ё', 'е'), '[а-яa-z0-9]+'), lambda x: length(x) > 1), lambda x: x[1:5])"


@query("normalize_text", f"SELECT doc_id, md5({_NORM.format('text')}) AS norm_md5, CAST(length({_NORM.format('text')}) AS BIGINT) AS norm_chars FROM documents")
def normalize_text(t):
    n = X.normalise("text")
    return t.documents.select("doc_id", F.md5(n).alias("norm_md5"), F.length(n).cast("long").alias("norm_chars"))


@query(
    "item_text_variants",
    r"""SELECT p_partkey AS item_id, p_name || '. ' || p_type || '. ' || substr(regexp_replace(p_brand || '  ' || p_name, '\s+', ' ', 'g'), 1, 500) AS a,
    p_name || '. ' || p_name || '. ' || p_type || '. ' || substr(regexp_replace(p_brand || '  ' || p_name, '\s+', ' ', 'g'), 1, 500) AS b, p_name || '. ' || p_type AS c FROM part""",
)
def item_text_variants(t):
    parts = F.col("p_name"), F.col("p_type"), F.concat("p_brand", F.lit("  "), "p_name")
    return t.part.select(F.col("p_partkey").alias("item_id"), *(X.item_text(*parts, variant=v).alias(v) for v in "abc"))


@query("query_text", "SELECT p_partkey AS item_id, CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_name || ' (' || p_type || ')' END AS model_text FROM part")
def query_text(t):
    filters = F.when(F.col("p_size") % 3 != 0, F.col("p_type"))
    return t.part.select(F.col("p_partkey").alias("item_id"), X.query_text(F.col("p_name"), filters).alias("model_text"))


@query("tokenize", f"SELECT doc_id, CAST(len({_TOKENS.format('text')}) AS BIGINT) AS n_tokens, md5(array_to_string({_TOKENS.format('text')}, ' ')) AS tokens_md5 FROM documents")
def tokenize(t):
    w = X.tokens("text")
    return t.documents.select("doc_id", F.size(w).cast("long").alias("n_tokens"), F.md5(F.array_join(w, " ")).alias("tokens_md5"))


@query(
    "word_stats",
    r"""SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS BIGINT) AS words, CAST(length(coalesce(text, '')) AS BIGINT) AS chars,
    regexp_matches(coalesce(text, ''), '[A-Za-z]') AS latin, regexp_matches(coalesce(text, ''), '[0-9]') AS digits FROM documents""",
)
def word_stats(t):
    return t.documents.select("doc_id", X.word_count("text").alias("words"), X.char_count("text").alias("chars"), X.has_latin("text").alias("latin"), X.has_digit("text").alias("digits"))


@query(
    "prefix5_overlap",
    f"""SELECT b.item_id AS query_id, d.doc_id, CAST(len(list_intersect(b.q, d.w)) AS BIGINT) AS shared FROM
    (SELECT item_id, list_distinct({_PREFIX.format('text')}) AS q FROM benchmark) b JOIN (SELECT doc_id, list_distinct({_PREFIX.format('text')}) AS w FROM documents WHERE doc_id % 25 = 0) d
    ON b.item_id = d.doc_id / 25 % 40""".replace("WHERE doc_id % 25 = 0", "").replace("d.doc_id / 25 % 40", "d.doc_id % 40"),
)
def prefix5_overlap(t):
    q = t.benchmark.select(F.col("item_id").alias("query_id"), F.array_distinct(X.prefix_tokens("text")).alias("q"))
    d = t.documents.select("doc_id", F.array_distinct(X.prefix_tokens("text")).alias("w"), (F.col("doc_id") % 40).alias("query_id"))
    return q.join(d, "query_id").select("query_id", "doc_id", F.size(F.array_intersect("q", "w")).cast("long").alias("shared"))


@query("phrase_match", "SELECT p_partkey AS item_id, contains(lower(p_name), lower(p_type)) AS in_title, contains(p_name || ' ' || p_type || ' ' || p_brand, p_type) AS in_body FROM part")
def phrase_match(t):
    body = F.concat_ws(" ", "p_name", "p_type", "p_brand")
    return t.part.select(F.col("p_partkey").alias("item_id"), X.contains_phrase(F.lower("p_name"), F.lower("p_type")).alias("in_title"), X.contains_phrase(body, F.col("p_type")).alias("in_body"))


@query("title_key", r"SELECT p_partkey AS item_id, trim(regexp_replace(lower(p_name || '!'), '[^\p{L}\p{N}_]+', ' ', 'g')) AS title_key FROM part")
def title_key(t):
    return t.part.select(F.col("p_partkey").alias("item_id"), X.title_key(F.concat("p_name", F.lit("!"))).alias("title_key"))


@query("query_key", "SELECT p_partkey AS query_id, lower(p_name) || '|' || CAST(p_size AS VARCHAR) || '|' || CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS query_key, p_size % 2 = 0 AS has_filter FROM part")
def query_key(t):
    filters = F.when(F.col("p_size") % 2 == 0, F.col("p_type"))
    return t.part.select(F.col("p_partkey").alias("query_id"), X.query_key(X.normalise("p_name"), F.col("p_size"), filters).alias("query_key"), X.has_filter(filters).alias("has_filter"))


@query(
    "char_ngrams",
    """SELECT gram, count(*) AS n FROM (SELECT unnest(flatten(list_transform(list_filter(string_split(p_name, ' '), lambda w: w <> ''), lambda w:
    flatten(list_transform([3, 4, 5], lambda n: list_transform(range(1, length(w) + 4 - n), lambda i: substr(' ' || w || ' ', i, n))))))) AS gram FROM part) x GROUP BY gram""",
)
def char_ngrams(t):
    return t.part.select(F.explode(X.char_ngrams("p_name")).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query("word_ngrams", "SELECT gram, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ') || [p_name]) AS gram FROM part) x GROUP BY gram")
def word_ngrams(t):
    return t.part.select(F.explode(X.word_ngrams("p_name", 2)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


#: Filter strings of parts: type and brand under two keys of the filter language, with some catch-all values.
_FILTERS = "CASE WHEN p_size % 4 = 0 THEN '' WHEN p_size % 4 = 1 THEN 'Вид услуги ' || p_type WHEN p_size % 4 = 2 THEN 'Вид услуги ' || p_type || ' Тип услуги ' || p_brand ELSE 'Вид услуги Другое Гарантия ' || p_brand END"


@query(
    "parse_filters",
    """SELECT p_partkey AS item_id, CAST(i AS INT) AS i, k AS key, v AS value FROM (
    SELECT p_partkey, 0 AS i, 'Вид услуги' AS k, CASE WHEN p_size % 4 = 3 THEN 'Другое' ELSE p_type END AS v FROM part WHERE p_size % 4 > 0
    UNION ALL SELECT p_partkey, 1, 'Тип услуги', p_brand FROM part WHERE p_size % 4 = 2 UNION ALL SELECT p_partkey, 1, 'Гарантия', p_brand FROM part WHERE p_size % 4 = 3) x""",
)
def parse_filters(t):
    return t.part.select(F.col("p_partkey").alias("item_id"), F.posexplode(P.parse_filters(F.expr(_FILTERS))).alias("i", "f")).select("item_id", "i", "f.key", "f.value")


#: Strings in which a key is a value, text stands before the first key, or no key is.
_MIXED = "CASE p_size % 5 WHEN 0 THEN concat('Тип услуги Аренда авто ', p_brand) WHEN 1 THEN concat(p_name, ' Гарантия ', p_brand) WHEN 2 THEN concat('Вид услуги ', p_type, ' Услуга ', p_brand) WHEN 3 THEN p_name END"


@query(
    "parse_filters_exact",
    """SELECT p_partkey AS item_id, CAST(i AS INT) AS i, k AS key, v AS value FROM (SELECT p_partkey, 0 AS i, 'Тип услуги' AS k, 'Аренда авто ' || p_brand AS v FROM part WHERE p_size % 5 = 0
    UNION ALL SELECT p_partkey, 0, '<other>', p_name FROM part WHERE p_size % 5 IN (1, 3) UNION ALL SELECT p_partkey, 1, 'Гарантия', p_brand FROM part WHERE p_size % 5 = 1
    UNION ALL SELECT p_partkey, 0, 'Вид услуги', p_type FROM part WHERE p_size % 5 = 2 UNION ALL SELECT p_partkey, 1, 'Услуга', p_brand FROM part WHERE p_size % 5 = 2) x""",
)
def parse_filters_exact(t):
    return t.part.select(F.col("p_partkey").alias("item_id"), F.posexplode(P.parse_filters(F.expr(_MIXED))).alias("i", "f")).select("item_id", "i", "f.key", "f.value")


@query(
    "filter_match",
    roles.sql(
        """SELECT a.query_id, a.item_id, f.kind > 0 AS q_vid, f.kind = 2 AS q_tip, f.kind > 0 AND contains('Вид услуги ' || i.params, 'Вид услуги ' || f.p_type) AS m_vid,
    f.kind = 2 AND contains(i.params || ' Тип услуги ' || i.class, 'Тип услуги ' || f.p_brand) AS m_tip,
    f.kind > 0 AND contains('Вид услуги ' || i.params, 'Вид услуги ' || f.p_type) AND (f.kind < 2 OR contains(i.params || ' Тип услуги ' || i.class, 'Тип услуги ' || f.p_brand)) AS m_all
    FROM list_a a JOIN items i ON a.item_id = i.item_id JOIN (SELECT p_partkey, p_type, p_brand, CASE WHEN p_size % 4 IN (1, 2) THEN p_size % 4 ELSE 0 END AS kind FROM part) f ON a.query_id = f.p_partkey""",
        "LIST_A",
        "ITEMS",
    ),
)
def filter_match(t):
    queries = t.part.select(F.col("p_partkey").alias("query_id"), F.expr(_FILTERS).alias("filters"))
    items = roles.of(t, "ITEMS").select("item_id", F.concat(F.lit("Вид услуги "), "params", F.lit(" Тип услуги "), "class").alias("params"))
    cands = roles.of(t, "LIST_A").join(queries.select("query_id"), "query_id", "left_semi")
    return P.filter_match(cands, queries, items).select("query_id", "item_id", "q_vid", "q_tip", "m_vid", "m_tip", "m_all")


@query(
    "filter_selectivity",
    """WITH n AS (SELECT count(*) AS n FROM part), k AS (SELECT p_type, count(*) AS c FROM part GROUP BY 1), b AS (SELECT p_type, p_brand, count(*) AS c FROM part GROUP BY 1, 2)
    SELECT q.p_partkey AS query_id, round(k.c / CAST(n.n AS DOUBLE), 6) AS share FROM part q JOIN k ON k.p_type = q.p_type, n WHERE q.p_size % 4 = 1
    UNION ALL SELECT q.p_partkey, round(b.c / CAST(n.n AS DOUBLE), 6) FROM part q JOIN b ON b.p_type = q.p_type AND b.p_brand = q.p_brand, n WHERE q.p_size % 4 = 2""",
)
def filter_selectivity(t):
    queries = t.part.select(F.col("p_partkey").alias("query_id"), F.expr(_FILTERS).alias("filters"))
    items = t.part.select(F.col("p_partkey").alias("item_id"), F.concat(F.lit("Вид услуги "), "p_type", F.lit(" Тип услуги "), "p_brand").alias("params"))
    return P.selectivity(queries, items).select("query_id", F.round("share", 6).alias("share"))


@query(
    "filter_audit",
    """WITH f AS (SELECT 'Вид услуги' AS key, CASE WHEN p_size % 4 = 3 THEN 'Другое' ELSE p_type END AS value, p_size % 4 < 3 AND p_partkey % 3 = 2 AS has, p_partkey % 3 <> 1 AS states FROM part WHERE p_size % 4 > 0
    UNION ALL SELECT 'Тип услуги', p_brand, false, false FROM part WHERE p_size % 4 = 2 UNION ALL SELECT 'Гарантия', p_brand, false, false FROM part WHERE p_size % 4 = 3)
    SELECT key, CASE WHEN n >= 100 THEN value ELSE '<rare>' END AS value, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(bad) AS BIGINT) AS violations, CAST(sum(none) AS BIGINT) AS undeterminable FROM (
    SELECT key, value, count(*) AS n, count(*) FILTER (states AND NOT has) AS bad, count(*) FILTER (NOT states) AS none FROM f GROUP BY 1, 2) x GROUP BY 1, 2""",
)
def filter_audit(t):
    params = F.expr("CASE WHEN p_partkey % 3 = 0 THEN 'Вид услуги иное' WHEN p_partkey % 3 = 1 THEN 'нет' ELSE concat('Вид услуги ', p_type) END")
    return P.audit(t.part.select(F.expr(_FILTERS).alias("filters"), params.alias("params")), 100)


@query(
    "clean_params",
    r"""SELECT p_partkey AS item_id, trim(regexp_replace(p_type || ' ' || regexp_replace(p_brand, '[0-9]+', ' ', 'g') || ' часе', '\s+', ' ', 'g')) AS clean FROM part""",
)
def clean_params(t):
    text = F.concat(F.lit("Вид услуги "), "p_type", F.lit(" Начальная цена "), F.col("p_size").cast("string"), F.lit(" ч "), "p_brand", F.lit(" часе"))
    return t.part.select(F.col("p_partkey").alias("item_id"), X.clean_params(text).alias("clean"))


@query("query_document", "SELECT p_partkey AS item_id, lower(CASE WHEN p_size % 4 IN (1, 2) THEN p_name || ' | вид услуги ' || p_type || CASE WHEN p_size % 4 = 2 THEN ' тип услуги ' || p_brand ELSE '' END ELSE p_name END) AS doc FROM part")
def query_document(t):
    from ..operators.ml import query_document as of

    return t.part.select(F.col("p_partkey").alias("item_id"), of("p_name", F.expr(_FILTERS)).alias("doc"))


_BASES, _ENDS = ("ремонт", "услуг", "стрижк", "машин"), ("а", "ы", "у", "ами", "ам", "ах")


@query("russian_stems", f"SELECT DISTINCT {list(_BASES)}[p_size % 4 + 1] || {list(_ENDS)}[p_partkey % 6 + 1] AS token, {list(_BASES)}[p_size % 4 + 1] AS stem FROM part")
def russian_stems(t):
    """Inflected words made from the parts' keys: base and ending; the stem is the base."""
    word = F.concat(F.get(F.array(*map(F.lit, _BASES)), F.col("p_size") % 4), F.get(F.array(*map(F.lit, _ENDS)), F.col("p_partkey").cast("int") % 6))
    return S.stem_table(t.part.select(word.alias("token")).distinct())


@query("term_schemes", "SELECT scheme, count(*) AS n, count(DISTINCT term) AS terms FROM (SELECT 'stem' AS scheme, unnest(string_split(p_name, ' ')) AS term FROM part UNION ALL SELECT 'both', pre || unnest(string_split(p_name, ' ')) FROM part, (VALUES ('L:'), ('S:')) v(pre)) x GROUP BY scheme")
def term_schemes(t):
    rows = sparse.token_rows(t.part, "p_partkey", "p_name").withColumnRenamed("term", "token")
    stems = S.stem_table(rows)
    lemmas = rows.select(F.col("token").alias("word"), F.col("token").alias("lemma")).distinct()
    one = X.terms(rows, "p_partkey", "stem", stems).withColumn("scheme", F.lit("stem"))
    both = X.terms(rows, "p_partkey", "lemma+stem", stems, lemmas).withColumn("scheme", F.lit("both"))
    return one.unionByName(both).groupBy("scheme").agg(F.count("*").alias("n"), F.count_distinct("term").alias("terms"))


@query("haversine", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(2 * 6371 * asin(sqrt(least(1.0::DOUBLE, pow(sin((radians(b.n_nationkey * 2.5::DOUBLE) - radians(a.n_nationkey * 2.5::DOUBLE)) / 2), 2) + cos(radians(a.n_nationkey * 2.5::DOUBLE)) * cos(radians(b.n_nationkey * 2.5::DOUBLE)) * pow(sin((radians(b.n_nationkey * 7.25::DOUBLE) - radians(a.n_nationkey * 7.25::DOUBLE)) / 2), 2)))), 6) AS km FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def haversine(t):
    a = t.nation.select(F.col("n_nationkey").alias("a"), "n_regionkey")
    b = t.nation.select(F.col("n_nationkey").alias("b"), "n_regionkey")
    km = M.haversine(F.col("a") * 2.5, F.col("a") * 7.25, F.col("b") * 2.5, F.col("b") * 7.25)
    return a.join(b, "n_regionkey").select("a", "b", F.round(km, 6).alias("km"))


@query("numeric_strings", "SELECT p_partkey AS item_id, TRY_CAST(CASE WHEN p_size % 5 = 0 THEN 'n/a' ELSE CAST(p_size AS VARCHAR) || '.5' END AS DOUBLE) AS lat, CAST(round_even(p_size / 2.0, 0) AS BIGINT) AS half_even, CASE WHEN p_size <= 10 THEN 0 WHEN p_size <= 30 THEN 1 ELSE 2 END AS bin, least(greatest(p_size, 10), 40) AS clipped FROM part")
def numeric_strings(t):
    rows = t.part.withColumn("s", F.expr("CASE WHEN p_size % 5 = 0 THEN 'n/a' ELSE concat(CAST(p_size AS STRING), '.5') END"))
    rows = rows.withColumn("lat", M.number("s"))
    return rows.select(F.col("p_partkey").alias("item_id"), "lat", M.round_even(F.col("p_size") / 2).cast("long").alias("half_even"), M.bucket(F.col("p_size"), [10, 30]).alias("bin"), M.clip(F.col("p_size"), 10, 40).alias("clipped"))


@query("text_quantiles", "SELECT round(quantile_cont(length(text)::DOUBLE, 0.0), 6) AS q0, round(quantile_cont(length(text)::DOUBLE, 0.25), 6) AS q25, round(quantile_cont(length(text)::DOUBLE, 0.5), 6) AS q50, round(quantile_cont(length(text)::DOUBLE, 0.75), 6) AS q75, round(quantile_cont(length(text)::DOUBLE, 0.95), 6) AS q95, round(quantile_cont(length(text)::DOUBLE, 1.0), 6) AS q100 FROM documents")
def text_quantiles(t):
    out = A.quantiles(io.text_lengths(t.documents, "text"), "text_length")
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query("oov_rate", f"WITH q AS (SELECT w, count(*) AS n FROM (SELECT unnest({_TOKENS.format('text')}) AS w FROM benchmark) x GROUP BY w), d AS (SELECT DISTINCT unnest({_TOKENS.format('text')}) AS w FROM documents) SELECT count(*) AS tokens, count(*) FILTER (d.w IS NULL) AS oov, CAST(sum(n) AS BIGINT) AS occurrences, CAST(coalesce(sum(n) FILTER (d.w IS NULL), 0) AS BIGINT) AS oov_occurrences FROM q LEFT JOIN d ON q.w = d.w")
def oov_rate(t):
    return A.oov(t.benchmark, t.documents)


@query("query_document_frequency", f"WITH q AS (SELECT DISTINCT unnest({_TOKENS.format('text')}) AS token FROM benchmark), d AS (SELECT w, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_TOKENS.format('text')}) AS w FROM documents) x GROUP BY w) SELECT token, coalesce(df, 0) AS df FROM q LEFT JOIN d ON token = w")
def query_document_frequency(t):
    return A.query_document_frequency(t.benchmark, t.documents)


@query("lexical_overlap", "SELECT field, round(avg(CASE WHEN k > 0 THEN 1 ELSE 0 END), 6) AS any_, round(avg(CASE WHEN k = n THEN 1 ELSE 0 END), 6) AS all_, round(avg(k / n::DOUBLE), 6) AS coverage FROM (SELECT 'p_name' AS field, len(list_intersect(list_distinct(string_split(lower(p_name), ' ')), list_distinct(string_split(lower(p_name), ' ')))) AS k, len(list_distinct(string_split(lower(p_name), ' '))) AS n FROM part UNION ALL SELECT 'p_type', len(list_intersect(list_distinct(string_split(lower(p_name), ' ')), [lower(p_type)])), len(list_distinct(string_split(lower(p_name), ' '))) FROM part) x GROUP BY field")
def lexical_overlap(t):
    out = A.lexical_overlap(t.part, "p_name", ["p_name", "p_type"])
    return out.select("field", F.round("any", 6).alias("any_"), F.round("all", 6).alias("all_"), F.round("coverage", 6).alias("coverage"))


@query("key_value_events", "SELECT event_type, count(*) AS n, count(DISTINCT CAST(json_extract_string(props, '$.k') AS INT)) AS ks, CAST(sum(CAST(json_extract_string(props, '$.k') AS INT)) AS BIGINT) AS total FROM events GROUP BY event_type")
def key_value_events(t):
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct(k).alias("ks"), F.sum(k).alias("total"))
