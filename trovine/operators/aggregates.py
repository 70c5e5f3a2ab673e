"""Counts, shares and profiles of logs, texts and corpora."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has_digit, has_filter, has_latin, prefix_tokens, tokens, word_count


def popularity(log: DataFrame, by: Sequence[str] = (), k: int | None = None) -> DataFrame:
    """Choices per item (and per key of ``by``), with rank by count, ties by item id; the first ``k``.

    Without ``by`` a ``k`` is needed: only a head can be ranked without one task for all items.
    """
    if not by and k is None:
        raise ValueError("give k, or keys to rank by")
    n = log.groupBy(*by, "item_id").agg(F.count("*").alias("n"))
    if by:
        ranked = n.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "item_id")))
        return ranked.where(F.col("rank") <= k) if k else ranked
    best = n.orderBy(F.desc("n"), "item_id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "item_id")))


def popular_lists(log: DataFrame, by: str, k: int) -> DataFrame:
    rows = popularity(log, [by], k).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rank", "item_id"))).alias("x"))
    return rows.select(by, F.transform("x", lambda s: s["item_id"]).alias("items"))


def shares(df: DataFrame, *by: str) -> DataFrame:
    """Count and share of each combination, by aggregation and one row of total."""
    n = df.groupBy(*by).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("_t")))).select(*by, "n", (F.col("n") / F.col("_t")).alias("share"))  # one row


def distinct_per(df: DataFrame, key: str, value: str, name: str = "n") -> DataFrame:
    return df.groupBy(key).agg(F.count_distinct(value).alias(name))


def class_weights(rows: DataFrame, mode: str = "text") -> DataFrame:
    """(doc, class, w): each document's classes with weights that sum to 1 (``text``), or the counts (``rows``)."""
    n = rows.groupBy("doc", "class").agg(F.count("*").alias("n"))
    return n.select("doc", "class", (F.col("n") / F.sum("n").over(Window.partitionBy("doc")) if mode == "text" else F.col("n").cast("double")).alias("w"))


def label_sets(rows: DataFrame) -> DataFrame:
    return rows.groupBy("query_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))


def profile(queries: DataFrame, flags: Sequence[str]) -> DataFrame:
    """One row: number, mean of each flag, mean word count of search_query."""
    return queries.agg(F.count("*").alias("n"), *(F.avg(F.col(f).cast("double")).alias(f) for f in flags), F.avg(word_count("search_query")).alias("words"))


def slices(rows: DataFrame, metric: str, groups: Mapping[str, Column]) -> DataFrame:
    """Mean of a metric in groups that may overlap: one pass, a row for each group it is in."""
    names = F.array(*(F.when(c, F.lit(name)) for name, c in groups.items()))
    tagged = rows.select(metric, F.explode(F.filter(names, lambda x: x.isNotNull())).alias("slice"))
    return tagged.groupBy("slice").agg(F.count("*").alias("n"), F.avg(metric).alias("mean"))


def win_rate(scores: DataFrame, a: str, b: str, by: str = "query_id") -> DataFrame:
    """One row: mean over queries of P(a > b) + half of P(a = b); rows with a null are left out."""
    win = F.when(F.col(a) > F.col(b), 1.0).when(F.col(a) == F.col(b), 0.5).otherwise(0.0)
    per = scores.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(by).agg(F.avg(win).alias("w"))
    return per.agg(F.count("*").alias("queries"), F.avg("w").alias("win_rate"))


def quantiles(df: DataFrame, c: str, at: Sequence[float] = (0.0, 0.25, 0.5, 0.75, 0.95, 1.0), by: Sequence[str] = ()) -> DataFrame:
    """Exact interpolated quantiles, one column each: q0, q25, ..."""
    cells = [F.percentile(c, F.lit(float(q))).alias(f"q{q * 100:g}") for q in at]
    return df.groupBy(*by).agg(*cells) if by else df.agg(*cells)


def value_table(df: DataFrame, c: str, n: int = 20) -> DataFrame:
    return df.groupBy(c).agg(F.count("*").alias("n")).orderBy(F.desc("n"), c).limit(n)


def duplicate_groups(df: DataFrame, keys: Mapping[str, Sequence[str]]) -> DataFrame:
    """For each named key: groups of more than one row, rows in them, rows beyond the first of each."""
    out = None
    for name, key in keys.items():
        n = df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
        row = n.agg(F.lit(name).alias("key"), F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("excess"))
        out = row if out is None else out.unionByName(row)
    return out


def concentration(rows: DataFrame, key: str, value: str, minimums: Sequence[int] = (1, 2, 5)) -> DataFrame:
    """Share of rows that have their key's most frequent value, over keys with at least so many rows."""
    n = rows.groupBy(key, value).agg(F.count("*").alias("n")).groupBy(key).agg(F.max("n").alias("top"), F.sum("n").alias("all"))
    cells = [c for m in minimums for c in (F.count_if(F.col("all") >= m).alias(f"keys_{m}"), (F.sum(F.when(F.col("all") >= m, F.col("top"))) / F.sum(F.when(F.col("all") >= m, F.col("all")))).alias(f"share_{m}"))]
    return n.agg(*cells)


def coverage(log: DataFrame, tops: Sequence[int] = (10, 100, 1000)) -> DataFrame:
    """Share of all rows that fall on the N most chosen items."""
    n = log.groupBy("item_id").agg(F.count("*").alias("n"))
    head = n.orderBy(F.desc("n"), "item_id").limit(max(tops)).withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "item_id")))
    cells = head.agg(*(F.sum(F.when(F.col("r") <= t, F.col("n"))).alias(f"top_{t}") for t in tops))
    total = n.agg(F.sum("n").alias("_t"))
    return cells.crossJoin(F.broadcast(total)).select(*((F.col(f"top_{t}") / F.col("_t")).alias(f"top_{t}") for t in tops))  # one row each


def oov(queries: DataFrame, corpus: DataFrame, prefix: int | None = None) -> DataFrame:
    """One row: distinct query tokens, how many no document has; token occurrences, how many no document has."""
    cut = (lambda c: prefix_tokens(c, prefix)) if prefix else tokens
    q = queries.select(F.explode(cut("text")).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    known = corpus.select(F.explode(F.array_distinct(cut("text"))).alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    both = q.join(known, "t", "left")
    none = F.col("df").isNull()
    return both.agg(F.count("*").alias("tokens"), F.count_if(none).alias("oov"), F.sum("n").alias("occurrences"), F.coalesce(F.sum(F.when(none, F.col("n"))), F.lit(0)).alias("oov_occurrences"))


def query_document_frequency(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(token, df): documents with each token of the queries; 0 for none."""
    q = queries.select(F.explode(tokens("text")).alias("token")).distinct()
    d = corpus.select(F.explode(F.array_distinct(tokens("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return q.join(d, "token", "left").select("token", F.coalesce("df", F.lit(0)).alias("df"))


def lexical_overlap(pairs: DataFrame, query: str, fields: Sequence[str], prefix: int | None = None) -> DataFrame:
    """For each field: share of pairs with any, with all tokens of the query in it, and the mean share of tokens."""
    cut = (lambda c: prefix_tokens(c, prefix)) if prefix else tokens
    q = F.array_distinct(cut(query))
    found = F.array(*(F.struct(F.lit(f).alias("field"), F.size(F.array_intersect(q, cut(f))).alias("k"), F.size(q).alias("n")) for f in fields))
    rows = pairs.select(F.explode(found).alias("x")).select("x.*").where("n > 0")
    return rows.groupBy("field").agg(F.avg((F.col("k") > 0).cast("double")).alias("any"), F.avg((F.col("k") == F.col("n")).cast("double")).alias("all"), F.avg(F.col("k") / F.col("n")).alias("coverage"))


def query_stats(queries: DataFrame, c: str = "search_query") -> DataFrame:
    """One row: rows, distinct texts, mean words and characters, shares with Latin letters and digits."""
    return queries.agg(
        F.count("*").alias("rows"),
        F.count_distinct(c).alias("texts"),
        F.avg(word_count(c)).alias("words"),
        F.avg(F.length(F.coalesce(c, F.lit("")))).alias("chars"),
        F.avg(has_latin(c).cast("double")).alias("latin"),
        F.avg(has_digit(c).cast("double")).alias("digits"),
    )


def filter_share(queries: DataFrame, c: str = "filters") -> DataFrame:
    return queries.agg(F.avg(has_filter(c).cast("double")).alias("with_filter"))


def baseline_ladder(log: DataFrame, key: str, location: str, text: str, k: int = 50, held: int = 10) -> DataFrame:
    """Recall@k of three popularity lists on a hold-out of one key in ``held``: all, by location, by text.

    A key is held out as a group; the lists are made from the rest.
    """
    from ..functions.numeric import seeded_order

    rows = log.withColumn("_h", F.conv(F.substring(seeded_order(key), 1, 6), 16, 10).cast("long") % held == 0)
    fit, test = rows.where("NOT _h"), rows.where("_h").select(key, location, text, "item_id").distinct()
    everyone = popularity(fit, k=k).select("item_id").withColumn("hit_all", F.lit(1))
    local = popularity(fit, [location], k).select(location, "item_id").withColumn("hit_location", F.lit(1))
    by_text = popularity(fit, [text], k).select(text, "item_id").withColumn("hit_text", F.lit(1))
    hits = test.join(everyone, "item_id", "left").join(local, [location, "item_id"], "left").join(by_text, [text, "item_id"], "left")
    names = ("hit_all", "hit_location", "hit_text")
    per = hits.groupBy(key).agg(*(F.avg(F.coalesce(n, F.lit(0))).alias(n) for n in names))
    return per.agg(F.count("*").alias("queries"), *(F.avg(n).alias(n.replace("hit", "recall")) for n in names))


def history_in_corpus(queries: DataFrame, log: DataFrame) -> DataFrame:
    """query_id, seen (its text is in the log), n (rows of its text)."""
    n = log.groupBy("search_query").agg(F.count("*").alias("n"))
    return queries.join(n, "search_query", "left").select("query_id", F.col("n").isNotNull().alias("seen"), F.coalesce("n", F.lit(0)).alias("n"))
