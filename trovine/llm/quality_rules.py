"""Quality rules with cutoffs chosen under a risk guarantee. DataFrame and SQL functions only.

Each rule compares a ratio with a cutoff. A cutoff may be used in a stratum only where the labelled good documents of
that stratum prove, by an exact binomial bound, that it rejects at most ``alpha / rules`` of the good documents. The
error probability ``delta`` is divided by the number of families tested (strata x rules); within a family the cutoffs are
tested in fixed sequence, from the loosest to the strictest, up to the first that fails, which needs no division. So all
the guarantees hold together. A stratum with too few labels for a proof keeps everything but the base failures.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialise

#: What separates words: space and the control characters tab to carriage return.
GAP = r"[\x20\x09-\x0D]+"
CUTOFFS = (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0)
RULES = {
    "symbols": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
}

#: Words in windows that occur twice: windows sorted with their start, neighbours compared, covered words summed.
_REPEATED = """
aggregate(
  sort_array(transform(
    transform(
      array(sort_array(transform(sequence(0, size(_w) - 5), i -> struct(array_join(slice(_w, i + 1, 5), ' ') AS s, i AS i)))),
      a -> filter(a, (x, k) -> coalesce(x.s = get(a, k - 1).s, false) OR coalesce(x.s = get(a, k + 1).s, false))
    )[0],
    x -> x.i)),
  struct(-5 AS last, 0L AS n),
  (acc, p) -> struct(p AS last, acc.n + least(5, p - acc.last) AS n),
  acc -> acc.n)
"""
_WINDOWS = """
slice(transform(_h, (x, i) -> xxhash64(x, get(_h, i + 1), get(_h, i + 2), get(_h, i + 3), get(_h, i + 4))),
      1, greatest(size(_h) - 4, 0))
"""


def base_metrics(docs: DataFrame, stratum: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, stratum, the counts of the base rules and ``base_failed``.

    A null or empty text has no words and fails. Texts are counted whole. Repeated rows are counted each for itself.
    Hashes of windows only decide whether a text is worth the exact comparison, which is made on the words themselves.
    """
    own = F.coalesce(F.col(stratum).cast("string"), F.lit("")) if stratum else F.lit("")
    words = docs.select(F.col(id_col).alias("doc_id"), own.alias("stratum"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    words = words.withColumn("_w", F.array_remove(F.split("_t", GAP), ""))
    words = words.withColumn("_lines", F.expr(r"filter(split(_t, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')"))
    hashed = words.withColumn("_h", F.expr("transform(_w, x -> xxhash64(x))"))
    windows = hashed.withColumn("_v", F.expr(_WINDOWS))
    n_words = F.size("_w").cast("long")
    counted = windows.select(
        "doc_id",
        "stratum",
        n_words.alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_v")) < F.size("_v"), F.expr(_REPEATED)).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    return counted.withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))


def binomial_cdf(k: str, n: str, p: float) -> Column:
    """P(X <= k) of a binomial(n, p), from its terms in logarithms, exact to rounding; 1 where k is beyond the mean."""
    first = f"{n} * ln(1 - {p}D)"
    step = f"acc.t + ln(({n} - j + 1) / j) + ln({p}D / (1 - {p}D))"
    return F.expr(
        f"""CASE WHEN {k} >= {n} * {p}D THEN 1D ELSE exp(aggregate(
          CASE WHEN {k} >= 1 THEN sequence(1L, {k}) ELSE array() END,
          struct({first} AS t, {first} AS s),
          (acc, j) -> struct({step} AS t, greatest(acc.s, {step}) + ln(1 + exp(-abs(acc.s - ({step})))) AS s),
          acc -> acc.s)) END"""
    )


def calibrate(metrics: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05, cutoffs: Sequence[float] = CUTOFFS, cost: float = 10.0) -> DataFrame:
    """(stratum, rule, cutoff): the certified cutoff that rejects most bad documents, a good one counting ``cost`` times.

    ``labels`` has doc_id and quality (1 good, 0 bad); rows with nulls are no evidence, and a document labelled twice
    counts as good if any label says so. Rows that already fail the base rules are no evidence either. A document is
    evidence once in a stratum, however many rows it has: by the greatest of its rows' ratios.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    greatest = [F.max(F.expr(ratio)).alias(f"r_{rule}") for rule, ratio in RULES.items()]
    held = metrics.where(~F.col("base_failed")).join(known, "doc_id").groupBy("doc_id", "stratum").agg(F.max("quality").alias("quality"), *greatest)
    good, bad = F.col("quality") == 1, F.col("quality") == 0
    cells = []
    for rule in RULES:
        for cutoff in cutoffs:
            over = F.col(f"r_{rule}") >= cutoff
            cells.append(
                F.struct(
                    F.lit(rule).alias("rule"),
                    F.lit(float(cutoff)).alias("cutoff"),
                    F.sum((good & over).cast("long")).alias("k"),
                    F.sum((bad & over).cast("long")).alias("hits"),
                )
            )
    table = held.groupBy("stratum").agg(F.sum(good.cast("long")).alias("n"), F.array(*cells).alias("cells"))
    tests = table.agg((F.count("*") * len(RULES)).alias("tests"))  # one row
    table = table.crossJoin(F.broadcast(tests))
    table = table.select("stratum", "n", "tests", F.explode("cells").alias("cell")).select("stratum", "n", "tests", "cell.*")
    # A stricter cutoff rejects as many good ones or more, so the fixed sequence ends where the first bound fails.
    table = table.withColumn("p_value", binomial_cdf("k", "n", alpha / len(RULES)))
    worth = F.col("hits") - cost * F.col("k")
    certified = table.where((F.col("p_value") <= delta / F.col("tests")) & (worth > 0))
    return certified.groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct(worth, F.col("cutoff"))).alias("cutoff"))


def judge(metrics: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``metrics`` with ``kept``: no base failure, and no ratio at or over its stratum's cutoff."""
    by_stratum = cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_cut"))
    rejected = F.lit(False)
    for rule, ratio in RULES.items():
        rejected = rejected | F.coalesce(F.expr(ratio) >= F.element_at(F.col("_cut"), F.lit(rule)), F.lit(False))
    return metrics.join(by_stratum, "stratum", "left").withColumn("kept", ~F.col("base_failed") & ~rejected).drop("_cut")


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """Metrics and verdict per row of ``docs`` (doc_id, text, and the stratum's column).

    Null and empty texts fail; a null stratum is the stratum ''; other columns are ignored; empty tables give no rows.
    The texts are read once: the narrow metrics are written to the shared folder, and labels, cutoffs and verdicts
    come from there.
    """
    metrics = materialise(base_metrics(docs, stratum), "quality")
    # Written too: of a table of a few rows Spark knows the size, and sends it out instead of sorting all by stratum.
    return judge(metrics, materialise(calibrate(metrics, labels, alpha, delta), "cutoffs"))
