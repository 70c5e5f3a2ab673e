"""Temperature mixing of sources, realised as a schedule of budgeted block permutations.

A source's weight is its token share raised to an exponent and normalised: 1 keeps the shares, 0 levels them. The
exponent is found by repeated section of [0, 1] so that the weights reach a target entropy, or so that no source repeats
more than a limit. Each source is then a stream of epochs, each a keyed permutation of its documents; block ``b`` of the
schedule takes from every source its weight's share of the block's token budget, in stream order, and is a keyed
permutation of what it took, so the sources of a block are interleaved.

Places in a stream are prefix sums over hash ranges: sums per range and per group of ranges, a running sum over groups,
over the ranges of a group, and over the rows of a range, so a source with a third of all rows is no task of its own. Many
epochs of one document are dealt out in parts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise

#: Sections of the exponent's interval in a pass, and passes: it is found to 1 / SECTIONS ** PASSES.
SECTIONS, PASSES = 64, 3
#: Epochs of a document that one task makes.
EPOCHS = 1024


def token_sizes(docs: DataFrame, source: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, source (null is ''), n_tokens: runs of other characters than white space."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), words.alias("n_tokens"))


def find_exponent(shares: DataFrame, entropy: float | None = None, repetition: float | None = None) -> float:
    """The largest exponent in [0, 1] whose weights have at least ``entropy`` (of its maximum, 0 to 1); or the least
    whose epochs differ between sources by no more than the factor ``repetition``.

    ``shares``: source, share (above 0). Every pass is one aggregation over the sources; only its one row of sums comes
    back. Flattening raises both the entropy and the repetitions, so either has one boundary.
    """
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        grid = [low + (high - low) * k / SECTIONS for k in range(SECTIONS + 1)]
        if entropy is not None:
            cells = [c for x in grid for c in (F.sum(F.pow("share", F.lit(x))), F.sum(F.pow("share", F.lit(x)) * F.log("share")))]
            row = shares.agg(F.count("*"), *cells).first()
            n = max(row[0], 2)

            def fits(k: int, row=row, n=n, grid=grid) -> bool:
                z, y = row[1 + 2 * k], row[2 + 2 * k]
                # H = ln z - x * sum(p^x ln p) / z
                return z is not None and (math.log(z) - grid[k] * y / z) / math.log(n) >= entropy

            good = [k for k in range(SECTIONS + 1) if fits(k)]
            k = max(good, default=0)
            low, high = grid[k], grid[min(k + 1, SECTIONS)]
        else:
            # Epochs are proportional to share ** (x - 1): the rarest source repeats most.
            row = shares.agg(F.max("share"), F.min("share")).first()
            if not row[0]:
                return 1.0
            good = [k for k, x in enumerate(grid) if (row[0] / row[1]) ** (1 - x) <= repetition]
            k = min(good, default=SECTIONS)
            low, high = grid[max(k - 1, 0)], grid[k]
    return low if entropy is not None else high


def schedule(
    sizes: DataFrame, entropy: float | None = None, repetition: float | None = None, budget: int | None = None, block_tokens: int = 1 << 20, rows_per_range: int = 4096, seed: int = 17
) -> DataFrame:
    """One row per scheduled copy: doc_id, source, epoch (from 0), n_tokens, block (from 0), at (tokens before it in its
    source's stream), position (from 0, in the block), weight (of the source; null for a source without tokens).

    ``sizes``: doc_id, source, n_tokens. Without ``budget`` the schedule is the shortest in which every document of
    every source occurs once. A document belongs to the block in which it begins. Documents without tokens
    take no place in the stream and stand where they fall; those of a source without tokens are dealt over the blocks by a
    hash. Repeated rows are scheduled each for itself. A null source is the source ''. An empty table gives no rows.
    """
    if (entropy is None) == (repetition is None):
        raise ValueError("give either entropy or repetition")
    sizes = materialise(sizes.select("doc_id", "source", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens")), "sizes")
    per_source = sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs"))
    totals = per_source.agg(F.sum("tokens"), F.sum("n_docs")).first()
    total, n_docs = totals[0] or 0, totals[1] or 0
    shares = materialise(per_source.where("tokens > 0").withColumn("share", F.col("tokens") / F.lit(float(max(total, 1)))), "shares")
    exponent = find_exponent(shares, entropy, repetition)
    row = shares.agg(F.sum(F.pow("share", F.lit(exponent))), F.max(F.col("tokens") / F.pow("share", F.lit(exponent)))).first()
    norm = row[0] or 1.0
    # The shortest budget that covers all: the source for which tokens / weight is largest is passed through once.
    tokens = float(budget) if budget is not None else float((row[1] or 0.0) * norm)
    weighted = shares.withColumn("weight", F.pow("share", F.lit(exponent)) / F.lit(norm)).withColumn("goal", F.col("weight") * F.lit(tokens))
    # A rounding error must not cut off the last document.
    weighted = weighted.select("source", "weight", "tokens", F.when(F.abs(F.col("goal") / F.col("tokens") - 1) < 1e-9, F.col("tokens").cast("double")).otherwise(F.col("goal")).alias("goal"))
    ranges = 1 << max(6, (max(1, n_docs // rows_per_range) - 1).bit_length())
    bits = ranges.bit_length() - 1
    epochs = F.coalesce(F.greatest(F.lit(1), F.ceil(F.col("goal") / F.col("tokens")).cast("int")), F.lit(1))
    parts = sizes.join(weighted, "source", "left").withColumn("epochs", epochs).withColumn("part", F.explode(F.expr(f"sequence(0, (epochs - 1) div {EPOCHS})")))
    if (weighted.agg(F.max(F.col("goal") / F.col("tokens"))).first()[0] or 0) > EPOCHS:
        parts = parts.repartition("source", "doc_id", "part")
    one = F.explode(F.expr(f"sequence(int(part * {EPOCHS}), int(least(epochs, (part + 1) * {EPOCHS}) - 1))"))
    copies = parts.withColumn("epoch", one).drop("part", "epochs")
    copies = copies.withColumn("h", F.xxhash64(F.lit(seed), "source", "epoch", "doc_id")).withColumn("range", F.shiftrightunsigned("h", 64 - bits))

    def running(value: str, keys: list[str], *order: str) -> Column:
        return F.coalesce(F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    sums = copies.groupBy("source", "epoch", "range").agg(F.sum("n_tokens").alias("own")).withColumn("group", F.shiftright("range", bits // 2))
    groups = sums.groupBy("source", "epoch", "group").agg(F.sum("own").alias("all_of"))
    groups = groups.select("source", "epoch", "group", running("all_of", ["source"], "epoch", "group").alias("first"))
    sums = sums.join(groups, ["source", "epoch", "group"])
    sums = sums.select("source", "epoch", "range", (F.col("first") + running("own", ["source", "epoch", "group"], "range")).alias("start"))
    at = F.col("start") + running("n_tokens", ["source", "epoch", "range"], "h", "doc_id", "n_tokens")
    placed = copies.join(sums, ["source", "epoch", "range"]).withColumn("at", at)
    placed = placed.where("goal IS NULL OR at < goal OR n_tokens = 0 AND at = goal")
    blocks = max(1, math.ceil(tokens / block_tokens))
    block = F.coalesce(F.floor(F.col("at") / (F.col("weight") * F.lit(float(block_tokens)))), F.pmod("h", F.lit(blocks)))
    placed = placed.select("doc_id", "source", "epoch", "n_tokens", block.alias("block"), "at", "weight")
    shuffled = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed + 1), "source", "epoch", "doc_id"), "doc_id", "n_tokens", "at")
    return placed.withColumn("position", F.row_number().over(shuffled).cast("long") - 1)
