"""Within-group functions over candidate lists. All of one frame share one partitioning, so one shuffle serves them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Q = ("query_id",)


def over(by: Sequence[str] = Q) -> Window:
    return Window.partitionBy(*by)


def renumber(df: DataFrame, order: Sequence[Column | str], by: Sequence[str] = Q, name: str = "rank") -> DataFrame:
    """Ranks 1, 2, ... in the given order, which should be total."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def percentile_rank(c: str, by: Sequence[str] = Q) -> Column:
    """Rank as a share of the non-null values, ties averaged; null stays null. Rank and ties come from one sort."""
    ordered = Window.partitionBy(*by).orderBy(F.col(c).asc_nulls_last())
    ties = F.count("*").over(ordered.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(F.col(c).isNotNull(), (F.rank().over(ordered) + (ties - 1) / 2) / F.count(c).over(over(by)))


def ratio_to_max(c: str, by: Sequence[str] = Q) -> Column:
    top = F.max(c).over(over(by))
    return F.coalesce(F.col(c) / F.when(top != 0, top), F.lit(0.0))


def gap_to_max(c: str, by: Sequence[str] = Q) -> Column:
    return F.col(c) - F.max(c).over(over(by))


def zscore(c: str, by: Sequence[str] = Q, epsilon: float = 1e-6) -> Column:
    """Sample standard deviation; a group of one has none, and null."""
    return (F.col(c) - F.avg(c).over(over(by))) / (F.stddev_samp(c).over(over(by)) + F.lit(epsilon))


def gap_to_place(c: str, place: int = 50, by: Sequence[str] = Q) -> Column:
    """Difference to the score at a rank; to 0 where the list is shorter."""
    return F.col(c) - F.coalesce(F.max(F.when(F.col("rank") == place, F.col(c))).over(over(by)), F.lit(0.0))


def group_median(df: DataFrame, c: str, by: Sequence[str] = Q, name: str = "median") -> DataFrame:
    """By aggregation and join: a window would sort each group for every row's frame."""
    return df.join(df.groupBy(*by).agg(F.median(c).alias(name)), list(by), "left")


def location_share(loc: str = "item_location_id", by: Sequence[str] = Q) -> Column:
    """Share of a group's rows that have this row's location."""
    return F.count("*").over(Window.partitionBy(*by, loc)) / F.count("*").over(over(by))


def global_rank(c: str, by: Sequence[str] = Q) -> Column:
    """1 + the number of strictly better rows."""
    return F.rank().over(Window.partitionBy(*by).orderBy(F.col(c).desc_nulls_last()))


def min_max(c: str, by: Sequence[str] = Q) -> Column:
    """0 to 1; 1 where all are equal."""
    low, high = F.min(c).over(over(by)), F.max(c).over(over(by))
    return F.when(high > low, (F.col(c) - low) / F.nullif(high - low, F.lit(0.0))).otherwise(F.lit(1.0))


def z_norm(c: str, by: Sequence[str] = Q) -> Column:
    """Population standard score; 0 where all are equal."""
    spread = F.stddev_pop(c).over(over(by))
    return F.when(spread > 0, (F.col(c) - F.avg(c).over(over(by))) / F.nullif(spread, F.lit(0.0))).otherwise(F.lit(0.0))


def first_per(df: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    return head(df, by, order, 1)


def head(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """The first ``k`` rows of each group. The limit is planned below the shuffle as well."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("_rn") <= k).drop("_rn")
