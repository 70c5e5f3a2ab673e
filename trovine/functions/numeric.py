"""Numbers: coordinates, distances, vectors, buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def number(c: str) -> Column:
    """A number in a text; null where it is none."""
    return F.expr(f"try_cast({c} AS DOUBLE)")


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres between two points in degrees."""
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    c = F.greatest(c, F.lit(low)) if low is not None else c
    return F.least(c, F.lit(high)) if high is not None else c


def zero_nan(c: Column) -> Column:
    return F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0))


def round_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two float arrays, in double; the correct but slow path (the fast one is dense.top_k)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def bucket(c: Column, edges: Sequence[float]) -> Column:
    """0 up to the first edge (inclusive), 1 up to the second, ...; null stays null."""
    out = F.when(c.isNull(), F.lit(None).cast("int"))
    for k, edge in enumerate(edges):
        out = out.when(c <= edge, F.lit(k))
    return out.otherwise(F.lit(len(edges)))


def seeded_order(*cols: str | Column, seed: int = 42) -> Column:
    """A reproducible pseudo-random order that any engine can compute: MD5 of seed and key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols)))
