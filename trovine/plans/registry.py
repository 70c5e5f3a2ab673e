"""The registered queries and the SQL that they must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.io import spread

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


class Tables:
    """The tables of a folder, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return spread(self.spark.read.parquet(f"{self.folder}/{name}.parquet"))


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of ``Tables`` under a name, with the SQL of its result."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in _queries:
            raise ValueError(f"{name} is registered twice")
        _queries[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            _sql[name] = sql
        return f

    return register


def _load() -> None:
    from . import evaluation, learning, ranking, relational, retrieval, text  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
