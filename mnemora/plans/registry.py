"""Where the plans enter their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mnemora.sources import read_table

#: The moment that stands for now, so that results don't depend on the clock.
NOW = "2025-05-02 00:00:00"
AS_OF = "2024-06-01 00:00:00"


class Tables:
    """The tables of a directory, by attribute; ``asked`` may hold queries of one's own for the searches."""

    asked: DataFrame | None = None

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return read_table(self.spark, self.sf_dir, name)


class Plan:
    """Queries by name and their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None):  # noqa: ANN201
        def enter(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            self.queries[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return enter
