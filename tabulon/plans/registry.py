"""The register of queries: a function of (spark, sf_dir) and, where SQL can express it, DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables by name; only the columns that a query asks for are read."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = ship(spark), folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    """Register f(tables) under its name."""

    def register(f: Callable[[Tables], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, folder: f(Tables(spark, folder))
        QUERIES[key].__name__ = key
        if sql:
            ORACLES[key] = sql
        return f

    return register


def r4(col: Column | str, name: str | None = None, digits: int = 4) -> Column:
    out = F.round(F.col(col) if isinstance(col, str) else col, digits)
    return out.alias(name) if name else out
