"""The registry of named queries: a Spark plan and, where SQL can express it, the same query for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Adds the decorated function to the registry; ``oracle`` is its SQL for DuckDB."""

    def put(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} exists already")
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return put


#: Tables of whole texts, whose rows are costly to work on.
TEXTS = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(frame) if name in TEXTS else frame
