"""Collects the queries of every plan module."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import catalog, eval_queries, label_queries, model_queries, report_queries, source_queries, text_queries

MODULES = (text_queries, label_queries, eval_queries, model_queries, report_queries, source_queries)


def queries() -> dict[str, catalog.Query]:
    return dict(catalog.QUERIES)


def oracles() -> dict[str, str]:
    return dict(catalog.ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.QUERIES["flagship"](spark, sf_dir)
