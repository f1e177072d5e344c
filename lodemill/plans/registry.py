"""All queries of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodemill.plans import changefeed, changes, content, indexing, media, retrieval, state, upkeep

_MODULES = [retrieval, content, state, indexing, changefeed, changes, media, upkeep]

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.search_files(spark, sf_dir)
