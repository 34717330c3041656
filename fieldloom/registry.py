"""All queries over the reference operators, with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldloom.plans import embedding_queries as _embedding  # noqa: F401  (these add their own to the same tables)
from fieldloom.plans import file_queries as _file  # noqa: F401
from fieldloom.plans import more_queries as _more  # noqa: F401
from fieldloom.plans import queries as _queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_queries.ORACLES)
