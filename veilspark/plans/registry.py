"""Every query of the core library, with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilspark.plans import contents, service  # noqa: F401  they register their queries
from veilspark.plans import queries as core


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.search_multi_first_wins(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(core.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(core.SQL)
