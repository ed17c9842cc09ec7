"""All queries of the core, by name, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import content, problems, scanning, sets, single, streams, usage

FLAGSHIP = "a2_weekly_by_model_effort"


def _in_utc(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Weeks and days of reports are those of UTC, whatever zone the session came with."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query(spark, folder)

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = problems.QUERIES | usage.SPARK | content.SPARK | scanning.SPARK | streams.SPARK | sets.SPARK | single.SPARK
    return {name: _in_utc(query) for name, query in every.items()}


def oracle_sql() -> dict[str, str]:
    return problems.SQL | usage.SQL | content.SQL | scanning.SQL | streams.SQL | sets.SQL | single.SQL
