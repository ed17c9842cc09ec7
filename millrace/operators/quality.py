"""Checks of data and of results: each is a DataFrame of violations, empty when all is well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .usage import MEASURES


class GateError(Exception):
    """A gate was not passed; ``code`` is the exit code: 2 for unusable input, 3 for a broken invariant."""

    def __init__(self, message: str, code: int):
        super().__init__(message)
        self.code = code


def raw_covers_kept(reconciled: DataFrame) -> DataFrame:
    """Measures whose raw sum is below the deduplicated one."""
    return reconciled.where("raw < kept")


def levels_add_up(weekly: DataFrame) -> DataFrame:
    """Weeks whose groups don't sum to their subtotal, and the total if the subtotals don't sum to it. Sessions aren't additive and not checked."""
    sums = [F.sum(m).alias(m) for m in ("calls", *MEASURES)]
    names = ["calls", *MEASURES]
    lower = weekly.where("level = 'group'").groupBy("week").agg(*sums)
    upper = weekly.where("level = 'SUBTOTAL'").select("week", *names)
    top = weekly.where("level = 'TOTAL'").select(F.lit("*").alias("week"), *names)
    added = upper.groupBy(F.lit("*").alias("week")).agg(*sums)
    return lower.unionByName(added).exceptAll(upper.unionByName(top)).select("week")


def unknown_profiles(rows: DataFrame, known: DataFrame) -> DataFrame:
    return rows.select("profile").distinct().join(known.select("profile"), "profile", "left_anti")


def drift_share(lines: DataFrame, limit: float = 0.05) -> DataFrame:
    """Share of ``lines`` with a ``reason``; the gate fails strictly above ``limit``."""
    return lines.agg(F.count(F.lit(1)).alias("lines"), F.count("reason").alias("drifted")).withColumn("failed", F.col("drifted") > F.col("lines") * limit)


def missing(inputs: dict[str, DataFrame]) -> DataFrame:
    """``missing``: the names of inputs without rows; of each only one row is looked at."""
    spark = next(iter(inputs.values())).sparkSession
    some = reduce(DataFrame.unionByName, [df.limit(1).select(F.lit(name).alias("missing")) for name, df in inputs.items()])
    return spark.createDataFrame([(n,) for n in inputs], "missing string").join(some, "missing", "left_anti")


def require(violations: DataFrame, message: str, code: int = 3) -> None:
    if not violations.isEmpty():
        raise GateError(message, code)


def require_rows(df: DataFrame, message: str) -> None:
    if df.isEmpty():
        raise GateError(message, 2)
