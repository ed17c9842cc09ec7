"""What came before a row in its key, without a key being one task's work.

A window over a whole key would make one task of a key that holds a third of all rows. So
rows look back within slots of the key, slots are aggregated to a row each, and what is
before a slot comes from a window over these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _with_before(df: DataFrame, keys: list[str], slot: str, inner: Column, summary: Column, over: Column) -> DataFrame:
    """``df`` with ``_inner`` (looked up within the slot) and ``_outer`` (from the slots before)."""
    near = df.withColumn("_inner", inner)
    slots = df.groupBy(*keys, slot).agg(summary.alias("_sum"))
    slots = slots.withColumn("_outer", over).drop("_sum").withColumnsRenamed({k: f"_k_{k}" for k in (*keys, slot)})
    return near.join(slots, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in (*keys, slot)], "left").drop(*[f"_k_{k}" for k in (*keys, slot)])


def with_previous(df: DataFrame, keys: list[str], order: str, slot: str, value: str, name: str) -> DataFrame:
    """``name``: the ``value`` of the row before in the key, a struct of it in field ``v``; null for the first. ``slot`` rises with ``order``."""
    held = F.struct(F.col(value).alias("v"))
    inner = F.lag(held).over(Window.partitionBy(*keys, slot).orderBy(order))
    over = F.lag("_sum").over(Window.partitionBy(*keys).orderBy(slot))
    x = _with_before(df, keys, slot, inner, F.max_by(held, order), over)
    return x.withColumn(name, F.coalesce("_inner", "_outer")).drop("_inner", "_outer")


def with_most_before(df: DataFrame, keys: list[str], order: str, slot: str, value: str, name: str) -> DataFrame:
    """``name``: the greatest ``value`` of all rows before in the key, null for the first."""
    inner = F.max(value).over(Window.partitionBy(*keys, slot).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    over = F.max("_sum").over(Window.partitionBy(*keys).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1))
    x = _with_before(df, keys, slot, inner, F.max(value), over)
    return x.withColumn(name, F.greatest("_inner", "_outer")).drop("_inner", "_outer")
