"""Alerts over measures at rest; the streaming twins are in ``millrace.streaming``.

``at`` orders the measures of a key, ``slot`` is a coarser column that rises with it:
keys are worked on in slots, so that a hot one isn't one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import alert_level
from .sequence import with_most_before, with_previous


def crossings(measures: DataFrame, key: str, at: str, slot: str, percent: str, warn: int = 80) -> DataFrame:
    """Measures that cross the threshold on the way up: at or above it while the one before in the key wasn't. Unknown shares are passed over."""
    x = with_previous(measures.where(F.col(percent).isNotNull()), [key], at, slot, percent, "_before")
    return x.where((F.col(percent) >= warn) & ~F.coalesce(F.col("_before.v") >= warn, F.lit(False))).drop("_before")


def ratchet(measures: DataFrame, keys: list[str], at: str, slot: str, percent: str, warn: int = 80, critical: int = 95) -> DataFrame:
    """Measures whose level is above all earlier ones of their key and period, with ``level``."""
    x = with_most_before(measures.withColumn("level", alert_level(F.col(percent), warn, critical)), keys, at, slot, "level", "_most")
    return x.where(F.col("level") > F.coalesce("_most", F.lit(0))).drop("_most")


def window_changes(measures: DataFrame, key: str, at: str, slot: str, windows: str) -> DataFrame:
    """Measures whose rate windows (an array of kind, reset and percent) differ from those of the measure before in the key; the first counts as a change. The order of windows plays no part."""
    x = with_previous(measures.withColumn("_set", F.array_sort(windows)), [key], at, slot, "_set", "_before")
    return x.where(F.col("_before").isNull() | ~F.col("_before.v").eqNullSafe(F.col("_set"))).drop("_before", "_set")


def is_live(resets_at: Column, now: Column) -> Column:
    """Whether a rate window still runs: without a reset time, or before it."""
    return resets_at.isNull() | (resets_at > now)
