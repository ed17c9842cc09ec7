"""Tracked agents and listings of them, as batches; the streaming twin is in ``millrace.streaming.meters``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.instants import is_blank

ACTIVE = ("pending", "running", "waiting", "idle")
GRACE_MS = 10_000
MISSES = 4


def is_active(status: Column) -> Column:
    return F.coalesce(status.isin(*ACTIVE), F.lit(False))


def merged(agents: DataFrame, listed: DataFrame) -> DataFrame:
    """Full outer merge of the tracked rows with the latest listing of each agent.

    ``change``: updated, inserted (listed only), ended (once seen, no longer listed),
    missed (never seen and not listed), dropped (missed for the fourth time). Listings
    and repeated rows are reduced to the latest per agent before the join.
    """
    a = agents.where("id IS NOT NULL").groupBy("session_id", "id").agg(F.max_by(F.struct("status", "is_seen", "misses", "ended_at"), F.col("row_id")).alias("a"))
    b = listed.where("id IS NOT NULL").groupBy(F.col("session_id").alias("s"), F.col("id").alias("i")).agg(F.max_by(F.struct("status", "listed_at"), F.struct("listed_at", "listing_id")).alias("b"))
    x = a.join(b, F.col("session_id").eqNullSafe(F.col("s")) & (F.col("id") == F.col("i")), "full_outer")
    seen = F.coalesce(F.col("a.is_seen"), F.lit(False))
    gone = F.col("b").isNull()
    misses = F.coalesce(F.col("a.misses"), F.lit(0)) + 1
    change = F.when(gone & ~seen & (misses >= MISSES), "dropped").when(gone & ~seen, "missed").when(gone, "ended").when(F.col("a").isNull(), "inserted").otherwise("updated")
    status = F.when(gone & seen, "ended").otherwise(F.coalesce(F.col("b.status"), F.col("a.status")))
    return x.select(F.coalesce("session_id", "s").alias("session_id"), F.coalesce("id", "i").alias("id"), change.alias("change"), status.alias("status"), F.when(gone & ~seen, misses).otherwise(0).alias("misses"))


def parent_labels(agents: DataFrame) -> DataFrame:
    """The parent's type, the first characters of an unknown parent's id, or 'main' without one."""
    a = agents.where("id IS NOT NULL").groupBy("id").agg(F.max_by(F.struct("type", "parent_id"), "row_id").alias("r")).select("id", "r.*")
    p = a.select(F.col("id").alias("parent_id"), F.col("type").alias("parent_type"))
    x = a.join(p, "parent_id", "left")
    return x.select("id", F.when(is_blank(F.col("parent_id")), "main").otherwise(F.coalesce("parent_type", F.substring("parent_id", 1, 8))).alias("parent"))


def visible(agents: DataFrame, now: DataFrame) -> DataFrame:
    """Agents that are active, or ended within the grace before ``now`` (a single row)."""
    return agents.where(is_active(F.col("status")) | (F.col("ended_at") >= now.select("now").scalar() - GRACE_MS))


def active_sessions(agents: DataFrame) -> DataFrame:
    return agents.groupBy("session_id").agg(F.bool_or(is_active(F.col("status"))).alias("active"))


def token_totals(agents: DataFrame) -> DataFrame:
    t = F.col("tokens")
    rows = agents.select("id", "row_id", "tokens").dropDuplicates(["id", "row_id"])
    return rows.groupBy("id").agg(F.sum(t["input"] + t["output"] + t["cache_write"]).alias("total"))


def band(agents: DataFrame, rows: int = 6) -> DataFrame:
    """Per session the first ``rows`` agents by start and id, and how many more there are.

    Only as many as are shown are kept: each slot of a session gives at most ``rows`` of
    its own before those of the session are ranked.
    """
    slots = agents.withColumn("_slot", F.pmod(F.xxhash64("id"), F.lit(64)))
    first = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("started_at", "id"))
    few = slots.withColumn("_n", first("session_id", "_slot")).where(F.col("_n") <= rows)
    shown = few.withColumn("place", first("session_id")).where(F.col("place") <= rows)
    all_of = agents.groupBy(F.col("session_id").alias("_s")).agg(F.count(F.lit(1)).alias("_all"))
    x = shown.join(all_of, F.col("session_id").eqNullSafe(F.col("_s")))
    return x.select("session_id", "id", "place", F.greatest(F.col("_all") - rows, F.lit(0)).alias("more"))


def status_changes(listed: DataFrame) -> DataFrame:
    """Listings of an agent whose status differs from the one before."""
    w = Window.partitionBy("session_id", "id").orderBy("listed_at", "listing_id")
    x = listed.withColumns({"before": F.lag("status").over(w), "n": F.row_number().over(w)})
    return x.where((F.col("n") > 1) & ~F.col("before").eqNullSafe(F.col("status"))).select("session_id", "id", "listing_id", "before", "status")
