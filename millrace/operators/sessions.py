"""Problem 4: grouping activity into sessions.

A sweep line: each event adds one at its instant and takes one away when the idle gap
after it has run out; where the running sum comes to zero a session has closed, its end
being that instant less the gap. At equal instants additions come first, so that a
pause of exactly the gap doesn't split.

Events of one key that fall into one slot of the gap's length can't be parted by a
longer pause, so the slot enters the sweep as a single interval. The slots are
aggregated before anything is shuffled, and after that a key has at most one row per
half hour of its lifetime, however many events it had: a key with a third of all rows
isn't a hot one any more (17.5 million slots in the thousand years that are readable).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.instants import instant_micros, is_blank

GAP_SECONDS = 1800


def sessionize(events: DataFrame, key: str, micros: str, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """One row per session: ``key``, ``start_us``, ``end_us`` and ``events``.

    ``micros`` names a column of epoch microseconds; rows in which it or the key is null
    belong to no session. Repeated rows count as events of their own and start nothing.
    A session ends only when more than ``gap_seconds`` pass. An empty table gives none.
    """
    gap = gap_seconds * 1_000_000
    slots = (
        events.select(F.col(key).alias("_key"), F.col(micros).alias("_us"))
        .where("_key IS NOT NULL AND _us IS NOT NULL")
        .groupBy("_key", F.expr(f"_us div {gap}").alias("_slot"))
        .agg(F.min("_us").alias("_first"), F.max("_us").alias("_last"), F.count(F.lit(1)).alias("_events"))
    )
    deltas = slots.select("_key", F.inline(F.array(F.struct(F.col("_first").alias("_at"), F.lit(1).alias("_delta"), F.col("_events").alias("_n")), F.struct((F.col("_last") + gap).alias("_at"), F.lit(-1).alias("_delta"), F.lit(0).cast("bigint").alias("_n")))))
    sweep = Window.partitionBy("_key").orderBy("_at", F.desc("_delta")).rowsBetween(Window.unboundedPreceding, 0)
    running = deltas.withColumns({"_open": F.sum("_delta").over(sweep), "_seen": F.sum("_n").over(sweep)})
    # The first addition after a zero crossing opens a session: there the sum is 1 after having been 0.
    marks = running.where("(_delta = 1 AND _open = 1) OR _open = 0")
    order = Window.partitionBy("_key").orderBy("_at", F.desc("_delta"))
    paired = marks.withColumns({"_closed_at": F.lead("_at").over(order), "_closed_seen": F.lead("_seen").over(order)}).where("_delta = 1")
    return paired.select(
        F.col("_key").alias(key),
        F.col("_at").alias("start_us"),
        (F.col("_closed_at") - gap).alias("end_us"),
        (F.col("_closed_seen") - F.col("_seen") + F.col("_n")).alias("events"),
    )


def call_sessions(calls: DataFrame, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """Stretches of activity of ``calls``: ``session_id`` (lower case), ``start_ms``, ``end_ms``, ``duration_ms``, ``calls``.

    Blank session ids and unreadable times are left out, surplus copies count.
    """
    events = calls.where(~is_blank(F.col("session_id"))).select(F.lower("session_id").alias("session_id"), instant_micros(F.col("ts")).alias("us"))
    done = sessionize(events, "session_id", "us", gap_seconds)
    return done.select("session_id", F.expr("start_us div 1000").alias("start_ms"), F.expr("end_us div 1000").alias("end_ms"), F.expr("end_us div 1000 - start_us div 1000").alias("duration_ms"), F.col("events").alias("calls"))
