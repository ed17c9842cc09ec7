"""Running a stream over what is there and reading its result as a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import kfmt
from ..session import scratch_root


def drained(stream: DataFrame, name: str) -> DataFrame:
    """Runs an append-mode stream until its source is used up, into the shared folder, and gives what it wrote."""
    spark = stream.sparkSession
    root = scratch_root(spark, name)
    query = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def settled_state(stream: DataFrame, name: str, variable: str) -> DataFrame:
    """Runs a meter until its source is used up and gives what its map ``variable`` holds then, a row per entry: ``key``, ``entry`` and ``value``."""
    spark = stream.sparkSession
    root = scratch_root(spark, name)
    query = stream.writeStream.format("noop").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    held = spark.read.format("statestore").option("stateVarName", variable).option("flattenCollectionTypes", True).load(f"{root}/checkpoint")
    return held.select("key", F.col("user_map_key").alias("entry"), F.col("user_map_value").alias("value"))


def latest_state(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """What a meter holds at this moment, read from its checkpoint: a report between two micro-batches."""
    return spark.read.format("statestore").option("stateVarName", variable).load(checkpoint)


def status_line(totals: DataFrame) -> DataFrame:
    """``session``, ``line``: the share of the window, tokens of the last turn and its cache share, unknown parts left out.

    Needs ``session``, ``tokens``, ``window``, ``turn_in``, ``turn_out``, ``turn_cached``; any but the first may be null.
    """
    context = F.concat(F.lit("ctx "), F.floor(F.col("tokens") * 100 / F.col("window") + 0.5).cast("string"), F.lit("% "), kfmt(F.col("tokens")), F.lit("/"), kfmt(F.col("window")))
    turn = F.concat(F.lit("turn in "), kfmt(F.col("turn_in")), F.lit(" out "), kfmt(F.col("turn_out")), F.coalesce(F.concat(F.lit(" cache "), F.floor(F.col("turn_cached") * 100 / F.when(F.col("turn_in") > 0, F.col("turn_in")) + 0.5).cast("string"), F.lit("%")), F.lit("")))
    return totals.select("session", F.concat_ws(" · ", context, turn).alias("line"))


def live(stream: DataFrame, checkpoint: str, tell: Callable[[DataFrame, int], None], failed: str, every: str | None = "2 seconds") -> StreamingQuery:
    """Runs a meter with a tick of ``every`` (None: once over what is there) and hands each batch's alerts to ``tell``.

    A batch that ``tell`` fails on is written to ``failed`` and the meter goes on: the
    state is kept by the query, so a broken screen or mailbox neither stops nor repeats
    it.
    """

    def guarded(batch: DataFrame, number: int) -> None:
        try:
            tell(batch, number)
        except Exception as e:  # whatever the receiver does wrong
            batch.withColumns({"batch": F.lit(number), "error": F.lit(f"{type(e).__name__}: {e}"[:500])}).write.mode("append").parquet(failed)

    writer = stream.writeStream.foreachBatch(guarded).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
