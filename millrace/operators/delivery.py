"""Problem 1: messages delivered more than once.

The identifiers are nearly all of one width: a short prefix and 16 hexadecimal digits,
that is 64 bits. An exact quotient table keeps of such an identifier nothing but the
bits that its place in the table doesn't tell: a permutation of the 64 bits (a Feistel
network over Murmur3, invertible whatever its round function is) spreads them evenly,
the upper bits are the quotient, which names the shard, and all other bits are stored
as the remainder. As the permutation loses nothing, equal (quotient, remainder, prefix)
means equal identifiers: there are no false matches, unlike in a Bloom or cuckoo
filter. Identifiers of any other form have themselves as prefix and no bits.

Rows are inserted twice. Each task first inserts its own into a table of its own, some
hundred thousand at a time: of two rows with one identifier the lesser one is put out at
once as a copy and only the better one stays. What stays is sent to the shard that its
quotient names, where the remainders, sorted, are the shard's table and each identifier
is inserted once; copies already known are sent anywhere, for they need no table. So the
rows are read once and cross the network once, and of an identifier that holds a third of
all rows a task sends one row per hundred thousand to the shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.instants import instant_micros, instant_tail, trimmed
from ..session import ship

_HALF = 0xFFFFFFFF
_ROUNDS = 4


def permuted(high: Column, low: Column) -> tuple[Column, Column]:
    """A permutation of 64 bits, given and returned as two halves of 32."""
    for k in range(_ROUNDS):
        high, low = low, high.bitwiseXOR(F.hash(low, F.lit(k)).cast("bigint").bitwiseAND(F.lit(_HALF)))
    return high, low


#: Upper bits of the permuted identifier that name its shard.
SHARD_BITS = 12


def quotient_key(df: DataFrame, identifier: Column) -> DataFrame:
    """Adds ``_quotient`` (the shard), ``_remainder`` (the other bits) and ``_prefix``; an identifier of another form is its own prefix, with -1 for a remainder."""
    df = df.withColumn("_id", identifier)
    fixed = F.col("_id").rlike("[0-9a-f]{16}$")
    half = lambda at: F.conv(F.substring("_id", at, 8), 16, 10).try_cast("bigint")
    df = df.withColumns({"_h0": F.when(fixed, half(-16)), "_l0": F.when(fixed, half(-8)), "_prefix": F.when(fixed, F.substr("_id", F.lit(1), F.length("_id") - 16)).otherwise(F.col("_id"))})
    fixed = F.col("_h0").isNotNull()
    high, low = permuted(F.col("_h0"), F.col("_l0"))
    df = df.withColumns({"_h": high, "_l": low})
    other = F.pmod(F.hash("_prefix"), F.lit(1 << SHARD_BITS)).cast("bigint")
    rest = F.shiftleft(F.col("_h").bitwiseAND(F.lit((1 << (32 - SHARD_BITS)) - 1)), 32).bitwiseOR(F.col("_l"))
    return df.withColumns({"_quotient": F.when(fixed, F.shiftright("_h", 32 - SHARD_BITS)).otherwise(other), "_remainder": F.when(fixed, rest).otherwise(F.lit(-1).cast("bigint"))}).drop("_h0", "_l0", "_h", "_l", "_id")


#: Rows that a task inserts into its table at once.
CHUNK = 1 << 17
_ROW = "_quotient bigint, _remainder bigint, _prefix string, _less bigint, _us bigint, _tail string, row_id bigint, _copy boolean"
_ORDER = ["_less", "_us", "_tail", "row_id"]


def _candidates(calls: DataFrame) -> DataFrame:
    """Rows with an identifier, by its quotient and remainder, and what decides which of its rows is kept; unreadable times are the last instant there is."""
    identifier = F.coalesce(trimmed(F.col("message.id")), trimmed(F.col("request_id")))
    rows = calls.select("row_id", identifier.alias("_identifier"), F.col("message.usage.output_tokens").alias("_out"), F.col("ts").alias("_ts"))
    rows = quotient_key(rows.where("row_id IS NOT NULL AND _identifier IS NOT NULL"), F.col("_identifier"))
    micros = instant_micros(F.col("_ts"))
    return rows.select(
        "_quotient", "_remainder", "_prefix", (-F.coalesce("_out", F.lit(-1))).alias("_less"), F.coalesce(micros, F.lit((1 << 63) - 1)).alias("_us"),
        F.when(micros.isNotNull(), F.coalesce(instant_tail(F.col("_ts")), F.lit(""))).otherwise("").alias("_tail"), "row_id",
    )


def _insert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's own table: its rows sorted by remainder, each marked as a copy if the one before has the same identifier."""

    def flushed(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        keys = ["_remainder", "_quotient", "_prefix"]
        t = t.take(pc.sort_indices(t, sort_keys=[(k, "ascending") for k in (*keys, *_ORDER)])).combine_chunks()
        same = pa.array([True] * (len(t) - 1))
        for k in keys:
            same = pc.and_(same, pc.equal(t[k].slice(1), t[k].slice(0, len(t) - 1)))
        copy = pa.concat_arrays([pa.array([False]), *(same.chunks if isinstance(same, pa.ChunkedArray) else [same])])
        return t.append_column("_copy", copy).to_batches()

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= CHUNK:
            yield from flushed(held)
            held, n = [], 0
    if held:
        yield from flushed(held)


def inserted(calls: DataFrame) -> DataFrame:
    """``row_id``, ``copy``: each row with an identifier, and whether another row of it is kept."""
    ship(calls.sparkSession)
    local = _candidates(calls).mapInArrow(_insert, _ROW)
    shards = 1 << SHARD_BITS
    shard = F.when(F.col("_copy"), F.pmod(F.xxhash64("row_id"), F.lit(shards))).otherwise(F.col("_quotient"))
    sharded = local.withColumn("_shard", shard).repartition("_shard")
    table = Window.partitionBy("_shard", "_remainder", "_prefix", "_copy").orderBy(*_ORDER)
    return sharded.select("row_id", (F.col("_copy") | (F.row_number().over(table) > 1)).alias("copy"))


def surplus_rows(calls: DataFrame) -> DataFrame:
    """``row_id`` of each row that is a later, shorter or repeated copy of another.

    Null or blank identifiers have no copies; a row without ``row_id`` is no row; null
    ``output_tokens`` are below 0; unreadable times come last; an empty table gives no
    rows; columns not named here play no part. ``row_id`` is unique; rows that share one
    and an identifier are copies of each other like any, so that their id is surplus.
    """
    return inserted(calls).where("copy").select("row_id")


def delivered_once(calls: DataFrame) -> DataFrame:
    """``calls`` with all its columns and exactly one copy of each message; rows without identifier stay, and rows without ``row_id``, which can't be told apart."""
    return calls.join(surplus_rows(calls), "row_id", "left_anti")
