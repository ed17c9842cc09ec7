"""Reading of ISO 8601 instants and of identifiers, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date and time down to the second, a fraction and an offset being optional.
ISO_INSTANT = (
    r"^(2[0-9]{3})-([0-9]{2})-([0-9]{2})[T ]([0-9]{2}):([0-9]{2}):([0-5][0-9])"
    r"(?:[.,]([0-9]+))?(Z|[+-](?:[01][0-9]|2[0-3])(?::?[0-5][0-9])?)?$"
)


def _tail(ts: Column) -> tuple[Column, Column]:
    """What follows the second, which always ends at the 19th character: the digits of the fraction, and the offset with its sign."""
    tail = F.substring(ts, 20, 1_000_000)
    sign = F.greatest(F.instr(tail, "+"), F.instr(tail, "-"))
    digits = F.when(sign > 0, F.substr(tail, F.lit(1), sign - 1)).otherwise(tail)
    return F.translate(digits, ".,Z", ""), F.when(sign > 0, F.substr(tail, sign))


def instant_micros(ts: Column) -> Column:
    """Epoch microseconds of an ISO 8601 text, null where it is unreadable.

    A text without an offset is UTC whatever the session's zone is. Digits of the
    fraction beyond the sixth don't count here (see ``instant_tail``). The pattern is
    tried once; the parts stand at fixed places.
    """
    whole = lambda at, n: F.substring(ts, at, n).try_cast("int")
    local = F.unix_micros(F.try_make_timestamp(whole(1, 4), whole(6, 2), whole(9, 2), whole(12, 2), whole(15, 2), whole(18, 2).cast("decimal(16,6)"), F.lit("UTC")))
    digits, zone = _tail(ts)
    fraction = F.rpad(F.substring(digits, 1, 6), 6, "0").try_cast("bigint")
    minutes = F.substring(zone, 2, 2).try_cast("int") * 60 + F.coalesce(F.right(F.replace(zone, F.lit(":"), F.lit("")), F.lit(2)).try_cast("int"), F.lit(0)) * F.when(F.length(zone) > 3, 1).otherwise(0)
    offset = F.coalesce(F.when(zone.startswith("-"), -minutes).otherwise(minutes), F.lit(0))
    return F.when(ts.rlike(ISO_INSTANT), local + F.coalesce(fraction, F.lit(0)) - offset.cast("bigint") * 60_000_000)


def instant_tail(ts: Column) -> Column:
    """The fraction's digits from the seventh on, without trailing zeros: orders instants within a microsecond."""
    return F.rtrim(F.substring(_tail(ts)[0], 7, 1_000_000), F.lit("0"))


#: All characters that Unicode, or Python, counts as white space.
WHITE_SPACE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def trimmed(text: Column) -> Column:
    """The text without surrounding white space, null where nothing is left."""
    bare = F.btrim(text, F.lit(WHITE_SPACE))
    return F.when(bare != "", bare)


def is_blank(text: Column) -> Column:
    return trimmed(text).isNull()
