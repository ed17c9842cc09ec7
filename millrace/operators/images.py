"""Where the data of an image ends, read by the structure of its format."""

from __future__ import annotations

import struct
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

_BAD = -1


def _chunks(d: bytes, at: int, head: str, extra: int, last: bytes) -> int:
    """End of a sequence of (length, name, body) chunks that closes with one named ``last``."""
    while at + 8 + extra <= len(d):
        length, name = struct.unpack_from(head, d, at)
        at += 8 + length + extra
        if name == last:
            return at if at <= len(d) else _BAD
    return _BAD


def _boxes(d: bytes) -> int:
    at = 0
    while at + 8 <= len(d):
        size = int.from_bytes(d[at : at + 4], "big")
        if size == 0:
            return len(d)
        if size == 1:
            size = int.from_bytes(d[at + 8 : at + 16], "big")
        if size < 8:
            return _BAD
        at += size
    return at if at == len(d) else _BAD


def _icons(d: bytes) -> int:
    count = int.from_bytes(d[4:6], "little")
    if len(d) < 6 + 16 * count:
        return _BAD
    return max([6 + 16 * count, *(sum(struct.unpack_from("<II", d, 6 + 16 * k + 8)) for k in range(count))])


def _sized(d: bytes, at: int, more: int) -> int:
    n = int.from_bytes(d[at : at + 4], "little") + more
    return n + n % 2 if more else n or _BAD


def image_end(ending: str, d: bytes) -> int | None:
    """The offset at which an image ends, -1 if it is malformed, None if the content is of another kind than the ending says."""
    last = lambda mark: (k + len(mark)) if (k := d.rfind(mark)) >= 0 else _BAD
    kinds = {
        "png": (d.startswith(b"\x89PNG\r\n\x1a\n"), lambda: _chunks(d, 8, ">I4s", 4, b"IEND")),
        "jpg": (d.startswith(b"\xff\xd8\xff"), lambda: last(b"\xff\xd9")),
        "gif": (d.startswith((b"GIF87a", b"GIF89a")), lambda: last(b";")),
        "webp": (d.startswith(b"RIFF") and d[8:12] == b"WEBP", lambda: _sized(d, 4, 8)),
        "bmp": (d.startswith(b"BM"), lambda: _sized(d, 2, 0)),
        "ico": (d.startswith(b"\0\0\1\0") and len(d) >= 6, lambda: _icons(d)),
        "avif": (d[4:8] == b"ftyp" and d[8:12] in (b"avif", b"avis", b"mif1"), lambda: _boxes(d)),
    }
    fits, end = kinds.get("jpg" if ending == "jpeg" else ending, (False, None))
    if not fits:
        return None
    n = end()
    return n if n <= len(d) else _BAD


@lru_cache(maxsize=1)
def _udf():
    @pandas_udf("string")
    def status(ending: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([image_verdict(e, bytes(d)) if d is not None else None for e, d in zip(ending, data, strict=True)])

    return status


def image_verdict(ending: str, data: bytes) -> str:
    """'ok', 'mismatch', or 'polyglot:' and what is wrong: the structure, or bytes other than NUL after the end."""
    end = image_end(ending, data)
    if end is None:
        return "mismatch"
    if end < 0:
        return "polyglot:malformed image structure"
    rest = data[end:]
    return f"polyglot:{len(rest)} bytes after image end marker" if rest.strip(b"\0") else "ok"


def image_status(ending: Column, data: Column) -> Column:
    return _udf()(ending, data)
