"""Kind and size of pictures from the first bytes of their files, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a file that its kind and size are in.
HEAD = 30


def _byte(head: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(head, at + 1, 1)), 16, 10).cast("long")


def _number(head: Column, places: range) -> Column:
    """The bytes at these places, the most significant one first."""
    return reduce(lambda total, at: total * 256 + _byte(head, at), places[1:], _byte(head, places[0]))


def _is(head: Column, at: int, text: bytes) -> Column:
    return F.substring(head, at + 1, len(text)) == F.lit(bytearray(text))


def _little(head: Column, at: int, n: int) -> Column:
    return _number(head, range(at + n - 1, at - 1, -1))


def picture_size(content: Column) -> Column:
    """struct(kind, width, height) of PNG and WebP files, by the formats' fixed places; null for all else and where the
    beginning is cut off. Of the bytes only the first HEAD are looked at."""
    head = F.substring(content, 1, HEAD)
    size = lambda kind, width, height: F.struct(F.lit(kind).alias("kind"), width.cast("int").alias("width"), height.cast("int").alias("height"))
    webp = lambda chunk: _is(head, 0, b"RIFF") & _is(head, 8, b"WEBP" + chunk) & (F.octet_length(head) == HEAD)
    packed = _little(head, 21, 4)
    return (
        F.when(_is(head, 0, b"\x89PNG\r\n\x1a\n") & _is(head, 12, b"IHDR") & (F.octet_length(head) >= 24), size("png", _number(head, range(16, 20)), _number(head, range(20, 24))))
        .when(webp(b"VP8 ") & _is(head, 23, b"\x9d\x01\x2a"), size("webp", _little(head, 26, 2) % 16384, _little(head, 28, 2) % 16384))
        .when(webp(b"VP8L") & _is(head, 20, b"\x2f"), size("webp", packed % 16384 + 1, F.floor(packed / 16384) % 16384 + 1))
        .when(webp(b"VP8X"), size("webp", _little(head, 24, 3) + 1, _little(head, 27, 3) + 1))
    )
