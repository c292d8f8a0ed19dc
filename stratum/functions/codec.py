r"""Fixed-width encoding and its order.

A value is its UTF-8 bytes padded with NULs to the field's width. Order compares padded values byte by byte as
signed numbers: bytes from 0x80 sort below every ASCII byte and below the padding. `sort_key` maps a value to
a string that plain comparison sorts that way, so range filters on a stored key reach the file scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# translate() takes a NUL in its target as "delete", hence targets from U+0100 on.
_BYTES = "".join(chr(b) for b in range(256))
_FLIPPED = "".join(chr(0x100 + (b ^ 0x80)) for b in range(256))


def byte_length(c: Column) -> Column:
    return F.octet_length(F.encode(c, "UTF-8"))


def fits_width(c: Column, width: int) -> Column:
    return byte_length(c) <= width


def present(c: Column) -> Column:
    """Null becomes the empty string: relations have no nulls."""
    return F.coalesce(c, F.lit(""))


def null_marker(c: Column, marker: str = "\\N") -> Column:
    return F.when(c.isNull() | (c == marker), "").otherwise(c)


def to_fixed(c: Column, width: int) -> Column:
    """Padded bytes; an over-wide value is an error, never cut."""
    return F.when(fits_width(c, width), F.rpad(F.encode(c, "UTF-8"), width, F.lit(b"\x00"))).otherwise(F.raise_error(F.concat(F.lit(f"value exceeds {width} UTF-8 bytes: "), byte_length(c).cast("string"))))


def from_fixed(c: Column) -> Column:
    """The text of padded bytes, without trailing NULs."""
    return F.regexp_replace(F.decode(c, "UTF-8"), "\\x00+$", "")


def sort_key(c: Column, width: int) -> Column:
    """Apply after the width check: longer values would be cut. Only the value is translated, its padding is added
    as it would come out."""
    own = F.decode(F.substring(F.encode(c, "UTF-8"), 1, width), "ISO-8859-1")
    return F.rpad(F.translate(own, _BYTES, _FLIPPED), width, _FLIPPED[0] * max(1, width))


def plain(c: Column, width: int) -> Column:
    """ASCII without NULs that fits: among such values the signed order is that of the strings."""
    return (byte_length(c) == F.length(c)) & ~F.contains(c, F.lit("\0")) & (F.length(c) <= width)


def is_plain(value: str, width: int) -> bool:
    """The same of a value at hand."""
    return isinstance(value, str) and value.isascii() and "\0" not in value and len(value) <= width


def nanos_to_millis(c: Column) -> Column:
    return F.when(c >= 0, c / 1e6)


def mebibytes(c: Column) -> Column:
    return c / 1048576
