"""Stable identifiers made of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_ID_BYTES = 256


def encode_segment(c: Column) -> Column:
    """Escape the separator: % first, then :."""
    return F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit(":"), F.lit("%3A"))


def decode_segment(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("%3A"), F.lit(":")), F.lit("%25"), F.lit("%"))


def derive_id(kind: str, *columns: Column) -> Column:
    """``kind.v2:segment:...``, or null where a segment is null or the id exceeds 256 bytes."""
    made = F.concat(F.lit(f"{kind}.v2:"), *[x for i, c in enumerate(columns) for x in ([F.lit(":")] if i else []) + [encode_segment(c)]])
    return F.when(F.octet_length(made) <= MAX_ID_BYTES, made)


def id_segments(c: Column) -> Column:
    """The decoded segments of a derived id."""
    return F.transform(F.slice(F.split(c, ":"), 2, 1000), decode_segment)


def derive_relationship(family: str | Column, *columns: Column) -> Column:
    """``relationship.v2:family:`` and 32 hex digits of a SHA-256 over the joined segments."""
    return F.concat(F.lit("relationship.v2:"), F.lit(family), F.lit(":"), F.substring(F.sha2(F.concat_ws(":", *map(encode_segment, columns)), 256), 1, 32))


def deterministic_uuid(*columns: Column) -> Column:
    """A version-5-shaped UUID from a SHA-256 over the NUL-joined parts."""
    h = F.sha2(F.concat_ws("\x00", *columns), 256)
    variant = F.substring(F.lit("89ab"), 1, 4)
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"),
        F.element_at(F.split(variant, ""), nibble + 1), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
    )


def hash_prefix(prefix: str, digits: int, *columns: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x00", *columns), 256), 1, digits))
