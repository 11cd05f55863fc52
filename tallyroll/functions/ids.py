"""Identifier tests and deterministic identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyroll.constants import BITMAP_SEGMENT_BITS, MESSAGE_ID_NAMESPACE, UUID_PATTERN


def is_uuid(value: Column) -> Column:
    """True or false; NULL for NULL."""
    return value.rlike(UUID_PATTERN)


_HEX_UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


def packed(text: Column) -> Column:
    """Text as bytes, a lower-case UUID by 16 of them, alone or after a letter or digit and a colon. Different texts give different bytes."""
    digits = lambda c: F.unhex(F.translate(c, "-", ""))
    tag = lambda n: F.lit(bytearray([n]))
    return F.when(text.rlike(f"\\A{_HEX_UUID}\\z"), F.concat(tag(1), digits(text))).when(
        text.rlike(f"\\A[0-9a-z]:{_HEX_UUID}\\z"), F.concat(tag(2), F.substring(text, 1, 1).cast("binary"), digits(F.substring(text, 3, 36)))
    ).when(text.isNotNull(), F.concat(tag(0), text.cast("binary")))


def unpacked(data: Column) -> Column:
    """The text that :func:`packed` made bytes of."""
    kind = F.hex(F.substring(data, 1, 1))

    def uuid(start: int) -> Column:
        h = F.lower(F.hex(F.substring(data, start, 16)))
        return F.concat_ws("-", *[F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])

    return F.when(kind == "01", uuid(2)).when(kind == "02", F.concat(F.substring(data, 2, 1).cast("string"), F.lit(":"), uuid(3))).when(
        data.isNotNull(), F.substring(data, 2, 1 << 30).cast("string"))


def uuid_from_name(name: Column) -> Column:
    """Name-based (MD5, version 3) UUID of a UTF-8 string, as text."""
    h = F.md5(name.cast("binary"))
    variant = F.substring(F.lit("89ab"), 1, 4)
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int")
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"),
        F.substring(h, 9, 4), F.lit("-3"),
        F.substring(h, 14, 3), F.lit("-"),
        F.substr(variant, nibble % 4 + 1, F.lit(1)), F.substring(h, 18, 3), F.lit("-"),
        F.substring(h, 21, 12),
    )


def message_id(campaign_id: Column, entry_id: Column) -> Column:
    """Same stream entry, same id: campaign and entry are hashed together."""
    return uuid_from_name(
        F.concat(F.lit(MESSAGE_ID_NAMESPACE), campaign_id.cast("string"), F.lit(":"), entry_id)
    )


def bitmap_segment(user_id: Column) -> Column:
    return F.floor((user_id - 1) / F.lit(BITMAP_SEGMENT_BITS)).cast("long")


def bitmap_offset(user_id: Column) -> Column:
    return F.pmod(user_id - 1, F.lit(BITMAP_SEGMENT_BITS)).cast("long")
