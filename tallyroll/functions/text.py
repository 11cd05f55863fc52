"""Masking, truncation, labels and JSON details as built-in expressions."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Personal-data patterns and replacements.
EMAIL = r"([\w.+-]{1,3})[\w.+-]*(@[\w.-]+\.[A-Za-z]{2,})"
EMAIL_MASK = "$1****$2"
PHONE = r"\b(0\d{1,2})[-.\s]?(\d{3,4})[-.\s]?(\d{4})\b"
PHONE_MASK = "$1-****-$3"


# The same language as EMAIL; no step back can help before the "@", so none is tried.
_EMAIL_ONE_WAY = EMAIL.replace("{1,3})", "{1,3}+)").replace("*(@", "*+(@")


def mask_email(text: Column) -> Column:
    """Text without an "@" holds no address and is passed through."""
    return F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, _EMAIL_ONE_WAY, EMAIL_MASK)).otherwise(text)


def mask_phone(text: Column) -> Column:
    return F.regexp_replace(text, PHONE, PHONE_MASK)


def mask_text(text: Column) -> Column:
    """E-mail addresses first, phone numbers second, anywhere in free text."""
    return mask_phone(mask_email(text))


def mask_name(name: Column) -> Column:
    """Keep the first and last character; a blank name stays as it is."""
    t = F.trim(name)
    n = F.length(t)
    return (
        F.when(n == 0, name)
        .when(n == 1, t)
        .when(n == 2, F.concat(F.substring(t, 1, 1), F.lit("*")))
        .otherwise(F.concat(F.substring(t, 1, 1), F.repeat(F.lit("*"), n - 2), F.substr(t, n, F.lit(1))))
    )


def truncate(text: Column, size: int) -> Column:
    return F.substring(text, 1, size)


def label(code: Column, labels: Mapping, default: Column | None = None) -> Column:
    """Look ``code`` up in a small constant map."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(labels.items())])
    found = F.element_at(table, code)
    return found if default is None else F.coalesce(found, default)


def detail_json(**fields: Column) -> Column:
    """JSON object with NULL fields left out."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


def encode_detail(detail: Column) -> Column:
    """Map -> JSON text; a missing map becomes an empty object."""
    return F.coalesce(F.to_json(detail), F.lit("{}"))


def decode_detail(text: Column) -> Column:
    """JSON text -> string map; blank text becomes an empty map."""
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    return F.when(text.isNull() | (F.trim(text) == ""), empty).otherwise(
        F.from_json(text, "map<string,string>")
    )


def clamp(value: int | None, low: int, high: int, default: int) -> int:
    """Page size within ``low..high``; ``default`` when absent."""
    return default if value is None else max(low, min(high, value))
