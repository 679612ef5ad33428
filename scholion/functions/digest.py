"""Digests, canonical JSON and identifiers made from content."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def canonical_json(columns: list[str]) -> Column:
    """Compact JSON of the columns in alphabetical order, nulls kept, non-ASCII as it is."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def content_digest(columns: list[str], volatile: tuple[str, ...] = ("created_at", "revision", "digest")) -> Column:
    """The digest of the columns' canonical JSON, without those that change when the content doesn't."""
    return digest(canonical_json([x for x in columns if x not in volatile]))


def uuid5(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """Version 5 UUIDs, as text."""
    hashed = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(hashed, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(hashed, 1, 8), F.substring(hashed, 9, 4), F.concat(F.lit("5"), F.substring(hashed, 14, 3)), F.concat(variant, F.substring(hashed, 18, 3)), F.substring(hashed, 21, 12))


def iso_millis(text: Column) -> Column:
    """Milliseconds since 1970 of a timestamp in text, or null."""
    return F.unix_millis(F.try_to_timestamp(text))


def date_key_valid(key: Column) -> Column:
    """Whether ``YYYY-MM-DD`` names a real day."""
    day = F.try_to_date(key, "yyyy-MM-dd")
    return key.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.coalesce(F.date_format(day, "yyyy-MM-dd") == key, F.lit(False))


def date_label(key: Column) -> Column:
    """``February 3`` for a day's key; null for none."""
    return F.when(date_key_valid(key), F.date_format(F.try_to_date(key, "yyyy-MM-dd"), "MMMM d"))


def greeting(hour: Column) -> Column:
    return F.when((hour >= 5) & (hour < 12), "morning").when((hour >= 12) & (hour < 17), "afternoon").when((hour >= 17) & (hour < 21), "evening").otherwise("night")


def clamped(value: Column, low: int, high: int, default: int) -> Column:
    return F.when(value.between(low, high), value).otherwise(F.lit(default))


def valid_on(day: Column, start: Column, end: Column) -> Column:
    """Whether a day lies within an interval that includes both ends; a null end is open."""
    return (start.isNull() | (start <= day)) & (end.isNull() | (day <= end))
