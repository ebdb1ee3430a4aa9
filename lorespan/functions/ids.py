"""Deterministic identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _shaped(hexes: Column, version: str) -> Column:
    """A 32-digit hash as a UUID of a version, with the variant bits set."""
    variant = F.lower(F.hex((F.conv(F.substring(hexes, 17, 1), 16, 10).cast("int") % 4 + 8).cast("long")))
    return F.concat(
        F.substring(hexes, 1, 8), F.lit("-"), F.substring(hexes, 9, 4), F.lit("-" + version), F.substring(hexes, 14, 3), F.lit("-"), variant, F.substring(hexes, 18, 3), F.lit("-"), F.substring(hexes, 21, 12)
    )


def stable_uuid(*parts: Column) -> Column:
    """First half of the SHA-256 of the parts, joined by bars, as a version 5 UUID; null parts as 'null'."""
    return _shaped(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]), 256), "5")


def name_uuid(*parts: Column) -> Column:
    """The MD5 of the parts, joined by bars, as a version 3 UUID."""
    return _shaped(F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])), "3")
