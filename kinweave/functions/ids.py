"""Deterministic ids: the same event always gets the same uuid text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

CANONICAL_UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def uuid_of(*parts: Column) -> Column:
    """md5 of the parts joined with '|', written 8-4-4-4-12."""
    digest = F.md5(F.concat_ws("|", *parts))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(digest, start, length) for start, length in cuts])


def canonical_id(text: Column) -> Column:
    """Lower-case form in which ids are compared."""
    return F.lower(text)


def is_canonical_id(text: Column) -> Column:
    """True for a well-formed lower-case uuid; false (never null) otherwise."""
    return F.coalesce(text.rlike(CANONICAL_UUID), F.lit(False))
