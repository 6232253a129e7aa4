"""Conversion of report attributes to the published form."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schemas import CATEGORIES, NATIONALITIES

# The fields taken over, in the order of the published record.
COORDINATE_FIELDS = ("lat", "long")
BASIC_FIELDS = ("isNotTracked", "entityOffset", "sourceName")
GENERAL_FIELDS = (
    "speed", "elevation", "course", "nationality", "category", "pictureURL", "height", "nickname",
    "externalSystemID",
)


def copy_fields(source: Column, names) -> list[Column]:
    """The named fields of a struct, under their names (E5)."""
    return [source[name].alias(name) for name in names]


def converted(report: Column) -> Column:
    """The ten published attributes of a raw report; any further field is left out."""
    basic = report["basicAttributes"]
    coordinate = F.struct(*copy_fields(basic["coordinate"], COORDINATE_FIELDS))
    return F.struct(
        F.struct(coordinate.alias("coordinate"), *copy_fields(basic, BASIC_FIELDS)).alias("basicAttributes"),
        *copy_fields(report, GENERAL_FIELDS),
    )


def invalid_enum(report: Column) -> Column:
    """True where nationality or category is outside its symbols."""
    return ~F.coalesce(
        report["nationality"].isin(*NATIONALITIES) & report["category"].isin(*CATEGORIES), F.lit(False)
    )


def flat_attributes(attributes: Column, prefix: str = "") -> list[Column]:
    """All leaves of an attribute struct as scalar columns."""
    basic = attributes["basicAttributes"]
    leaves = [
        *copy_fields(basic["coordinate"], COORDINATE_FIELDS), *copy_fields(basic, BASIC_FIELDS),
        *copy_fields(attributes, GENERAL_FIELDS),
    ]
    names = [*COORDINATE_FIELDS, *BASIC_FIELDS, *GENERAL_FIELDS]
    return [leaf.alias(prefix + name) for leaf, name in zip(leaves, names)]
