"""Identifier normalisation as pure column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_uuid(c: Column) -> Column:
    """Lower-case 8-4-4-4-12 form of a UUID written with ``urn:uuid:``, braces, blanks, capitals or no hyphens.

    Text that holds no UUID comes out trimmed and lower-cased; blank text and null come out null.
    """
    bare = F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)[\s{}()\"']+", "")), "^(urn:)?(uuid:)?", "")
    # text in the form already, as nearly all is, costs one match; the rest is cleaned
    dashed = F.regexp_replace(F.regexp_replace(bare, "-", ""), "^([0-9a-f]{8})([0-9a-f]{4})([0-9a-f]{4})([0-9a-f]{4})([0-9a-f]{12})$", "$1-$2-$3-$4-$5")
    form = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\\z"
    return F.when(c.rlike(form), c).when(dashed.rlike(form), dashed).when(bare != "", bare)
