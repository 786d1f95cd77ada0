"""RFC 3339 instants with nanoseconds, as pure column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RFC3339 = r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d{1,9})?([Zz]|[+-]\d\d:\d\d)$"


def instant_ns(c: Column) -> Column:
    """Nanoseconds since the epoch, or null where the text is no RFC 3339 instant.

    Spark's own timestamps stop at microseconds, so seconds and fraction digits are read apart.
    """
    t = F.trim(c)
    seconds = F.unix_seconds(F.try_to_timestamp(F.regexp_replace(F.upper(t), r"\.\d+", "")))
    fraction = F.rpad(F.regexp_extract(t, r"\.(\d{1,9})", 1), 9, "0").cast("bigint")
    return F.when(t.rlike(RFC3339), seconds * F.lit(1_000_000_000) + fraction)
