"""Token usage: validity and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.records import USAGE

PARTS = USAGE[:-1]


def filled_total() -> Column:
    """The total, or input plus output where it is absent; null on overflow."""
    return F.coalesce("total_tokens", F.try_add("input_tokens", "output_tokens"))


def is_valid(total: Column, of: str = "") -> Column:
    """No negative part, a total that input and output add up to, no part above the total, cached within input, reasoning within output. Absent is not 0. ``of``: prefix of the parts' names."""
    part = {p: F.col(of + p) for p in PARTS}
    ok = total.isNotNull() & (total >= 0)
    for p in PARTS:
        ok = ok & F.coalesce((part[p] >= 0) & (part[p] <= total), F.lit(True))
    both = part["input_tokens"].isNotNull() & part["output_tokens"].isNotNull()
    ok = ok & F.when(both, F.coalesce(F.try_add(part["input_tokens"], part["output_tokens"]) == total, F.lit(False))).otherwise(True)
    within = lambda a, b: F.coalesce(part[a] <= part[b], F.lit(True))
    return F.coalesce(ok & within("cached_input_tokens", "input_tokens") & within("reasoning_output_tokens", "output_tokens"), F.lit(False))


def validated(usage: DataFrame) -> DataFrame:
    """``usage`` with ``total_tokens`` filled and ``valid``."""
    return usage.withColumn("total_tokens", filled_total()).withColumn("valid", is_valid(F.col("total_tokens")))


def usage_totals(rows: DataFrame, *keys: str) -> DataFrame:
    """Sums of usage by ``keys``: requests, the inclusive total (null where 64 bits do not hold it) and the parts, null where a row lacks the part. Parts are never added to the total again."""
    parts = [F.when(F.count_if(F.col(p).isNull()) == 0, F.try_sum(p)).alias(p) for p in PARTS]
    return rows.groupBy(*keys).agg(F.count("*").alias("requests"), *parts, F.try_sum("total_tokens").alias("total_tokens"))
