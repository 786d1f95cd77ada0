"""Mixing sources to target weights along a training curriculum.

Each source has a weight schedule over training time t in [0, 1], piecewise linear with weights that sum to 1
at every t and integrate to the target share. The integral is the source's cumulative token demand; a copy of
a document whose tokens start at c in its source gets the position where that demand reaches the middle of the
copy, by the closed inverse of the integral. Sorting by position by range gives the training order.

The tokens before a document in its source come from prefix sums in two steps (within hash buckets, then over
bucket totals), so a source with most of the rows is never sorted in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.llm.tokenizer import count_tokens
from strandline.session import cut

#: Documents that one bucket of a source holds on average.
BUCKET = 20_000
#: Exponent that flattens the shares at the start of training.
TEMPER = 0.7


def clean_source(c: Column) -> Column:
    """A source in one spelling: lower case, its words joined by ``_`` whatever stood between them (blanks, hyphens, underscores)."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), r"(?U)[\s_\p{Pd}]+", "_"))


def default_schedule(shares: dict[str, float]) -> dict[str, list[tuple[float, float]]]:
    """Knots (t, weight) by source: from flattened shares at the start, straight through the target in the middle, to their mirror image."""
    total = sum(s**TEMPER for s in shares.values())
    soft = {k: s**TEMPER / total for k, s in shares.items()}
    blend = min([1.0, *(s / (soft[k] - s) for k, s in shares.items() if soft[k] > 2 * s)])
    start = {k: s + blend * (soft[k] - s) for k, s in shares.items()}
    return {k: [(0.0, start[k]), (1.0, 2 * s - start[k])] for k, s in shares.items()}


def plan(available: dict[str, int], targets: dict[str, tuple[float, int]]) -> tuple[dict[str, float], float]:
    """(shares, total): the shares of the targets that have tokens, scaled to sum to 1, and the most tokens at which each is met within its repeats."""
    stocked = {k: s for k, (s, _) in targets.items() if available.get(k)}
    whole = sum(stocked.values())
    shares = {k: s / whole for k, s in stocked.items()}
    return shares, min((available[k] * targets[k][1] / s for k, s in shares.items()), default=0.0)


def _targets(mix_targets: DataFrame) -> dict[str, tuple[float, int]]:
    """The targets are a setting: one row a source, read by the driver. Shares of a source named twice add up; null and non-positive shares are none."""
    rows = mix_targets.select(clean_source(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null and target_share > 0")
    return {r[0]: (float(r[1]), int(r[2])) for r in rows.groupBy("source").agg(F.sum("target_share"), F.greatest(F.max(F.coalesce("max_repeats", F.lit(1))), F.lit(1))).collect()}


def token_counts(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens) with sources in clean spelling; documents without tokens or source are left out."""
    rows = documents.select("doc_id", clean_source(F.col("source")).alias("source"), "text").where("source is not null and text is not null")
    return count_tokens(rows, ["doc_id", "source"], path=path).where("n_tokens > 0")


def mix(documents: DataFrame, mix_targets: DataFrame, schedule: dict[str, list[tuple[float, float]]] | None = None, total_tokens: float | None = None, path: str | None = None) -> DataFrame:
    """(position, doc_id, source, pass, n_tokens): the mixture in training order.

    ``total_tokens`` is by default the most at which every stocked target reaches its share within max_repeats;
    a larger value lets scarce sources end below their share. ``pass`` counts the uses of a document from 1 and
    never exceeds max_repeats. A target without documents gets nothing and the others keep their proportions.
    Sources without a target stay out. A source ends within half a document of its demand.
    """
    spark = documents.sparkSession
    targets = _targets(mix_targets)
    counts = cut(token_counts(documents, path).where(F.col("source").isin(sorted(targets))))
    per_source = {r[0]: (int(r[1]), int(r[2])) for r in counts.groupBy("source").agg(F.sum("n_tokens"), F.count("*")).collect()}
    shares, total = plan({k: v[0] for k, v in per_source.items()}, targets)
    total = float(total_tokens or total)
    knots = schedule or default_schedule(shares)
    settings, curve = [], []
    for k, s in shares.items():
        tokens, docs = per_source[k]
        demand = min(s * total, float(tokens * targets[k][1]))
        settings.append((k, tokens, demand, math.ceil(demand / tokens), max(1, docs // BUCKET)))
        area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots[k], knots[k][1:]))
        done = 0.0
        for a, b in zip(knots[k], knots[k][1:]):
            part = (b[0] - a[0]) * (a[1] + b[1]) / 2 / area * demand
            curve.append((k, done, done + part, a[0], a[1] / area * demand, (b[1] - a[1]) / (b[0] - a[0]) / area * demand))
            done += part
    setting = spark.createDataFrame(settings, "source string, tokens bigint, demand double, passes int, buckets int")
    curves = spark.createDataFrame(curve, "source string, c0 double, c1 double, t0 double, w double, slope double")
    spread = counts.join(F.broadcast(setting), "source").withColumn("h", F.xxhash64("doc_id")).withColumn("b", F.pmod("h", "buckets"))
    before = Window.partitionBy("source", "b").orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    inner = spread.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    totals = spread.groupBy("source", "b").agg(F.sum("n_tokens").alias("t"))
    totals = totals.withColumn("base", F.coalesce(F.sum("t").over(Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("t")
    copies = inner.join(totals, ["source", "b"]).withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("passes"))))
    middle = (F.col("pass") - 1) * F.col("tokens") + F.col("base") + F.col("before") + F.col("n_tokens") / 2
    kept = copies.withColumn("c", middle.cast("double")).where("c < demand").join(F.broadcast(curves), "source").where("c >= c0 and c < c1")
    q = F.col("c") - F.col("c0")
    root = F.sqrt(F.greatest(F.col("w") * F.col("w") + 2 * F.col("slope") * q, F.lit(0.0)))
    t = F.col("t0") + F.when(q > 0, 2 * q / (F.col("w") + root)).otherwise(0.0)
    return kept.select(t.alias("position"), "doc_id", "source", "pass", "n_tokens").orderBy("position", "doc_id", "pass")


def reached(mixture: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, reached_share, tokens, uses, documents, most_uses): a row for each target, with zeros where it has no documents."""
    by_doc = mixture.groupBy("source", "doc_id").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("uses"))
    got = by_doc.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("uses").alias("uses"), F.count("*").alias("documents"), F.max("uses").alias("most_uses"))
    targets = mix_targets.select(clean_source(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null and target_share > 0")
    targets = targets.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    rows = targets.join(got, "source", "left").fillna(0, ["tokens", "uses", "documents", "most_uses"])
    return rows.withColumn("reached_share", F.coalesce(F.round(F.try_divide("tokens", F.sum("tokens").over(Window.partitionBy())), 6), F.lit(0.0))).select("source", "target_share", "max_repeats", "reached_share", "tokens", "uses", "documents", "most_uses")
