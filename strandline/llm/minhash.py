"""Clusters of near-equal short texts by verified MinHash.

Texts are compared by their word shingles (five words; a shorter text is one shingle). Texts whose MinHash
signatures agree in a band meet in its bucket. A bucket is taken in blocks of bounded size: within a block each
text is held against the groups so far by exact Jaccard similarity and joins every one that has a text near enough,
or leads a new one. The leaders of a bucket of several blocks meet again in new blocks as long as that
halves them. This finds most clusters. It leaves out near texts of different blocks of which one only followed a
leader, and those that agree in no band (a chance of 0.0002 at similarity 0.8).

So the clusters are completed exactly. Of two near texts each has one of the other's among its rarest shingles,
as many as it may lack and one more. Texts of different clusters that share such a shingle are held against each
other, those of a frequent shingle by pairs of blocks, so that any two texts of the threshold are in one cluster.
No list of all pairs of a bucket is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.session import cut, cut_counting

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 16, 4
#: Texts of a bucket that are compared in one block on average.
BLOCK = 400


def shingles(words: Column) -> Column:
    """The distinct shingles of an array of words, hashed."""
    many = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (SHINGLE - 1), F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(words, i, SHINGLE), " ")))
    return F.array_distinct(many)


def _alike(s: set, other: set) -> bool:
    if min(len(s), len(other)) < SIMILARITY * max(len(s), len(other)):
        return False
    both = len(s & other)
    return both >= SIMILARITY * (len(s) + len(other) - both)


def _lead(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The links of each block: a text is held against one after the other of each group so far until one is near. A text near none leads a new group and is linked to itself."""
    for p in parts:
        out = []
        for band, texts in zip(p.band, p.texts):
            groups: list[list[tuple[str, set]]] = []
            for t in sorted(texts, key=lambda t: t["text"]):
                s = set(t["s"])
                near = [(g, name) for g in groups if (name := next((n for n, other in g if _alike(s, other)), None)) is not None]
                out += [(band, t["text"], name) for _, name in near] or [(band, t["text"], t["text"])]
                joined = [x for g, _ in near for x in g]
                groups = [g for g in groups if not any(g is n for n, _ in near)]
                groups.append([*joined, (t["text"], s)])
        yield pd.DataFrame(out, columns=["band", "text", "to"])


def _across(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs of clusters that near texts of two blocks, or of one block with itself (i = j), show to be one."""
    for p in parts:
        out = []
        for i, j, texts in zip(p.i, p.j, p.texts):
            sets = [(t["block"], t["cluster"], set(t["s"])) for t in texts]
            left, right = ([x for x in sets if x[0] == b] for b in (i, j))
            root = {c: c for _, c, _ in sets}

            def find(c: str) -> str:
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            for n, (_, a, s) in enumerate(left):
                for _, b, o in right[n + 1 :] if i == j else right:
                    if a != b and _alike(s, o) and find(a) != find(b):
                        out.append((a, b))
                        root[find(a)] = find(b)
        yield pd.DataFrame(out, columns=["text", "to"], dtype=object)


def _rarest(base: DataFrame) -> DataFrame:
    """(text, token): of each text the rarest shingles, one more than it may lack in a near text, of which near texts have one in common."""
    each = base.select("text", F.explode("s").alias("token"))
    uses = each.groupBy("token").agg(F.count("*").alias("uses"))
    ranked = each.join(uses, "token").groupBy("text").agg(F.array_sort(F.collect_list(F.struct("uses", "token"))).alias("x"))
    lacking = F.size("x") - F.ceil(SIMILARITY * F.size("x") - 1e-6).cast("int")
    return ranked.select("text", F.explode(F.slice("x", 1, lacking + 1)).alias("x")).where("x.uses > 1").select("text", "x.token")


def _left_out(base: DataFrame, label: DataFrame) -> DataFrame:
    """(text, to): pairs of clusters that have near texts, all of them up to what follows from others.

    Of a shingle the texts of its largest cluster and the others are in blocks of their own. Each block of others
    is held against every block, so the largest cluster is not compared with itself, however large it is.
    """
    shared = cut(_rarest(base).join(label, "text"))
    sizes = shared.groupBy("token", "cluster").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("token").agg(F.sum("n").alias("n"), F.max(F.struct("n", "cluster")).alias("main"), F.count("*").alias("clusters")).where("clusters > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("bigint")
    one = F.col("n") <= BLOCK
    sizes = sizes.select("token", F.col("main.cluster").alias("main"), F.when(one, 0).otherwise(blocks(F.col("main.n"))).alias("m"), F.when(one, 1).otherwise(blocks(F.col("n") - F.col("main.n"))).alias("r"))
    of_main = (F.col("m") > 0) & (F.col("cluster") == F.col("main"))
    placed = shared.join(sizes, "token").withColumn("block", F.when(of_main, F.pmod(F.xxhash64("text"), F.col("m"))).otherwise(F.col("m") + F.pmod(F.xxhash64("text"), F.col("r"))))
    against = F.sequence(F.when(of_main, F.col("m")).otherwise(F.lit(0).cast("bigint")), F.col("m") + F.col("r") - 1)
    pairs = placed.withColumn("other", F.explode(against)).select("token", "text", "cluster", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    tasks = pairs.join(base, "text").groupBy("token", "i", "j").agg(F.collect_list(F.struct("block", "cluster", "s")).alias("texts"))
    return tasks.select("i", "j", "texts").mapInPandas(_across, "text string, to string").distinct()


def _components(label: DataFrame, links: DataFrame) -> DataFrame:
    """(text, cluster): the smallest text that links lead to, from (text, cluster) with each text as its own cluster."""
    both = links.distinct()
    both = cut(both.unionByName(both.select(F.col("to").alias("text"), F.col("text").alias("to"))).distinct())
    while True:
        near = both.join(label.withColumnRenamed("text", "to"), "to").groupBy("text").agg(F.min("cluster").alias("least"))
        step, moved = cut_counting(label.join(near, "text", "left").select("text", F.least("cluster", F.coalesce("least", "cluster")).alias("cluster"), (F.col("least") < F.col("cluster")).alias("moved")), "moved")
        label = step.select("text", "cluster")
        if not moved:
            return label


def clusters(texts: DataFrame, key: str = "template") -> DataFrame:
    """(key, cluster): for each distinct text the smallest text of its cluster. Equal texts must be one row already."""
    base = cut(texts.select(F.col(key).alias("text"), shingles(F.split(F.col(key), " ")).alias("s")))
    hashed = lambda n: lambda x: F.xxhash64(x, F.lit(n))  # noqa: E731  (a second parameter of the inner one would be the index)
    signature = [F.array_min(F.transform("s", hashed(n))) for n in range(BANDS * ROWS)]
    bands = F.array(*(F.xxhash64(F.lit(b), *signature[b * ROWS : (b + 1) * ROWS]) for b in range(BANDS)))
    waiting = base.select("text", F.explode(bands).alias("band"))
    links, level, left = None, 0, None
    while True:
        sizes = waiting.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK))
        # blocks are drawn anew each round, so leaders of different blocks come to meet
        block = F.pmod(F.xxhash64("text", F.lit(level)), F.col("blocks"))
        met = waiting.join(sizes, "band").withColumn("block", block).join(base, "text")
        grouped = met.groupBy("band", "block", "blocks").agg(F.collect_list(F.struct("text", "s")).alias("texts"))
        led = grouped.select("band", "texts").mapInPandas(_lead, "band bigint, text string, to string")
        led = cut(led)
        links = led.where("text <> to").select("text", "to") if links is None else links.unionByName(led.where("text <> to").select("text", "to"))
        before = left
        waiting, left = cut_counting(led.where("text = to").select("text", "band").join(sizes.where("blocks > 1").select("band"), "band", "left_semi"))
        level += 1
        if not left or before is not None and 2 * left > before:
            break
    label = _components(base.select("text", F.col("text").alias("cluster")), links)
    missing, n = cut_counting(_left_out(base, label))
    if n:
        whole = _components(label.select(F.col("cluster").alias("text")).distinct().select("text", F.col("text").alias("cluster")), missing)
        label = label.join(whole.select(F.col("text").alias("cluster"), F.col("cluster").alias("whole")), "cluster").select("text", F.col("whole").alias("cluster"))
    return label.select(F.col("text").alias(key), "cluster")
