"""Parent-child links to full hierarchies.

Cycles are exposed by peeling; Euler tours over the remaining forest, ranked by pointer doubling,
give every node its root, depth and entry-exit interval, and the intervals give ancestors, descendants
and paths. Nodes are numbered once and all rounds are joins of numbers, of rows that are still under way
only, so no key is null and finished tours cost nothing more. Nothing is gathered on the driver but row counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions.ids import canonical_uuid
from strandline.session import cut, cut_counting, free

#: Siblings are chained inside hash buckets first, so a parent with most of the rows is spread over tasks: rows of a parent with all of them in one bucket.
SIBLINGS = 50_000
#: Two-sided peeling rounds before what is left is settled by doubling (a chain of n needs log n rounds, not n).
PEEL_ROUNDS = 4
#: Levels of the blocks that intervals are cut into, each 8 times the size of the one before. Blocks of the last level bound what one key of the join holds.
LEVELS = 5


def agent_links(rows: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """One row (id, parent) for each distinct id in canonical form; parent is null where no row names one.

    Should rows of one id name different parents, the smallest counts. Rows with a null or blank id are left out.
    """
    return (
        rows.select(canonical_uuid(F.col(id_col)).alias("id"), canonical_uuid(F.col(parent_col)).alias("parent"))
        .where(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.min("parent").alias("parent"))
    )


def cycle_members(edges: DataFrame, peel_rounds: int = PEEL_ROUNDS) -> DataFrame:
    """(id) of the nodes that lie on a cycle. ``edges``: (id, parent), one row an id, parent never null.

    Peeling takes away nodes without children and nodes whose parent is gone. If a round takes none, the rest
    are the cycles. After ``peel_rounds`` doubling settles what is left: rows whose pointer leaves the set are
    dropped; once a round drops none, all that is left leads into cycles, and the image of the 2^k-fold parent
    function is the cycle members as soon as 2^k reaches the row count.
    """
    core, size = edges, -1
    for _ in range(peel_rounds):
        inner = core.join(core.select(F.col("parent").alias("id")).distinct(), "id", "left_semi").join(core.select(F.col("id").alias("parent")), "parent", "left_semi")
        before, old = size, core
        core, size = cut_counting(inner.select("id", "parent"))
        if old is not edges:
            free(old)
        if size in (0, before):
            return core.select("id")
    jump, steps, before = core, 1, -1
    while size and not (size == before and steps >= size):
        before = size
        other = jump.select(F.col("id").alias("parent"), F.col("parent").alias("next"))
        old = jump
        jump, size = cut_counting(jump.join(other, "parent").select("id", F.col("next").alias("parent")))
        free(old)
        steps *= 2
    return jump.select(F.col("parent").alias("id")).distinct()


def _tour(forest: DataFrame, size: int) -> DataFrame:
    """The arcs of the tours of a forest of numbers: (arc, ptr, sum, n, last, head). Arc 2k enters node k and 2k+1 leaves it; ptr is the next arc, null at the end."""
    buckets = size // SIBLINGS + 1
    kids = forest.where("parent is not null").withColumn("b", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
    kids = kids.withColumn("sib", F.lead("id").over(Window.partitionBy("parent", "b").orderBy("id")))
    if buckets == 1:
        first = kids.groupBy("parent").agg(F.min("id").alias("child"))
        kids = kids.withColumn("after", F.lit(None).cast("bigint"))
    else:  # the last of a bucket is followed by the first of the parent's next one
        heads = kids.groupBy("parent", "b").agg(F.min("id").alias("head"))
        heads = heads.withColumn("after", F.lead("head").over(Window.partitionBy("parent").orderBy("b")))
        first = heads.groupBy("parent").agg(F.min_by("head", "b").alias("child"))
        ends = kids.where("sib is null").join(heads.select("parent", "b", "after"), ["parent", "b"])
        kids = kids.where("sib is not null").withColumn("after", F.lit(None).cast("bigint")).unionByName(ends.select("id", "parent", "b", "sib", "after"))
    none = F.lit(None).cast("bigint")
    nodes = kids.select("id", "parent", F.coalesce("sib", "after").alias("sib")).unionByName(forest.where("parent is null").select("id", "parent", none.alias("sib")))
    nodes = nodes.join(first.withColumnRenamed("parent", "id"), "id", "left")
    enter, leave = lambda c: 2 * F.col(c), lambda c: 2 * F.col(c) + 1
    up = F.coalesce(enter("sib"), leave("parent"))
    down = F.struct(enter("id").alias("arc"), F.coalesce(enter("child"), leave("id")).alias("ptr"), F.lit(1).alias("sum"), (F.col("parent").isNull()).alias("head"))
    back = F.struct(leave("id").alias("arc"), up.alias("ptr"), F.lit(-1).alias("sum"), F.lit(False).alias("head"))
    arcs = nodes.select(F.explode(F.array(down, back)).alias("x"))
    return arcs.select("x.arc", "x.ptr", F.col("x.sum").cast("bigint").alias("sum"), F.lit(1).cast("bigint").alias("n"), F.when(F.col("x.ptr").isNull(), F.col("x.arc")).alias("last"), "x.head")


def euler_tours(forest: DataFrame, size: int) -> DataFrame:
    """(node, root, depth, from_end, subtree) for each node of a forest of ``size`` numbered nodes.

    ``forest``: (id, parent) as bigint, parent null for roots, no cycles. ``depth`` is 0 at the root; ``from_end``
    counts the arcs from the node's entry to the end of its root's tour, so nodes of one root in falling
    ``from_end`` stand in pre-order; ``subtree`` is the number of its descendants. A node's descendants are
    the nodes of its root whose ``from_end`` lies in [from_end - 2 * subtree, from_end - 1].
    """
    # list ranking: after k rounds each arc knows the sums over its next 2^k arcs, and whether the tour ended there
    table, walking = cut_counting(_tour(forest, size), "ptr is not null")
    done, look, rows = [table.where("ptr is null")], [table.where("ptr is null")], 2 * size - walking
    while walking:
        on = table.where("ptr is not null")
        if rows > 4 * walking:  # arcs of finished tours are no more looked up
            heads = on.where("head").select((F.col("arc") + 1).alias("last"))
            kept, rows = cut_counting(_union(look).join(heads, "last", "left_semi").select(*table.columns))
            look = [kept]
        there = _union([*look, on]).select(F.col("arc").alias("ptr"), F.col("ptr").alias("p2"), F.col("sum").alias("s2"), F.col("n").alias("n2"), F.col("last").alias("l2"))
        before = walking
        table, walking = cut_counting(on.join(there, "ptr").select("arc", F.col("p2").alias("ptr"), (F.col("sum") + F.col("s2")).alias("sum"), (F.col("n") + F.col("n2")).alias("n"), F.col("l2").alias("last"), "head"), "ptr is not null")
        done.append(table.where("ptr is null"))
        look.append(done[-1])
        rows += before - walking
    down = F.col("arc") % 2 == 0
    return _union(done).groupBy(F.shiftright("arc", 1).alias("node"), F.shiftright("last", 1).alias("root")).agg(
        (-F.max(F.when(down, F.col("sum")))).cast("int").alias("depth"),
        F.max(F.when(down, F.col("n"))).alias("from_end"),
        ((F.max("n") - F.min("n") - 1) / 2).cast("bigint").alias("subtree"),
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def forest(links: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, root_id, depth, status, from_end, subtree, top) for each id of ``links`` and each of ``roots`` that is a parent.

    ``links``: (id, parent) as of :func:`agent_links`; ``roots``: (id), the ids that end a walk upward.
    status is ``rooted`` (depth counts the steps to root_id, 1 for its direct children), ``cycle`` (member of
    a cycle or below one) or ``missing`` (the walk ends at a null or unknown parent); in the last two cases
    root_id is the cycle member or topmost node reached and depth the steps to it. ``top`` marks the rows of
    ``roots``. Empty input gives no rows.
    """
    number = F.monotonically_increasing_id()  # of a written table: the numbers stay
    nodes, size = cut_counting(links.select("id", "parent", number.alias("num")))
    known = nodes.where("parent is not null").select("num", "parent").join(nodes.select(F.col("id").alias("parent"), F.col("num").alias("up")), "parent", "left")
    known = cut(known)
    edges = known.where("up is not null").select(F.col("num").alias("id"), F.col("up").alias("parent"))
    cyclic = cut(cycle_members(edges).distinct())
    ends = known.where("up is null").select("parent").distinct().join(roots.select(F.col("id").alias("parent")).distinct(), "parent", "left_semi")
    tops, extra = cut_counting(ends.select(F.col("parent").alias("id"), (-1 - number).alias("num")))
    inner = edges.join(cyclic, "id", "left_anti")
    outer = known.where("up is null").drop("up").join(tops.select(F.col("id").alias("parent"), F.col("num").alias("up")), "parent").select(F.col("num").alias("id"), F.col("up").alias("parent"))
    below = cut(inner.unionByName(outer))
    single = nodes.select(F.col("num").alias("id")).join(below.select("id"), "id", "left_anti").unionByName(tops.select(F.col("num").alias("id")))
    ranked = euler_tours(below.unionByName(single.select("id", F.lit(None).cast("bigint").alias("parent"))), size + extra)
    names = nodes.select(F.col("num").alias("node"), "id").unionByName(tops.select(F.col("num").alias("node"), "id"))
    tree = names.join(single.select(F.col("id").alias("node")), "node").select(F.col("node").alias("root"), F.col("id").alias("root_id")).join(cyclic.select(F.col("id").alias("root"), F.lit(True).alias("cyclic")), "root", "left")
    status = F.when(F.col("root") < 0, "rooted").when(F.col("cyclic"), "cycle").otherwise("missing")
    named = ranked.join(names, "node").join(tree, "root")
    return named.select("id", "root_id", "depth", status.alias("status"), "from_end", "subtree", (F.col("node") < 0).alias("top"))


def hierarchy(links: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, root_id, depth, status, from_end, subtree) for each id of ``links``; see :func:`forest`."""
    return forest(links, roots).where("not top").drop("top")


def ancestors(tree: DataFrame) -> DataFrame:
    """(ancestor_id, id, distance): one row for each pair of a node of a :func:`forest` and one of its descendants, from their intervals.

    An interval of entries is cut into blocks of a few sizes, each entry lies in one block of each size, and the
    two meet in exactly one: a join of equal blocks. Large intervals are many blocks of the last size, so no key is
    hot. The links between members of a cycle are none.
    """
    point, hi = F.col("from_end"), F.col("from_end")  # the interval is [from_end - 2 * subtree, from_end)
    lo = hi - 2 * F.col("subtree")
    start = [F.ceil(lo / 8**k).cast("bigint") for k in range(LEVELS)]
    stop = [F.floor(hi / 8**k).cast("bigint") for k in range(LEVELS)]
    seq = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
    at_level = lambda k: lambda q: F.struct(F.lit(k).alias("level"), q.alias("block"))
    blocks = []
    for k in range(LEVELS):
        own = seq(start[k], stop[k])
        if k + 1 < LEVELS:
            own = F.when(start[k + 1] < stop[k + 1], F.concat(seq(start[k], start[k + 1] * 8), seq(stop[k + 1] * 8, stop[k]))).otherwise(own)
        blocks.append(F.transform(own, at_level(k)))
    spans = tree.where("subtree > 0").select("root_id", "status", F.col("id").alias("ancestor_id"), F.col("depth").alias("above"), F.explode(F.concat(*blocks)).alias("x")).select("root_id", "ancestor_id", "above", "x.*")
    places = F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright(point, 3 * k).alias("block")) for k in range(LEVELS)))
    entries = tree.where("depth > 0").select("root_id", "id", "depth", F.explode(places).alias("x")).select("root_id", "id", "depth", "x.*")
    return spans.join(entries, ["root_id", "level", "block"]).select("ancestor_id", "id", (F.col("depth") - F.col("above")).alias("distance"))


def paths(tree: DataFrame) -> DataFrame:
    """(id, path, status): for each node of a :func:`forest` but its tops the ids from the root, the topmost node or the cycle member reached down to itself."""
    up = ancestors(tree).groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "ancestor_id"))).alias("a"))
    own = tree.where("not top").join(up, "id", "left")
    return own.select("id", F.when(F.col("a").isNull(), F.array("id")).otherwise(F.concat(F.transform("a", lambda x: x["ancestor_id"]), F.array("id"))).alias("path"), "status")
