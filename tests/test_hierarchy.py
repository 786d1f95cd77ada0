import random

import pytest
from pyspark.sql import functions as F

from strandline.functions.ids import canonical_uuid
from strandline.operators import hierarchy as H


def walk(links, roots, i):
    seen, at, n = [], i, 0
    while True:
        if at in seen:
            return "cycle", at, [*reversed(seen[: seen.index(at) + 1])]
        seen.append(at)
        p = links[at]
        n += 1
        if p is None or p not in links and p not in roots:
            return "missing", at, [*reversed(seen)]
        if p not in links:
            return "rooted", p, [p, *reversed(seen)]
        at = p


def run(spark, links, roots):
    df = spark.createDataFrame([*links.items()], "id string, parent string")
    return df, H.forest(df, spark.createDataFrame([(r,) for r in roots], "id string")).cache()


@pytest.mark.parametrize("seed", range(3))
def test_against_walk(spark, seed):
    rnd = random.Random(seed)
    ids = [f"n{i}" for i in range(60)]
    roots = {"r0", "r1", "n3"}  # n3 is an agent too, so it ends no walk
    links = {i: rnd.choice([*ids, "r0", "r1", "r1", "r1", None, "x"]) for i in ids}
    df, got = run(spark, links, roots)
    rows = {r.id: r for r in got.where("not top").collect()}
    assert rows.keys() == links.keys()
    paths = {r.id: (r.path, r.status) for r in H.paths(got).collect()}
    pairs = [(r.ancestor_id, r.id, r.distance) for r in H.ancestors(got).collect()]
    desc = {*pairs}
    assert len(desc) == len(pairs)
    want = set()
    for i in ids:
        status, root, path = walk(links, roots, i)
        assert rows[i].status == status
        assert (rows[i].root_id, rows[i].depth, paths[i]) == (root, len(path) - 1, (path, status))
        want |= {(a, i, len(path) - 1 - k) for k, a in enumerate(path[:-1])}
    assert desc == want
    assert all(rows[i].subtree == sum(a == i for a, _, _ in want) for i in ids)


def test_long_chain_and_wide_parent(spark):
    chain = {f"c{i:04d}": f"c{i - 1:04d}" if i else "r" for i in range(300)}
    wide = {f"w{i}": "c0000" for i in range(700)}
    _, got = run(spark, chain | wide, {"r"})
    rows = {r.id: r for r in got.collect()}
    assert all(rows[f"c{i:04d}"].depth == i + 1 for i in range(300))
    assert rows["c0000"].subtree == 999 and rows["w5"].depth == 2
    pairs = {(r.ancestor_id, r.id): r.distance for r in H.ancestors(got).collect()}
    assert len(pairs) == 300 * 301 // 2 + 2 * 700 and pairs["r", "c0299"] == 300 and pairs["c0000", "w699"] == 1


def test_siblings_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(H, "SIBLINGS", 10)
    links = {f"w{i}": "r" for i in range(90)} | {f"x{i}": f"w{i % 7}" for i in range(30)}
    _, got = run(spark, links, {"r"})
    pairs = {(r.ancestor_id, r.id) for r in H.ancestors(got).collect()}
    assert pairs == {("r", i) for i in links} | {(p, i) for i, p in links.items()}


def test_intervals_give_descendants(spark):
    links = {"a": "r", "b": "a", "c": "a", "d": "b", "e": "r"}
    _, got = run(spark, links, {"r"})
    rows = {r.id: r for r in got.collect()}
    inside = lambda x, y: rows[y].from_end - 2 * rows[y].subtree - 1 < rows[x].from_end < rows[y].from_end
    assert {x for x in links if inside(x, "a")} == {"b", "c", "d"}


def test_empty_and_dirty_rows(spark):
    schema = "id string, parent_id string, parent string, depth int"
    assert H.agent_links(spark.createDataFrame([], schema)).count() == 0
    _, got = run(spark, {"x": None}, set())
    assert [(r.id, r.status) for r in got.collect()] == [("x", "missing")] and [tuple(r) for r in H.paths(got).collect()] == [("x", ["x"], "missing")]
    empty = spark.createDataFrame([], "id string, parent string")
    assert H.hierarchy(empty, spark.createDataFrame([], "id string")).count() == 0
    u = "0a1b2c3d-0000-1111-2222-333344445555"
    rows = [(u.upper(), None, "clash", 1), (f" urn:uuid:{u}", "", "clash", None), (u.replace("-", ""), f"{{{u}}}", None, 2), (None, u, None, 0), ("  ", u, None, 0)]
    assert [tuple(r) for r in H.agent_links(spark.createDataFrame(rows, schema)).collect()] == [(u, u)]
    assert H.cycle_members(spark.createDataFrame([(u, u)], "id string, parent string")).count() == 1
    _, loop = run(spark, {u: u}, {u})
    assert [(r.id, r.root_id, r.status) for r in loop.collect()] == [(u, u, "cycle")] and H.ancestors(loop).count() == 0


def test_canonical_uuid(spark):
    got = spark.createDataFrame([("Unknown",), (None,), (" ",), ("0a1b2c3d-0000-1111-2222-333344445555\n",)], "x string").select(canonical_uuid(F.col("x")).alias("y")).collect()
    assert [r.y for r in got] == ["unknown", None, None, "0a1b2c3d-0000-1111-2222-333344445555"]
