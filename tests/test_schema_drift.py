import itertools
import json
import random

from strandline.operators import schema_drift as S

CANON = [("k", "type", "string", True), ("k", "p", "object", True), ("k", "p.total_tokens", "integer", True), ("k", "p.note", "string", False), ("k", "p.meta", "object", True), ("k", "p.meta.turn_id", "string", True), ("k", "p.items", "array", True), ("k", "p.items[].text", "string", True)]
BASE = {"type": "k", "p": {"total_tokens": 5, "note": "n", "meta": {"turn_id": "t"}, "items": [{"text": "a"}, {"text": "b"}]}}


def line(**change):
    d = json.loads(json.dumps(BASE))
    for path, v in change.items():
        *up, last = path.split("__")
        at = d
        for k in up:
            at = at[k]
        if v is ...:
            at.pop(last, None)
        else:
            at[last] = v
    return json.dumps(d)


def changes(spark, files, extra=True):
    rows = [(i, f, n, x, "clash") for f, ls in files.items() for n, (i, x) in enumerate(zip(itertools.count(1), ls))]
    df = spark.createDataFrame(rows, "line_id bigint, file_path string, line_no int, line string, tree string")
    canon = spark.createDataFrame(CANON, "record_kind string, field_path string, json_type string, is_required boolean")
    sc = S.scripts(df, canon).cache()
    out = {}
    for r in S.changes(sc, canon).collect():
        out.setdefault(r.file_path, set()).add((r.field_path, r.change_kind))
    return out, sc, df, canon


def test_each_kind_of_change(spark):
    plain = [line(), line(p__note=...), line(p__total_tokens=None)]
    files = {
        "same": [*plain, '{"type": "k", "p": {', "", None, '"x"', '{"type": "other", "z": 1}'],
        "added": [line(p__extra=1), line(p__extra={"in": 2})],
        "item": [line(p__items=[{"text": "a", "lang": "en"}])],
        "renamed": [line(), line(p__total_tokens=..., p__TotalTokens=5)],
        "both": [line(p__total_tokens=..., p__tokens_total="5")],
        "removed": [line(p__total_tokens=...)] * 2,
        "retyped": [line(p__total_tokens=5.5), line(), line(p__meta=[{"turn_id": "t"}])],
        "inner": [line(p__meta={"turnId": "t"})],
        "struct": [line(p__meta=..., p__passthrough={"turn_id": "t"})],
        "other": [line(p__extra=1, p__note=...)],
        "gone": [line(p__total_tokens=..., p__extra=1)],
    }
    got, sc, df, canon = changes(spark, files)
    assert "same" not in got
    assert got["added"] == {("p.extra", "added")} and got["item"] == {("p.items[].lang", "added")}
    assert got["renamed"] == {("p.total_tokens", "renamed")}
    assert got["both"] == {("p.total_tokens", "renamed"), ("p.total_tokens", "type_changed")}
    assert got["removed"] == {("p.total_tokens", "removed")}
    assert got["retyped"] == {("p.total_tokens", "type_changed"), ("p.meta", "type_changed")}
    assert got["inner"] == {("p.meta.turn_id", "renamed")} and got["struct"] == {("p.meta", "renamed")}
    assert got["other"] == {("p.extra", "added")}
    assert got["gone"] == {("p.extra", "added"), ("p.total_tokens", "removed")}  # extra stands beside total_tokens elsewhere
    u = {(r.file_path, r.line_no): r for r in S.unified(df, canon, sc).collect()}
    assert len(u) == sum(len(v) for v in files.values()) - 5
    assert u["renamed", 1].p__total_tokens == 5 and u["both", 0].p__total_tokens == 5
    assert u["inner", 0].p__meta__turn_id == "t" and u["struct", 0].p__meta__turn_id == "t" and u["retyped", 0].p__total_tokens is None


def test_empty(spark):
    got, sc, df, canon = changes(spark, {"f": ["", "{"]})
    assert got == {} and S.unified(df, canon, sc).count() == 0


def test_assignment_is_optimal():
    rnd = random.Random(1)
    for _ in range(60):
        n, m = rnd.randint(1, 4), rnd.randint(4, 5)
        cost = [[rnd.random() for _ in range(m)] for _ in range(n)]
        got = sum(cost[i][j] for i, j in enumerate(S.assign(cost)))
        assert abs(got - min(sum(cost[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))) < 1e-9


def seen_of(canon, *records, share=0.0):
    seen, names = S.Seen(), S.vocabulary(canon)
    for r in records:
        for f in S.schema_facts(r, canon, names):
            seen.add(*f, share)
    return seen


def test_moves_are_priced():
    canon = S.canonical_trees([("k", "a", "object", True), ("k", "a.x", "string", True), ("k", "a.o", "string", False), ("k", "b", "object", True)])["k"]
    ops = lambda *r: {(e.op, e.path, e.to) for e in S.edit_script(seen_of(canon, *r), canon)}
    assert ops({"a": {}, "b": {"x": "1"}}) == {("move", "a.x", "b.x")} and ops({"a": {"x": "1"}, "b": {"o": "1"}}) == {("move", "a.o", "b.o")}
    assert ops({"a": {}, "b": {"q": 1}}) == {("delete", "a.x", ""), ("insert", "b.q", "")}  # too unlike to have moved
    assert ops({"a": {}, "b": {"xs": "1"}}) == {("move", "a.x", "b.xs")} and ops({"a": {}, "b": {}, "x": "1"}) == {("move", "a.x", "x")}
    assert S._coerce("16,496 tokens", "integer") == 16496 and S._coerce({"ms": 4}, "integer") == 4


def test_prices_decide(monkeypatch):
    rows = [("k", "p", "object", True), ("k", "p.total_tokens", "integer", True), ("k", "p.turn_id", "string", True), ("k", "p.note", "string", False)]
    canon = S.canonical_trees(rows)["k"]
    one = {"p": {"turnRef": "t", "tokens_total": 3, "memo": "m"}}
    ops = lambda share=0.0: {(e.op, e.path, e.to) for e in S.edit_script(seen_of(canon, one, share=share), canon)}
    want = {("rename", "p.total_tokens", "tokens_total"), ("rename", "p.turn_id", "turnRef"), ("insert", "p.memo", "")}
    assert ops() == want
    assert ("rename", "p.total_tokens", "tokens_total") not in ops(share=1.0)  # two names that always stand together are two fields
    monkeypatch.setattr(S, "rename_cost", lambda *a: 0.5)
    assert ops() != want


def test_moves_and_elements_in_one_table(spark):
    files = {"moved": [json.dumps({"type": "k", "p": {"total_tokens": 5, "meta": {}, "items": []}, "turn_id": "t"})], "elements": [line(p__items=[{"txt": "a", "lang": "en"}, {"text": "b"}], p__extra={"in": [1]})]}
    got, sc, df, canon = changes(spark, files)
    assert got["moved"] == {("turn_id", "added"), ("p.meta.turn_id", "removed")} and got["elements"] == {("p.items[].text", "renamed"), ("p.items[].lang", "added"), ("p.extra", "added")}
    u = {r.file_path: r for r in S.unified(df, canon, sc).collect()}
    assert u["moved"].p__meta__turn_id == "t" and u["moved"].other == {}
    assert json.loads(u["elements"].p__items) == [{"text": "a"}, {"text": "b"}] and u["elements"].other == {"p.extra": '{"in": [1]}', "p.items[].lang": '["en"]'}


def test_deep_line(spark):
    deep = "[" * 50_000 + "]" * 50_000
    files = {"deep": [line()[:-1] + f', "x": {deep}}}', line(p__note=...)]}
    got, sc, df, canon = changes(spark, files)
    assert got == {"deep": {("x", "added")}}
    assert {len(r.other.get("x", "")) for r in S.unified(df, canon, sc).collect()} == {0, 100_000}
