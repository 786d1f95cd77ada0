import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.operators import flatten as X

leaf = st.none() | st.booleans() | st.integers(-9, 9) | st.text("ab{}[]\" ", max_size=4)
tree = st.recursive(leaf, lambda s: st.lists(s, max_size=3) | st.dictionaries(st.sampled_from(["a", "b.c", "d[0]", "e", ""]), s, max_size=3), max_leaves=12)


def brute(v, path="", parent="", top=True):
    if isinstance(v, str):
        s = v.strip(" \t\r\n")
        try:
            j = json.loads(s) if s[:1] in "{[" and s else None
        except ValueError:
            j = None
        if isinstance(j, dict | list):
            yield from brute(j, path, parent, top)
    elif isinstance(v, dict):
        if not top:
            yield path, parent
        for k, x in v.items():
            yield from brute(x, f"{path}.{k}" if path else k, path, False)
    elif isinstance(v, list):
        for i, x in enumerate(v):
            yield from brute(x, f"{path}[{i}]", parent, False)


def nodes(text):
    """The objects of the triples, as ``objects`` takes them from the table."""
    return [*dict.fromkeys((n, p) for t, n, p, f, i, k, _ in X.triples(text) if n or t == f == "" and i == -1 and k == "object")]


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.sampled_from(["a", "b.c", "e"]), tree, max_size=3) | st.lists(tree, max_size=3))
def test_objects(v):
    want = set(brute(v))
    for text in (json.dumps(v), json.dumps(json.dumps(v)), f" {json.dumps(v, indent=1)}\n"):
        got = nodes(text)
        assert len(got) == len(set(got)) and set(got) == want


@settings(max_examples=150, deadline=None)
@given(tree)
def test_deep_writer_is_a_json_writer(v):
    from unittest import mock

    real = json.dumps
    with mock.patch.object(X.json, "dumps", lambda x, **k: real(x, **k) if not x or not isinstance(x, dict | list) else (_ for _ in ()).throw(RecursionError)):
        assert json.loads(X.to_json(v)) == v


@settings(max_examples=150, deadline=None)
@given(tree)
def test_stream_parser_is_a_json_parser(v):
    assert X._stream(json.dumps(v)) == v
    assert X._stream(json.dumps(v, indent=2)) == v


@pytest.mark.parametrize("bad", ["{", "[1,]", '{"a":}', '{"a" 1}', "[1 2]", "nul", "", "[1]]", '{"a":1,}', "[,1]", "01"])
def test_malformed(bad):
    with pytest.raises(ValueError):
        X._stream(bad)
    assert nodes(bad) == [] and X.triples(bad) == []


def test_scalars_and_very_deep():
    for t in (None, "", "null", "5", '"text"', '{"a": NaN}', '"\\"{}\\""'):
        assert nodes(t) == []
    deep = '{"a":' * 20000 + "1" + "}" * 20000
    got = nodes(deep)
    assert len(got) == 19999 and ("a", "") in got
    assert nodes('{"a": "{}", "b": "x{}"}') == [("a", "")]


def test_tables(spark):
    p = json.dumps({"id": 7, "tags": ["x", None, "y"], "git": {"remotes": [{"u": "a", "n": None}, {"u": "b"}], "e": {}}, "flag": True})
    df = spark.createDataFrame([(1, p, "clash"), (2, None, ""), (3, "[]", "")], "record_id bigint, payload string, node_path string")
    t = X.path_triples(df).cache()
    cat = {(r.table_path, r.field): r.kinds for r in X.table_catalogue(t).collect()}
    assert cat["git.remotes[]", "u"] == ["string"] and cat["", "tags"] == ["array", "null", "string"]
    rows = sorted((tuple(r) for r in X.pivot_table(t, "git.remotes[]", ["u", "n"]).collect()), key=lambda r: r[1])
    assert rows == [(1, "git.remotes[0]", "git", "a", None), (1, "git.remotes[1]", "git", "b", None)]
    top = X.pivot_table(t, "", ["id", "tags", "flag"]).where("record_id = 1").collect()[0]
    assert (top.id, top.tags, top.flag) == ("7", "x\ny", "true")
    assert {r.node_path for r in X.objects(t).collect()} == {"git", "git.remotes[0]", "git.remotes[1]", "git.e"}
    assert X.objects(X.path_triples(df.where("false"))).count() == 0
