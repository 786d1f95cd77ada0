import json

import pyarrow.parquet as pq

from strandline.operators import flatten as X
from strandline.plans import problems
from test_flatten import brute as walk


def frame(spark, *payloads):
    return spark.createDataFrame([(i, p if isinstance(p, str | None) else json.dumps(p)) for i, p in enumerate(payloads)], "record_id bigint, payload string")


def loads(text):
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        return None


def test_objects_are_the_ancestors_of_the_triples(spark, data):
    odd = [{"": {"": {"a": [[{}], {"b": "{}"}]}}}, [[{"a": 1}], "{\"x\": []}"], {}, [], {"": [{}]}, {"": []}, {"": None}, {"a.b": {}, "a": {"b": {}}}, "[", None, "3"]
    texts = [p if isinstance(p, str | None) else json.dumps(p) for p in odd]
    brute = lambda t: [] if loads(t) is None else set(walk(loads(t)))
    want = sorted({(i, *n) for i, t in enumerate(texts) for n in brute(t)})
    assert sorted(map(tuple, X.objects(X.path_triples(frame(spark, *odd))).collect())) == want
    rows = pq.read_table(f"{data}/rollout_records.parquet", columns=["record_id", "payload"]).to_pylist()
    want = sorted((r["record_id"], *n) for r in rows for n in brute(r["payload"]))
    assert sorted(map(tuple, problems.p3_found(spark, data).collect())) == want


def test_every_group_with_all_its_fields(spark):
    r = frame(spark, {"a": [{"x": 1, "y": None}, {"z": ["p", "q"], "o": {"k": True}}], "e": {}}, {"s": "{\"t\": \"u\"}"})
    got = {(x.record_id, x.table_path, x.node_path, x.parent_path): x.fields for x in X.flat_tables(X.path_triples(r)).collect()}
    assert got == {
        (0, "", "", ""): {}, (0, "a[]", "a[0]", ""): {"x": "1"}, (0, "a[]", "a[1]", ""): {"z": "p\nq"}, (0, "a[].o", "a[1].o", "a[1]"): {"k": "true"},
        (0, "e", "e", ""): {}, (1, "", "", ""): {}, (1, "s", "s", ""): {"t": "u"},
    }
