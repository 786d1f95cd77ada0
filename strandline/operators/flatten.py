"""Deeply nested semi-structured records to related flat tables.

Each record is parsed once into path-ordinal-value triples; paths are grouped by their repeated ancestor
(the nearest enclosing object, array positions taken out), and each group is pivoted into one flat table
whose rows keep the path of their parent. The parse is one map over Arrow batches without a shuffle.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRIPLES = "table_path string, node_path string, parent_path string, field string, ordinal int, kind string, value string"
_TOKEN = re.compile(r'\s*(?:([{}\[\]:,])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)(?![\w.])|(true|false|null)(?!\w))')


def _no_constant(name: str) -> None:
    raise ValueError(name)


_decode = json.JSONDecoder(parse_constant=_no_constant).decode


def _stream(text: str) -> object:
    """Token by token parse with an own stack, for texts nested deeper than the library's recursion goes."""
    stack: list = []
    keys: list = []
    at, root, state, key = 0, None, "value", None
    done = False

    def put(v: object) -> None:
        nonlocal root, done, state
        if not stack:
            root, done = v, True
        elif isinstance(stack[-1], dict):
            stack[-1][keys[-1]] = v
        else:
            stack[-1].append(v)
        state = "after"

    end = len(text.rstrip(" \t\r\n"))
    while at < end:
        m = _TOKEN.match(text, at)
        if not m or done and not stack:
            raise ValueError("malformed")
        at = m.end()
        p, s, n, w = m.groups()
        if state in ("value", "first") and not (p and p in "]:,}"):
            if p:
                v: object = {} if p == "{" else []
                put(v)
                stack.append(v)
                keys.append(None)
                done = False
                state = "firstkey" if p == "{" else "first"
            elif s:
                put(json.loads(s, strict=False) if "\\" in s else s[1:-1])
            elif n:
                put(json.loads(n))
            else:
                put({"true": True, "false": False, "null": None}[w])
        elif state in ("key", "firstkey") and s:
            keys[-1], state = json.loads(s), "colon"
        elif state == "colon" and p == ":":
            state = "value"
        elif state == "after" and p == "," and stack:
            state = "key" if isinstance(stack[-1], dict) else "value"
        elif p in ("}", "]") and stack and isinstance(stack[-1], dict) == (p == "}") and state in ("after", "firstkey", "first"):
            stack.pop()
            keys.pop()
            state, done = "after", not stack
        else:
            raise ValueError("malformed")
    if not done or stack:
        raise ValueError("malformed")
    return root


def parse(text: str) -> object:
    """The JSON value of ``text``; ValueError if it is none. NaN and Infinity are none. Of repeated keys the last counts."""
    try:
        return _decode(text)
    except RecursionError:
        return _stream(text)


def to_json(v: object) -> str:
    """JSON text of a value, however deep it is nested."""
    try:
        return json.dumps(v, ensure_ascii=False)
    except RecursionError:
        out: list[str] = []
        stack: list = [(v, False)]
        while stack:
            x, raw = stack.pop()
            if raw:
                out.append(x)
            elif isinstance(x, dict | list) and x:
                out.append("{" if isinstance(x, dict) else "[")
                stack.append(("}" if isinstance(x, dict) else "]", True))
                items = [*x.items()] if isinstance(x, dict) else [*x]
                for n in range(len(items) - 1, -1, -1):
                    value = items[n][1] if isinstance(x, dict) else items[n]
                    stack.append((value, False))
                    stack.append(((", " if n else "") + (json.dumps(items[n][0], ensure_ascii=False) + ": " if isinstance(x, dict) else ""), True))
            else:
                out.append(json.dumps(x, ensure_ascii=False))
        return "".join(out)


def _embedded(text: str) -> object | None:
    """The object or array that a string is as a whole, else None."""
    s = text.strip(" \t\r\n")
    if len(s) > 1 and (s[0] == "{" and s[-1] == "}" or s[0] == "[" and s[-1] == "]"):
        try:
            return parse(s)
        except ValueError:
            return None
    return None


def _open(payload: str | None) -> object | None:
    """The object or array a payload holds, straight or as a JSON string of one; None if it is unreadable or a scalar."""
    if not payload:
        return None
    try:
        v = parse(payload)
    except ValueError:
        return None
    if isinstance(v, str):
        v = _embedded(v)
    return v if isinstance(v, dict | list) else None


def triples(payload: str | None) -> list[tuple]:
    """(table_path, node_path, parent_path, field, ordinal, kind, value) of each field of each object, the payload's too.

    ``ordinal`` is the place of an array element in its field, -1 outside arrays; ``value`` is text for scalars,
    null for JSON null, objects and arrays; ``kind`` is the JSON type. An empty object gives one row of kind ``empty``.
    """
    top = _open(payload)
    if top is None:
        return []
    out: list[tuple] = []
    stack: list = [(top, "", "", "")]
    while stack:
        obj, table, path, parent = stack.pop()
        if isinstance(obj, list):
            obj = {"": obj}
        if not obj:
            out.append((table, path, parent, "", -1, "empty", None))
        for k, v in obj.items():
            spread: list = [(v, "", -1)]
            while spread:
                e, at, i = spread.pop()
                if isinstance(e, str) and (j := _embedded(e)) is not None:
                    e = j
                here, group = f"{path}.{k}{at}" if path else f"{k}{at}", f"{table}.{k}" if table else k
                if isinstance(e, dict):
                    out.append((table, path, parent, k, i, "object", None))
                    stack.append((e, group + "[]" * at.count("["), here, path))
                elif isinstance(e, list):
                    out.append((table, path, parent, k, i, "array", None))
                    spread += [(x, f"{at}[{n}]", n) for n, x in reversed([*enumerate(e)])]
                else:
                    kind = "null" if e is None else "boolean" if isinstance(e, bool) else "string" if isinstance(e, str) else "number"
                    out.append((table, path, parent, k, i, kind, None if e is None else e if isinstance(e, str) else json.dumps(e)))
    return out


def path_triples(records: DataFrame, key: str = "record_id", payload: str = "payload") -> DataFrame:
    """The triples of every payload, keyed by ``key``."""
    kind = dict(records.dtypes)[key]
    names = [key, *(x.split(" ")[0] for x in TRIPLES.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 4 + [pa.int32(), pa.string(), pa.string()]
        for b in batches:
            rows = [(i, *t) for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for t in triples(text)]
            cols = [*zip(*rows)] or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [b.schema.field(0).type, *kinds])], names=names)

    return records.select(key, payload).mapInArrow(run, f"`{key}` {kind}, {TRIPLES}")


def table_catalogue(triples_df: DataFrame) -> DataFrame:
    """(table_path, field, kinds, rows): the flat tables there are and their columns."""
    return triples_df.where("kind <> 'empty'").groupBy("table_path", "field").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.count("*").alias("rows"))


def pivot_table(triples_df: DataFrame, table_path: str, fields: list[str], key: str = "record_id") -> DataFrame:
    """The flat table of one path group: a row for each object, its scalar ``fields`` as text, keyed by (key, node_path) and linked by parent_path.

    A field that holds an array of scalars comes out as the JSON-free text of its elements joined by line feeds in their order.
    """
    rows = triples_df.where(F.col("table_path") == table_path)
    part = lambda f: F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("field") == f) & F.col("value").isNotNull(), F.struct("ordinal", "value")))), lambda x: x["value"]), "\n")
    return rows.groupBy(key, "node_path", "parent_path").agg(*(F.when(F.max(F.when((F.col("field") == f) & F.col("value").isNotNull(), F.lit(1))) == 1, part(f)).alias(f) for f in fields))


def flat_tables(triples_df: DataFrame, key: str = "record_id") -> DataFrame:
    """(key, table_path, node_path, parent_path, fields): every group of the catalogue pivoted, a row for each object with all its fields.

    ``fields`` maps each field that holds a scalar to its text as in :func:`pivot_table`; a field that is null, or holds
    only objects, is none. The groups differ in their columns and their number has no bound, so the columns are a map.
    """
    cell = F.when((F.col("kind") != "empty") & F.col("value").isNotNull(), F.struct("field", "ordinal", "value"))
    cells = F.array_sort(F.collect_list(cell))
    text = lambda c, f: F.array_join(F.transform(F.filter(c, lambda x: x["field"] == f), lambda x: x["value"]), "\n")
    rows = triples_df.groupBy(key, "table_path", "node_path", "parent_path").agg(cells.alias("c"))
    names = F.array_distinct(F.transform("c", lambda x: x["field"]))
    return rows.select(key, "table_path", "node_path", "parent_path", F.map_from_arrays(names, F.transform(names, lambda f: text(F.col("c"), f))).alias("fields"))


def objects(triples_df: DataFrame, key: str = "record_id") -> DataFrame:
    """(key, node_path, parent_path): the repeated ancestors of the triples, each once; the payload itself is none, but an object in a field without a name is."""
    unnamed = (F.col("table_path") == "") & (F.col("field") == "") & (F.col("ordinal") == -1) & (F.col("kind") == "object")
    return triples_df.where((F.col("node_path") != "") | unnamed).select(key, "node_path", "parent_path").distinct()
