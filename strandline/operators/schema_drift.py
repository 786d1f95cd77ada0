"""Schemas that drift between files.

Every line is reduced to what it shows about its schema: which fields of which JSON types stand at the canonical
places, which unknown fields, and beside or instead of which canonical ones. These facts, distinct by file, are the
nested schema of the file, and a top-down tree edit distance compares it with the canonical tree. Its operations
have prices: an optional field is cheap to delete, a required one not; a renaming costs the more the less name, type
and inner structure agree and the more often both names stand in one object, over all files; a subtree that turns
up under another parent may be a move. The cheapest script lists the file's changes and is compiled into a
projection that reads each of its lines in the canonical shape.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.flatten import parse, to_json
from strandline.session import cut

#: Prices: an insertion, the deletion of a required and of an optional field, a move without any renaming.
INSERT, DELETE, DROP, MOVE = 1.0, 1.0, 0.1, 1.0
#: Prices of a renaming: of names and structures that agree in nothing, of another JSON type, of always standing together in one object over all files, and of standing so in this file.
UNLIKE, OTHER_TYPE, TOGETHER, BESIDE = 1.5, 0.4, 2.5, 2.0


# ---- trees -------------------------------------------------------------------------------------------------


@dataclass
class Canon:
    """A canonical field with what is below it; ``elem`` holds the fields of an array's objects."""

    kind: str = "object"
    required: bool = False
    fields: dict[str, Canon] = field(default_factory=dict)
    elem: Canon | None = None


def canonical_trees(rows: list[tuple[str, str, str, bool]]) -> dict[str, Canon]:
    """(record_kind, field_path, json_type, is_required) rows as one tree a kind."""
    trees: dict[str, Canon] = {}
    for record, path, kind, required in sorted(rows):
        at = trees.setdefault(record, Canon())
        for name in path.split("."):
            bare = name.rstrip("[]")
            at = at.fields.setdefault(bare, Canon())
            if name.endswith("[]"):
                at.elem = at.elem or Canon()
                at = at.elem
        at.kind, at.required = kind, bool(required)
    return trees


def json_type(v: object) -> str:
    if isinstance(v, dict):
        return "object"
    if isinstance(v, list):
        return "array"
    return "null" if v is None else "boolean" if isinstance(v, bool) else "integer" if isinstance(v, int) else "number" if isinstance(v, float) else "string"


def vocabulary(canon: Canon) -> frozenset[str]:
    """All field names of a canonical tree."""
    out, stack = set(), [canon]
    while stack:
        c = stack.pop()
        out |= c.fields.keys()
        stack += [*c.fields.values(), *([c.elem] if c.elem else [])]
    return frozenset(out)


def schema_facts(v: dict, canon: Canon, names: frozenset[str]) -> set[tuple[str, str, str, str]]:
    """What a record shows about its schema, as (what, place, a, b), without recursion and only at canonical places.

    ``k``: field a at the place has JSON type b; ``e``: an element of the array there has type a; ``n``: the unknown
    field a has an inner field b of a canonical name; ``b`` and ``i``: the unknown field a stands beside, or without, the canonical field b.
    """
    out: set[tuple[str, str, str, str]] = set()
    stack: list[tuple[object, Canon, str]] = [(v, canon, "")]
    while stack:
        x, c, place = stack.pop()
        if isinstance(x, dict) and c.kind == "object":
            for name, y in x.items():
                out.add(("k", place, name, json_type(y)))
                sub = c.fields.get(name)
                if sub is not None:
                    stack.append((y, sub, f"{place}.{name}" if place else name))
                    continue
                for z in y if isinstance(y, list) else (y,):
                    if isinstance(z, dict):
                        out.update(("n", place, name, k) for k in z.keys() & names)
                out.update(("b" if k in x else "i", place, name, k) for k in c.fields)
        elif isinstance(x, list) and c.kind == "array":
            for y in x:
                out.add(("e", place, json_type(y), ""))
                stack.append((y, c.elem or Canon(), place + "[]"))
    return out


@dataclass
class Seen:
    """The schema of a file as its facts give it: types of fields by place, types of elements, inner names of unknown fields, and pairs of names in one object or not, with the share of objects in which they stand together over all files."""

    fields: dict[str, dict[str, set[str]]] = field(default_factory=dict)
    elems: dict[str, set[str]] = field(default_factory=dict)
    inner: dict[tuple[str, str], set[str]] = field(default_factory=dict)
    beside: set[tuple[str, str, str]] = field(default_factory=set)
    share: dict[tuple[str, str, str], float] = field(default_factory=dict)

    def add(self, what: str, place: str, a: str, b: str, share: float = 0.0) -> None:
        if what == "k":
            self.fields.setdefault(place, {}).setdefault(a, set()).add(b)
        elif what == "e":
            self.elems.setdefault(place, set()).add(a)
        elif what == "n":
            self.inner.setdefault((place, a), set()).add(b)
        elif what == "b":
            self.beside.add((place, a, b))
        else:
            self.share[place, a, b] = share


# ---- edit distance -----------------------------------------------------------------------------------------


def name_parts(name: str) -> set[str]:
    """The lower-case words of a field name, singular, without regard to camel or snake case."""
    return {w.rstrip("s") for w in re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).lower().split("_") if w}


def name_likeness(a: str, b: str) -> float:
    x, y = name_parts(a), name_parts(b)
    return len(x & y) / min(len(x), len(y)) if x and y else 0.0


def rename_cost(u: str, kinds: set[str], inner: set[str], c: str, canon: Canon) -> float:
    """0 for another spelling of the same field, up to UNLIKE + OTHER_TYPE for one that agrees in nothing but its place."""
    want = canon.fields.keys() | (canon.elem.fields.keys() if canon.elem else set())
    likeness = max(name_likeness(u, c), len(want & inner) / len(want) if want else 0.0)
    return UNLIKE * (1 - likeness) + (0.0 if canon.kind in kinds or kinds <= {"null"} else OTHER_TYPE)


def assign(cost: list[list[float]]) -> list[int]:
    """The column of each row in the cheapest assignment; rows must not outnumber columns."""
    n, m = len(cost), len(cost[0]) if cost else 0
    u, v, match = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used, way = [float("inf")] * (m + 1), [False] * (m + 1), [0] * (m + 1)
        while match[j0]:
            used[j0] = True
            i0, delta, j1 = match[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = [-1] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


@dataclass
class Edit:
    op: str  # rename, delete, insert, retype, move
    path: str  # canonical path; for insert the path found; for move the path left
    to: str = ""  # rename: the name found; retype: the types found; move: the path found
    cost: float = 1.0


def _cheapest(rows: list[str], cols: list[str], price, alone: list[float], dropped: list[float]) -> dict[str, tuple[str, float]]:
    """The pairs of the cheapest script: a row may stay ``alone`` at its price, a column be ``dropped`` at its; a pair saves both."""
    if not rows or not cols:
        return {}
    big = 1e6
    cost = [[*(price(r, c) - d for c, d in zip(cols, dropped)), *(a if i == j else big for j in range(len(rows)))] for i, (r, a) in enumerate(zip(rows, alone))]
    return {r: (cols[j], cost[i][j] + dropped[j]) for i, (r, j) in enumerate(zip(rows, assign(cost))) if j < len(cols)}


def edit_script(seen: Seen, canon: Canon) -> list[Edit]:
    """The cheapest edits from ``canon`` to ``seen``. Absent optional fields are no edit; what lies inside an inserted, renamed, deleted or retyped field is none."""
    out: list[Edit] = []
    inserted: dict[str, tuple[str, str]] = {}
    absent: dict[str, Canon] = {}
    places = [("", canon)]
    while places:
        place, at = places.pop()
        join = lambda n: f"{place}.{n}" if place else n  # noqa: B023, E731
        known, found = at.fields, seen.fields.get(place, {})
        unknown, names = sorted(found.keys() - known.keys()), sorted(known)

        def price(u: str, c: str) -> float:
            if (place, u, c) not in seen.share:  # noqa: B023  (never one without the other)
                return 1e6
            apart = TOGETHER * seen.share[place, u, c] + (BESIDE if (place, u, c) in seen.beside else 0.0)  # noqa: B023
            return rename_cost(u, found[u], seen.inner.get((place, u), set()), c, known[c]) + apart  # noqa: B023

        renamed: dict[str, list[str]] = {}
        rest = unknown
        while rest:  # more than one other name may stand for a field, in different records; only the first saves its deletion
            saved = [0.0 if c in renamed else DELETE if known[c].required else DROP for c in names]
            took = _cheapest(rest, names, price, [INSERT] * len(rest), saved)
            for u, (c, cost) in took.items():
                renamed.setdefault(c, []).append(u)
                out.append(Edit("rename", join(c), u, cost))
            rest = [u for u in rest if u not in took]
            if not took:
                break
        for u in rest:
            inserted[join(u)] = (place, u)
        for c in names:
            want, path = known[c], join(c)
            kinds = set().union(*(found[x] for x in [*renamed.get(c, []), *([c] if c in found else [])])) - {"null"}
            wrong = sorted(kinds - {want.kind})
            if wrong:
                out.append(Edit("retype", path, ",".join(wrong)))
            if c in renamed or wrong:
                continue
            if c not in found:
                absent[path] = want
            elif want.kind == "object" and "object" in kinds:
                places.append((path, want))
            elif want.kind == "array" and seen.elems.get(path):
                places.append((path + "[]", want.elem or Canon()))

    def move_price(i: str, c: str) -> float:
        place, u = inserted[i]
        return MOVE + rename_cost(u, seen.fields[place][u], seen.inner.get((place, u), set()), c.rpartition(".")[2], absent[c]) if i.rpartition(".")[0] != c.rpartition(".")[0] else 1e6

    moved = _cheapest(sorted(inserted), sorted(absent), move_price, [INSERT] * len(inserted), [DELETE if absent[c].required else DROP for c in sorted(absent)])
    out += [Edit("move", c, i, cost) for i, (c, cost) in moved.items()]
    out += [Edit("insert", i, "", INSERT) for i in sorted(inserted) if i not in moved]
    gone = {c for c, _ in moved.values()}
    return out + [Edit("delete", c, "", DELETE) for c, want in sorted(absent.items()) if want.required and c not in gone]


# ---- Spark -------------------------------------------------------------------------------------------------


def _canon_rows(canonical: DataFrame) -> list[tuple]:
    """The canonical shape is a schema: a fixed number of rows, read by the driver as any schema is."""
    return [tuple(r) for r in canonical.select("record_kind", "field_path", "json_type", "is_required").collect()]


def _record(line: str | None) -> dict | None:
    """The record a line holds, or None for cut and null lines and lines without a kind."""
    try:
        v = parse(line or "")
    except ValueError:
        return None
    return v if isinstance(v, dict) and isinstance(v.get("type"), str) else None


def file_facts(lines: DataFrame, canonical: DataFrame) -> DataFrame:
    """(file_path, record_kind, what, place, a, b, n): the distinct facts of each file's readable lines of known kinds, with the number of records that show them."""
    rows = _canon_rows(canonical)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = canonical_trees(rows)
        names = {k: vocabulary(c) for k, c in trees.items()}
        for batch in batches:
            out: dict[tuple, int] = {}
            for f, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                v = _record(line)
                if v is None or v["type"] not in trees:
                    continue
                for fact in schema_facts(v, trees[v["type"]], names[v["type"]]):
                    k = (f, v["type"], *fact)
                    out[k] = out.get(k, 0) + 1
            cols = [*zip(*out)] or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols] + [pa.array(out.values(), pa.int64())], names=["file_path", "record_kind", "what", "place", "a", "b", "n"])

    facts = lines.select("file_path", "line").mapInArrow(run, "file_path string, record_kind string, what string, place string, a string, b string, n bigint")
    return facts.groupBy("file_path", "record_kind", "what", "place", "a", "b").agg(F.sum("n").alias("n"))


def scripts(lines: DataFrame, canonical: DataFrame) -> DataFrame:
    """(file_path, record_kind, op, path, to, cost): the edit script of each file and kind.

    How often two names stand in one object is counted over all files and joined back to the files that have one
    without the other. Kinds of record that canonical_fields does not have are left out.
    """
    rows = _canon_rows(canonical)
    facts = cut(file_facts(lines, canonical))
    pair = ["record_kind", "place", "a", "b"]
    together = facts.where("what in ('b', 'i')").groupBy(*pair).agg((F.sum(F.when(F.col("what") == "b", F.col("n")).otherwise(0)) / F.sum("n")).alias("share"))
    apart = facts.where("what = 'i'").join(together, pair).select("file_path", "record_kind", "what", "place", "a", "b", "share")
    whole = facts.where("what <> 'i'").select("file_path", "record_kind", "what", "place", "a", "b", F.lit(0.0).alias("share")).unionByName(apart)
    files = whole.groupBy("file_path", "record_kind").agg(F.collect_list(F.struct("what", "place", "a", "b", "share")).alias("facts"))

    def diff(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = canonical_trees(rows)
        for p in parts:
            out = []
            for f, kind, facts in zip(p.file_path, p.record_kind, p.facts):
                seen = Seen()
                for x in facts:
                    seen.add(x["what"], x["place"], x["a"], x["b"], x["share"])
                out += [(f, kind, e.op, e.path, e.to, float(e.cost)) for e in edit_script(seen, trees[kind])]
            yield pd.DataFrame(out, columns=["file_path", "record_kind", "op", "path", "to", "cost"])

    return files.mapInPandas(diff, "file_path string, record_kind string, op string, path string, to string, cost double")


def changes(script: DataFrame, canonical: DataFrame) -> DataFrame:
    """(file_path, record_kind, field_path, change_kind) of a script. A move counts as the addition it consists of and, of a required field, the removal."""
    kind = F.when(F.col("op").isin("insert", "move"), "added").when(F.col("op") == "rename", "renamed").when(F.col("op") == "delete", "removed").when(F.col("op") == "retype", "type_changed")
    out = script.select("file_path", "record_kind", F.when(F.col("op") == "move", F.col("to")).otherwise(F.col("path")).alias("field_path"), kind.alias("change_kind"))
    required = F.broadcast(canonical.where("is_required").select("record_kind", F.col("field_path").alias("path")))  # a fixed number of rows
    left = script.where("op = 'move'").join(required, ["record_kind", "path"], "left_semi").select("file_path", "record_kind", F.col("path").alias("field_path"), F.lit("removed").alias("change_kind"))
    return out.unionByName(left).distinct()


_NUMBER = re.compile(r"^\s*(-?\d{1,3}(?:[,_ ]\d{3})+|-?\d+)(?:\.0+)?\s*[A-Za-z]*\s*$")


def _coerce(v: object, kind: str) -> object:
    """``v`` as the canonical type where that loses nothing; otherwise None."""
    if isinstance(v, list) and len(v) == 1 and kind != "array":
        v = v[0]
    if isinstance(v, dict) and len(v) == 1 and kind not in ("object", "array"):
        v = next(iter(v.values()))
    if kind == "integer":
        if isinstance(v, bool) or isinstance(v, float) and v != int(v):
            return None
        if isinstance(v, int | float):
            return int(v) if abs(v) < 2**63 else None
        m = _NUMBER.match(v) if isinstance(v, str) else None
        return int(re.sub(r"[,_ ]", "", m[1])) if m and len(m[1]) < 20 else None
    if kind == "string":
        return v if isinstance(v, str) or v is None else to_json(v)
    if isinstance(v, str):
        try:
            v = parse(v)
        except ValueError:
            v = [v] if kind == "array" else None
    if kind == "array" and v is not None and not isinstance(v, list):
        v = [v]
    return to_json(v) if isinstance(v, dict | list) else None


def column_of(path: str) -> str:
    return path.replace("[]", "_items").replace(".", "__")


def _at(v: object, path: str) -> object:
    for name in path.split("."):
        if not isinstance(v, dict) or name not in v:
            return None
        v = v[name]
    return v


def project(v: dict, canon: Canon, other: dict[str, list[str]], moved: dict[str, str]) -> tuple[dict, dict[str, object]]:
    """(record in the canonical shape, the rest): fields under their canonical names, those of array elements too; what the canonical tree does not know comes out by path."""
    rest: dict[str, object] = {}
    taken = set(moved.values())

    def shaped(x: object, c: Canon, place: str) -> object:  # as deep as the canonical tree
        if isinstance(x, list) and len(x) == 1 and c.kind == "object":
            x = x[0]
        if c.kind == "array" and isinstance(x, list) and c.elem:
            return [shaped(y, c.elem, place + "[]") for y in x]
        if c.kind != "object" or not c.fields or not isinstance(x, dict):
            return x
        out, used = {}, set()
        for name, sub in c.fields.items():
            path = f"{place}.{name}" if place else name
            key = name if name in x else next((n for n in other.get(path, ()) if n in x), None)
            if key is not None:
                used.add(key)
                out[name] = shaped(x[key], sub, path)
            elif path in moved:
                out[name] = shaped(_at(v, moved[path]), sub, path)
        for k, y in x.items():
            path = f"{place}.{k}" if place else k
            if k not in used and path not in taken:
                rest.setdefault(path, []).append(y) if "[]" in path else rest.__setitem__(path, y)
        return out

    return shaped(v, canon, ""), rest


def column_of(path: str) -> str:
    return path.replace("[]", "_items").replace(".", "__")


def unified(lines: DataFrame, canonical: DataFrame, script: DataFrame) -> DataFrame:
    """Every readable line of a known kind in the canonical shape: (line_id, file_path, line_no, record_kind, one column a canonical field outside arrays, other).

    Renamed and moved fields come back under their canonical name, those inside array elements too; values of
    another type are converted where that loses nothing and null elsewhere; integers are bigint, strings string,
    objects and arrays JSON text. ``other`` maps the path of each field that the canonical shape does not have to its JSON text.
    """
    rows = _canon_rows(canonical)
    shape = {p: k for _, p, k, _ in sorted(rows) if "[]" not in p and k != "object" or p.count(".") and k == "object"}
    cols = {p: column_of(p) for p in shape}
    edits = script.where("op in ('rename', 'move')").groupBy("file_path").agg(F.collect_list(F.struct("record_kind", "op", "path", "to")).alias("edits"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = canonical_trees(rows)
        for p in parts:
            out = []
            for i, f, no, line, own in zip(p.line_id, p.file_path, p.line_no, p.line, p.edits):
                v = _record(line)
                if v is None or v["type"] not in trees:
                    continue
                other: dict[str, list[str]] = {}
                moved: dict[str, str] = {}
                for e in own if own is not None else ():
                    if e["record_kind"] == v["type"]:
                        if e["op"] == "move":
                            moved[e["path"]] = e["to"]
                        else:
                            other.setdefault(e["path"], []).append(e["to"])
                got, rest = project(v, trees[v["type"]], other, moved)
                out.append([i, f, no, v["type"], *(_coerce(_at(got, q), shape[q]) for q in shape), {k: to_json(x) for k, x in rest.items()}])
            df = pd.DataFrame(out, columns=["line_id", "file_path", "line_no", "record_kind", *cols.values(), "other"])
            yield df.astype({cols[q]: "Int64" for q, k in shape.items() if k == "integer"})

    ddl = "line_id bigint, file_path string, line_no int, record_kind string, " + ", ".join(f"`{cols[p]}` {'bigint' if k == 'integer' else 'string'}" for p, k in shape.items()) + ", other map<string, string>"
    own = lines.select("line_id", "file_path", "line_no", "line")
    return own.join(edits, "file_path", "left").select("line_id", "file_path", F.col("line_no").cast("int"), "line", "edits").mapInPandas(run, ddl)
