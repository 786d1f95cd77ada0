"""Queries of the general data problems: hierarchies, nested records, drifting schemas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.ids import canonical_uuid
from strandline.operators import flatten, hierarchy, schema_drift
from strandline.session import cut
from strandline.sources.tables import table


def _tree(spark: SparkSession, d: str) -> DataFrame:
    sessions = table(spark, d, "sessions").select(canonical_uuid(F.col("id")).alias("id"))
    return hierarchy.forest(hierarchy.agent_links(table(spark, d, "subagent_meta")), sessions)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    rooted = F.col("status") == "rooted"
    return _tree(spark, d).where("not top").select("id", F.when(rooted, F.col("root_id")).otherwise(F.col("status")).alias("root_id"), F.when(rooted, F.col("depth")).otherwise(F.lit(-1)).cast("int").alias("true_depth"))


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.paths(cut(_tree(spark, d))).select("id", F.array_join("path", "/").alias("path"), "status")


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.ancestors(cut(_tree(spark, d)))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return flatten.objects(flatten.path_triples(table(spark, d, "rollout_records")))


def p3_triples(spark: SparkSession, d: str) -> DataFrame:
    return flatten.path_triples(table(spark, d, "rollout_records"))


def p3_catalogue(spark: SparkSession, d: str) -> DataFrame:
    return flatten.table_catalogue(flatten.path_triples(table(spark, d, "rollout_records")))


def p3_tables(spark: SparkSession, d: str) -> DataFrame:
    return flatten.flat_tables(flatten.path_triples(table(spark, d, "rollout_records")))


def p3_token_totals(spark: SparkSession, d: str) -> DataFrame:
    fields = ["input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens"]
    return flatten.pivot_table(flatten.path_triples(table(spark, d, "rollout_records")), "info.total_token_usage", fields)


def p3_spawns(spark: SparkSession, d: str) -> DataFrame:
    fields = ["id", "parent_thread_id", "depth", "agent_role"]
    return flatten.pivot_table(flatten.path_triples(table(spark, d, "rollout_records")), "source.subagent.thread_spawn", fields)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    canonical = table(spark, d, "canonical_fields")
    return schema_drift.changes(schema_drift.scripts(table(spark, d, "rollout_lines"), canonical), canonical)


def p5_unified(spark: SparkSession, d: str) -> DataFrame:
    lines, canonical = table(spark, d, "rollout_lines"), table(spark, d, "canonical_fields")
    return schema_drift.unified(lines, canonical, schema_drift.scripts(lines, canonical))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_found, p2_paths, p2_descendants, p3_found, p3_triples, p3_catalogue, p3_tables, p3_token_totals, p3_spawns, p5_found, p5_unified)}

_CANON = "CASE WHEN regexp_matches(replace({0}, '-', ''), '^[0-9a-f]{{32}}$') THEN regexp_replace(replace({0}, '-', ''), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') WHEN {0} <> '' THEN {0} END"
_BARE = r"regexp_replace(lower(regexp_replace({0}, '[\s{{}}()""'']+', '', 'g')), '^(urn:)?(uuid:)?', '')"
_ID, _PARENT = (_CANON.format(_BARE.format(c)) for c in ("id", "parent_id"))
_WALK = f"""
WITH RECURSIVE links AS (
  SELECT id, min(parent) AS parent FROM (SELECT {_ID} AS id, {_PARENT} AS parent FROM subagent_meta) WHERE id IS NOT NULL GROUP BY id
), roots AS (
  SELECT DISTINCT {_ID} AS id FROM sessions
), walk AS (
  SELECT id, parent AS up, [id] AS seen, 1 AS steps FROM links
  UNION ALL
  SELECT w.id, l.parent, list_append(w.seen, l.id), w.steps + 1 FROM walk w JOIN links l ON l.id = w.up WHERE NOT list_contains(w.seen, w.up)
), ends AS (
  SELECT w.*, list_contains(w.seen, w.up) AS cyclic, r.id IS NOT NULL AS rooted
  FROM walk w LEFT JOIN links l ON l.id = w.up LEFT JOIN roots r ON r.id = w.up
  WHERE w.up IS NULL OR l.id IS NULL OR list_contains(w.seen, w.up)
)"""
#: The way up from each agent: to its root session, its topmost agent, or the first member of a cycle.
_WAYS = _WALK + """, ways AS (
  SELECT id, coalesce(cyclic, false) AS cyclic, rooted, CASE WHEN coalesce(cyclic, false) THEN seen[1:list_position(seen, up)] WHEN rooted THEN list_append(seen, up) ELSE seen END AS way FROM ends
)"""
#: All objects inside the payloads, level by level; a string that as a whole is an object or array is opened.
_OBJECTS = r"""
WITH RECURSIVE top AS (
  SELECT record_id, CASE WHEN json_type(v) = 'VARCHAR' AND regexp_matches(trim(v->>'$', E' \t\r\n'), '^[\[{]') THEN TRY_CAST(v->>'$' AS JSON) ELSE v END AS v FROM (SELECT record_id, TRY_CAST(payload AS JSON) AS v FROM rollout_records)
), n AS (
  SELECT record_id, v, '' AS path, '' AS parent, true AS whole FROM top WHERE json_type(v) IN ('OBJECT', 'ARRAY')
  UNION ALL
  SELECT record_id, CASE WHEN json_type(w) = 'VARCHAR' THEN TRY_CAST(w->>'$' AS JSON) ELSE w END, place, above, false FROM (
    SELECT n.record_id, e.value AS w, CASE WHEN json_type(n.v) = 'ARRAY' THEN n.path || '[' || e.key || ']' WHEN n.path = '' THEN e.key ELSE n.path || '.' || e.key END AS place, CASE WHEN json_type(n.v) = 'ARRAY' THEN n.parent ELSE n.path END AS above
    FROM n, LATERAL (SELECT * FROM json_each(n.v)) e WHERE json_type(n.v) IN ('OBJECT', 'ARRAY')
  ) WHERE json_type(w) IN ('OBJECT', 'ARRAY') OR json_type(w) = 'VARCHAR' AND regexp_matches(trim(w->>'$', E' \t\r\n'), '^(\{.*\}|\[.*\])$', 's')
)
SELECT DISTINCT record_id, path AS node_path, parent AS parent_path FROM n WHERE NOT whole AND json_type(v) = 'OBJECT'
"""


def _flat_sql(table_path: str, fields: tuple[str, ...]) -> str:
    """The flat table of one group of the objects, its scalar fields as text."""
    walk = _OBJECTS[: _OBJECTS.rindex("SELECT DISTINCT")]
    cells = ", ".join(f"CASE WHEN json_type(v, '$.{f}') NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN v->>'$.{f}' END AS {f}" for f in fields)
    return walk + f"SELECT record_id, path AS node_path, parent AS parent_path, {cells} FROM n WHERE NOT whole AND json_type(v) = 'OBJECT' AND regexp_replace(path, '\\[\\d+\\]', '[]', 'g') = '{table_path}'"


SQL: dict[str, str] = {
    "p3_found": _OBJECTS,
    "p3_token_totals": _flat_sql("info.total_token_usage", ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens")),
    "p3_spawns": _flat_sql("source.subagent.thread_spawn", ("id", "parent_thread_id", "depth", "agent_role")),
    "p2_found": _WALK + " SELECT id, CASE WHEN coalesce(cyclic, false) THEN 'cycle' WHEN rooted THEN up ELSE 'missing' END AS root_id, CAST(CASE WHEN NOT coalesce(cyclic, false) AND rooted THEN steps ELSE -1 END AS INTEGER) AS true_depth FROM ends",
    "p2_paths": _WAYS + " SELECT id, array_to_string(list_reverse(way), '/') AS path, CASE WHEN cyclic THEN 'cycle' WHEN rooted THEN 'rooted' ELSE 'missing' END AS status FROM ways",
    "p2_descendants": _WAYS + " SELECT p.x AS ancestor_id, id, CAST(p.k AS INTEGER) AS distance FROM (SELECT id, unnest(way) AS x, generate_subscripts(way, 1) - 1 AS k FROM ways) p WHERE p.k > 0",
}
