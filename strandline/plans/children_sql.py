"""The queries of ``children`` in the SQL of the checking engine, written apart from them."""

from __future__ import annotations

from strandline.operators.records import USAGE
from strandline.plans.reference_sql import BEFORE, LABELS, REC, SINCE, TURNS_OF, USERS

_PARTS = USAGE[:-1]
_T = "side, owner, turn_id"
_NONE = "{" + ", ".join(f"'{u}': NULL::BIGINT" for u in USAGE) + "}"
_ZERO = "{" + ", ".join(f"'{u}': 0::BIGINT" for u in USAGE) + "}"


def _valid(p: dict[str, str], total: str) -> str:
    """The validity of a usage whose parts are the expressions ``p``."""
    i, c, o, r = (p[x] for x in _PARTS)
    bounds = " AND ".join(f"coalesce({x} >= 0 AND {x} <= {total}, true)" for x in (i, c, o, r))
    return f"coalesce({total} >= 0 AND {bounds} AND coalesce({i}::HUGEINT + {o}::HUGEINT = {total}, true) AND coalesce({c} <= {i}, true) AND coalesce({r} <= {o}, true), false)"


def _of(struct: str) -> tuple[dict[str, str], str]:
    p = {x: f"{struct}.{x}" for x in _PARTS}
    return p, f"coalesce({struct}.total_tokens, TRY_CAST({struct}.input_tokens::HUGEINT + {struct}.output_tokens::HUGEINT AS BIGINT))"


def _delta(last: str, first: str) -> tuple[dict[str, str], str, str]:
    """(parts, total, validity) of the difference of two structs of counters."""
    (lp, lt), (fp, ft) = _of(last), _of(first)
    d = {x: f"({lp[x]} - {fp[x]})" for x in _PARTS}
    total = f"coalesce({lt} - {ft}, {d['input_tokens']} + {d['output_tokens']})"
    rises = " AND ".join(f"coalesce({a} >= {b}, true)" for a, b in [*((lp[x], fp[x]) for x in _PARTS), (lt, ft)])
    return d, total, f"({_valid(lp, lt)} AND {_valid(fp, ft)} AND {rises} AND {_valid(d, total)})"


AGENTS = REC + """, m0 AS (
  SELECT file_path, rec_ts, CASE WHEN json_type(TRY_CAST(payload AS JSON)) = 'OBJECT' THEN TRY_CAST(payload AS JSON) END AS j FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY line_no, record_id) AS k FROM rollout_records WHERE rec_type = 'session_meta') WHERE k = 1
), m1 AS (
  SELECT file_path, coalesce(rec_ts, '') AS started_at, j, j->'$.source.subagent.thread_spawn' AS s, """ + " AND ".join(f"coalesce(json_type(j, '$.{x}') IN ('VARCHAR', 'NULL'), true)" for x in ("id", "originator", "thread_source", "forked_from_id", "source.subagent.thread_spawn.id", "source.subagent.thread_spawn.parent_thread_id", "source.subagent.thread_spawn.agent_role")) + """ AS texts FROM m0 WHERE j IS NOT NULL
), files AS (
  SELECT file_path, coalesce(j->>'$.id', '') AS id, coalesce(s->>'$.parent_thread_id', '') AS parent_id, coalesce(s->>'$.agent_role', '') AS role, coalesce(TRY_CAST(s->>'$.depth' AS BIGINT), 0) AS depth, TRY_CAST(s->>'$.depth' AS BIGINT) IS NOT NULL AS has_depth, started_at, coalesce(j->>'$.forked_from_id', '') AS forked_from_id
  FROM m1 WHERE texts AND json_type(s) = 'OBJECT' AND coalesce(json_type(s, '$.depth') IN ('BIGINT', 'UBIGINT', 'NULL'), true) AND j->>'$.thread_source' = 'subagent' AND (coalesce(s->>'$.id', '') = '' OR coalesce(j->>'$.id', '') = '' OR s->>'$.id' = j->>'$.id')
), agents0 AS (
  SELECT id AS owner, count(*) AS files, count(DISTINCT started_at) > 1 AS creation_conflict, count(DISTINCT role) > 1 AS role_conflict, count(DISTINCT (depth, has_depth)) > 1 AS depth_conflict, count(DISTINCT forked_from_id) > 1 AS fork_conflict, count(DISTINCT parent_id) > 1 AS parent_conflict,
    min(parent_id) AS parent_id, min(role) AS role, min(depth) AS depth, min(has_depth) AS has_depth, min(started_at) AS started_at, min(forked_from_id) AS fork FROM files WHERE id <> '' GROUP BY 1
), agents AS (
  SELECT owner, files, CASE WHEN parent_conflict THEN '' ELSE parent_id END AS parent_id, CASE WHEN role_conflict OR role = '' THEN 'unknown' ELSE role END AS role, depth, has_depth AND NOT depth_conflict AS has_depth,
    (SELECT min(ns) FROM r WHERE r.rec_ts = started_at) AS created_ns, NOT fork_conflict AND fork <> '' AS forked, creation_conflict, role_conflict, depth_conflict, fork_conflict, parent_conflict, creation_conflict OR role_conflict OR depth_conflict OR fork_conflict OR parent_conflict AS attribute_conflict FROM agents0
), agent_files AS (
  SELECT file_path, id AS owner, 'agent' AS side, forked_from_id <> '' AS forked FROM files WHERE id <> ''
)"""
_FLAGS = {
    "s": "rec_type = 'event_msg' AND kind = 'task_started' AND turn_id <> ''", "e": "rec_type = 'event_msg' AND kind IN ('task_complete', 'turn_aborted') AND turn_id <> ''", "c": "rec_type = 'event_msg' AND kind = 'token_count' AND has_count",
    "k": "rec_type = 'compacted'", "t": "rec_type = 'response_item' AND kind IN ('function_call', 'custom_tool_call')",
}
_SPAN = "PARTITION BY file_path ORDER BY line_no, record_id ROWS UNBOUNDED PRECEDING"


def _facts(files: str) -> str:
    """The facts of the files of a relation, and what follows from them by turn."""
    lo, lt, lok = _delta("usage", "base")
    so, st, sok = _delta("d", "before")
    del so, st
    d_parts = "{" + ", ".join(f"'{x}': {v}" for x, v in {**lo, "total_tokens": lt}.items()) + "}"
    agree = " AND ".join(f"coalesce(min(d.{u}) = max(d.{u}), true)" for u in USAGE)
    bases = " AND ".join(f"coalesce(min(lo_{u}) = max(hi_{u}), true)" for u in USAGE)
    up, ut = _of("usage")
    fact = lambda what, turn, where: f"SELECT owner, side, forked, file_path, line_no, record_id, '{what}' AS what, {turn} AS turn_id, ns, rec_ts, kind, duration_ms, bad_duration, coalesce(model, '') AS model, coalesce(effort, '') AS effort, coalesce(root_turn_id, '') AS root_turn_id, coalesce(thread_id, '') AS thread_id, coalesce(response_id, '') AS response_id, coalesce(call_id, '') AS call_id, {'usage' if what == 'usage' else 'snap'} AS usage, base FROM x6 WHERE {where}"
    merged = {x: f"max({x})" for x in _PARTS}
    same = " AND ".join(f"coalesce(min({x}) = max({x}), true)" for x in (*_PARTS, "tot"))
    diff = " OR ".join(f"coalesce(rec_{x} <> est.{x}, false)" for x in _PARTS)
    return f""", x0 AS (
  SELECT r.*, fi.owner, fi.side, fi.forked, {", ".join(f"coalesce({v}, false) AS {n}" for n, v in _FLAGS.items())} FROM r JOIN {files} fi USING (file_path) WHERE child_ok AND ns IS NOT NULL
), x1 AS (
  SELECT *, CASE WHEN s THEN min(ns) FILTER (WHERE s) OVER (PARTITION BY file_path, turn_id ORDER BY line_no, record_id ROWS UNBOUNDED PRECEDING) END AS earliest FROM x0
), x2 AS (
  SELECT *, sum(CAST(s AS INTEGER)) OVER w AS seg, last_value(CASE WHEN s THEN turn_id END IGNORE NULLS) OVER w AS open_id, last_value(earliest IGNORE NULLS) OVER w AS open_min FROM x1 WINDOW w AS ({_SPAN})
), x3 AS (
  SELECT *, CASE WHEN coalesce(bool_or(coalesce(e AND turn_id = open_id AND ns >= open_min, false)) OVER (PARTITION BY file_path, seg ORDER BY line_no, record_id ROWS UNBOUNDED PRECEDING), false) THEN NULL ELSE open_id END AS cur FROM x2
), x4 AS (
  SELECT *, lag(cur) OVER w AS prev, s AND coalesce(lag(cur) OVER w <> turn_id, false) AS overlap FROM x3 WINDOW w AS (PARTITION BY file_path ORDER BY line_no, record_id)
), x5 AS (
  SELECT *, coalesce(last_value(CASE WHEN c THEN cnt WHEN k OR overlap THEN {_NONE} END IGNORE NULLS) OVER ({_SPAN}), {_ZERO}) AS now_cnt FROM x4
), x6 AS (
  SELECT *, first_value(CASE WHEN s THEN now_cnt END IGNORE NULLS) OVER (PARTITION BY file_path, cur ORDER BY line_no, record_id ROWS UNBOUNDED PRECEDING) AS base, CASE WHEN turn_id <> '' AND turn_id <> cur THEN {_NONE} ELSE cnt END AS snap FROM x5
), f0 AS (
  {fact("start", "turn_id", "s")} UNION ALL {fact("end", "turn_id", "e")} UNION ALL {fact("ambiguous", "prev", "overlap")} UNION ALL {fact("ambiguous", "turn_id", "overlap")}
  UNION ALL {fact("counter", "cur", "c AND cur IS NOT NULL AND NOT forked")} UNION ALL {fact("tool", "cur", "t AND cur IS NOT NULL")} UNION ALL {fact("setting", "turn_id", "rec_type = 'turn_context' AND turn_id <> ''")} UNION ALL {fact("usage", "turn_id", "rec_type = 'token_usage_record' AND turn_id <> ''")}
), f1 AS (
  SELECT *, min(ns) FILTER (WHERE what = 'start') OVER (PARTITION BY {_T}) AS start_ns FROM f0
), f AS (
  SELECT *, CASE WHEN kind = 'task_complete' THEN 'complete' ELSE 'aborted' END AS st, coalesce(ns >= start_ns, true) AS since, max(ns) FILTER (WHERE what = 'end' AND ns >= start_ns) OVER (PARTITION BY {_T}) AS end_ns FROM f1
), votes AS (
  SELECT {_T}, file_path, arg_max(thread_id = owner, (line_no, record_id)) AS owned, count(DISTINCT thread_id = owner) > 1 AS split FROM f WHERE what = 'usage' AND forked GROUP BY ALL
), own AS (
  SELECT {_T}, bool_or(owned) AS owned, bool_or(split) OR count(DISTINCT owned) > 1 AS vote_conflict FROM votes GROUP BY ALL
), t0 AS (
  SELECT {_T}, any_value(start_ns) AS start_ns, any_value(end_ns) AS end_ns, count(DISTINCT st) FILTER (WHERE what = 'end' AND ns = end_ns) AS sts, min(st) FILTER (WHERE what = 'end' AND ns = end_ns) AS end_st,
    count(DISTINCT (ns, st)) FILTER (WHERE what = 'end' AND coalesce(ns < start_ns, true)) AS early_ends, list_sort(list_distinct(list((CASE WHEN model = '' THEN 'unknown' ELSE model END, CASE WHEN effort = '' THEN 'unknown' ELSE effort END)) FILTER (WHERE what = 'setting'))) AS settings,
    count(DISTINCT model) FILTER (WHERE what = 'setting') AS models, min(model) FILTER (WHERE what = 'setting') AS a_model, coalesce(bool_and(since AND model <> '') FILTER (WHERE what = 'setting'), false) AS clear,
    count(DISTINCT root_turn_id) FILTER (WHERE root_turn_id <> '' AND since AND (what = 'setting' OR what = 'usage' AND thread_id = owner)) AS roots, min(root_turn_id) FILTER (WHERE root_turn_id <> '' AND since AND (what = 'setting' OR what = 'usage' AND thread_id = owner)) AS a_root,
    count(*) FILTER (WHERE what = 'usage') AS usage_records, count(*) FILTER (WHERE what = 'counter') AS counters, bool_or(what = 'ambiguous') AS ambiguous, bool_or(forked) AS in_fork,
    bool_or(what = 'usage' AND since AND thread_id <> '' AND thread_id <> owner) AS foreign_usage, count(DISTINCT call_id) FILTER (WHERE what = 'tool' AND since AND call_id <> '') AS tools, bool_or(what = 'tool' AND since AND call_id = '') AS more_tools,
    max(duration_ms) FILTER (WHERE what = 'end' AND ns = end_ns AND st = 'complete') AS dur, count(DISTINCT duration_ms) FILTER (WHERE what = 'end' AND ns = end_ns AND st = 'complete') > 1 OR bool_or(what = 'end' AND ns = end_ns AND st = 'complete' AND (bad_duration OR coalesce(duration_ms < 0, false))) IS TRUE AS dur_bad,
    count(DISTINCT rec_ts) FILTER (WHERE what = 'usage' AND thread_id = owner AND response_id = '') AS anonymous
  FROM f GROUP BY ALL
), t1 AS (
  SELECT {_T}, start_ns, end_ns, coalesce(end_st, 'incomplete') AS status, sts > 1 AS terminal_conflict, early_ends, coalesce(settings, []) AS settings, CASE WHEN clear AND models = 1 THEN a_model ELSE 'unknown' END AS single_model, CASE WHEN roots = 1 THEN a_root END AS root_turn, usage_records, counters, ambiguous, in_fork, foreign_usage, tools, more_tools,
    CASE WHEN end_st = 'complete' AND NOT dur_bad THEN dur END AS duration_ms, coalesce(end_st = 'complete', false) AND dur_bad AS invalid_duration, anonymous, owned IS NOT NULL AS owned_seen, coalesce(owned, false) AS owned, coalesce(vote_conflict, false) AS vote_conflict FROM t0 LEFT JOIN own USING ({_T})
), u0 AS (
  SELECT *, {", ".join(f"usage.{x} AS {x}" for x in _PARTS)}, {ut} AS tot, {_valid(up, ut)} AS good FROM f WHERE what = 'usage' AND thread_id = owner AND response_id <> ''
), own_r AS (
  SELECT response_id, count(DISTINCT (owner, turn_id)) AS owners FROM u0 GROUP BY 1
), sets AS (
  SELECT {_T}, ns, CASE WHEN count(DISTINCT model) = 1 THEN CASE WHEN min(model) = '' THEN 'unknown' ELSE min(model) END ELSE 'unknown' END AS set_model FROM f WHERE what = 'setting' AND since GROUP BY ALL
), u1 AS (
  SELECT u0.*, owners, coalesce(sets.set_model, 'unknown') AS then_model FROM u0 JOIN own_r USING (response_id) ASOF LEFT JOIN sets ON sets.side = u0.side AND sets.owner = u0.owner AND sets.turn_id = u0.turn_id AND u0.ns >= sets.ns
), req0 AS (
  SELECT {_T}, response_id, {", ".join(f"max({x}) AS {x}" for x in _PARTS)}, coalesce(max(tot), TRY_CAST({merged['input_tokens']}::HUGEINT + {merged['output_tokens']}::HUGEINT AS BIGINT)) AS total_tokens, bool_and(good AND since AND owners = 1) AND {same} AS ok, CASE WHEN count(DISTINCT then_model) = 1 THEN min(then_model) ELSE 'unknown' END AS model FROM u1 GROUP BY ALL
), req AS (
  SELECT * EXCLUDE (ok), ok AND {_valid({x: x for x in _PARTS}, "total_tokens")} AS valid FROM req0
), e0 AS (
  SELECT {_T}, ns, base, {d_parts} AS d, {lok} AS good FROM f WHERE what = 'counter' AND since
), e1 AS (
  SELECT {_T}, ns, {{{", ".join(f"'{u}': max(d.{u})" for u in USAGE)}}} AS d, bool_and(good) AND {agree} AS ok, {", ".join(f"min(base.{u}) AS lo_{u}, max(base.{u}) AS hi_{u}" for u in USAGE)} FROM e0 GROUP BY {_T}, ns
), e2 AS (
  SELECT *, lag(d) OVER (PARTITION BY {_T} ORDER BY ns) AS before FROM e1
), e3 AS (
  SELECT {_T}, bool_and(ok AND (before IS NULL OR {sok})) AND {bases} AS ok, arg_max(d, ns) AS d FROM e2 GROUP BY ALL
), est AS (
  SELECT {_T}, CASE WHEN ambiguous THEN 'invalid' WHEN ok IS NULL THEN 'missing' WHEN ok THEN 'valid' ELSE 'invalid' END AS state, {", ".join(f"CASE WHEN ok AND NOT ambiguous THEN d.{u} END AS {u}" for u in USAGE)} FROM t1 LEFT JOIN e3 USING ({_T}) WHERE counters > 0
), rs AS (
  SELECT {_T}, count(*) FILTER (WHERE valid) AS valid_requests, count(*) FILTER (WHERE NOT valid) AS invalid_requests, sum(total_tokens) FILTER (WHERE valid) AS rec_total, {", ".join(f"CASE WHEN count(*) FILTER (WHERE valid AND {x} IS NULL) = 0 THEN sum({x}) FILTER (WHERE valid) END AS rec_{x}" for x in _PARTS)} FROM req GROUP BY ALL
), t2 AS (
  SELECT t1.*, coalesce(valid_requests, 0) AS valid_requests, coalesce(invalid_requests, 0) + anonymous AS invalid_records, rec_total, coalesce(state, 'missing') AS state, est.total_tokens AS est_total, {", ".join(f"est.{x} AS est_{x}" for x in _PARTS)},
    CASE WHEN valid_requests > 0 THEN 'recorded' WHEN usage_records = 0 AND state = 'valid' THEN 'estimated' ELSE 'missing' END AS source, CASE WHEN valid_requests > 0 THEN CASE WHEN coalesce(state, '') <> 'valid' THEN 'unverifiable' WHEN rec_total <> est.total_tokens OR {diff} THEN 'mismatch' ELSE 'equal' END END AS chk
  FROM t1 LEFT JOIN rs USING ({_T}) LEFT JOIN est USING ({_T})
), t3 AS (
  SELECT t2.*, agents.role, agents.parent_id, agents.attribute_conflict, CASE WHEN start_ns IS NULL THEN 'outside' WHEN agents.attribute_conflict THEN 'conflict' WHEN start_ns < agents.created_ns THEN 'before_creation' WHEN agents.forked AND (NOT owned_seen OR NOT owned OR vote_conflict) THEN 'unattributed' WHEN NOT agents.forked AND owned_seen AND vote_conflict THEN 'ownership_conflict' WHEN terminal_conflict THEN 'terminal_conflict' ELSE 'included' END AS reason
  FROM t2 JOIN agents ON agents.owner = t2.owner AND t2.side = 'agent'
)"""


KIDS = AGENTS + _facts("agent_files")
_IN = "t3 WHERE reason = 'included'"
_USED = """(SELECT t3.role, req.model, 'recorded' AS source, {p} FROM req JOIN t3 USING (side, owner, turn_id) WHERE valid AND reason = 'included' UNION ALL SELECT role, single_model, 'estimated', {e} FROM t3 WHERE reason = 'included' AND source = 'estimated')""".format(p=", ".join(f"req.{u}" for u in USAGE), e=", ".join(f"est_{x}" for x in _PARTS) + ", est_total")
_TOTALS = "count(*) AS requests, " + ", ".join(f"CASE WHEN count(*) FILTER (WHERE {x} IS NULL) = 0 THEN CAST(sum({x}) AS BIGINT) END AS {x}" for x in _PARTS) + ", CAST(sum(total_tokens) AS BIGINT) AS total_tokens"
_ROOTS = """, walk AS (
  SELECT owner, parent_id AS up, [owner] AS seen FROM agents WHERE NOT attribute_conflict AND parent_id <> ''
  UNION ALL
  SELECT w.owner, a.parent_id, list_append(w.seen, a.owner) FROM walk w JOIN agents a ON a.owner = w.up WHERE w.up NOT IN (SELECT id FROM users) AND NOT list_contains(w.seen, w.up) AND NOT a.attribute_conflict AND a.parent_id <> ''
), roots AS (
  SELECT DISTINCT owner, up AS root_session FROM walk WHERE up IN (SELECT id FROM users)
), sess AS (
  SELECT coalesce(turn_id, '') AS turn_id, CASE WHEN count(DISTINCT id) = 1 THEN min(id) END AS session FROM user_turns JOIN users USING (file_path) GROUP BY 1
)"""
_LINKS = """, both_files AS (
  SELECT * FROM agent_files UNION ALL SELECT file_path, id AS owner, 'user' AS side, forked FROM users WHERE id <> ''
)""" + _facts("both_files") + """, firsts AS (
  SELECT owner, root_session, min(turn_id) AS first FROM roots JOIN sess ON session = root_session GROUP BY ALL
), l0 AS (
  SELECT t3.* EXCLUDE (root_turn), coalesce(first, root_turn) AS root_turn FROM t3 LEFT JOIN firsts USING (owner) WHERE reason <> 'outside'
), links AS (
  SELECT l0.*, root_session, CASE WHEN NOT (reason = 'included' AND NOT foreign_usage) THEN 'excluded' WHEN l0.root_turn <> '' AND root_session = session THEN 'linked' ELSE 'unlinked' END AS link
  FROM l0 LEFT JOIN roots USING (owner) LEFT JOIN sess ON sess.turn_id = l0.root_turn
)"""
_M = ("recorded", "estimated", "seconds", "tool_calls")
_C = ("mismatches", "unverifiable", "invalid")
_LOST = "CASE WHEN source = 'missing' OR invalid_records > 0 THEN 1 ELSE 0 END"
_CELLS = f"""CASE WHEN source = 'recorded' THEN rec_total ELSE 0 END AS recorded, CAST(source = 'recorded' AS INTEGER) AS recorded_known, {_LOST} AS recorded_missing, CASE WHEN source = 'estimated' THEN est_total ELSE 0 END AS estimated, CAST(source = 'estimated' AS INTEGER) AS estimated_known, {_LOST} AS estimated_missing,
  coalesce(duration_ms / 1000.0, 0) AS seconds, CAST(duration_ms IS NOT NULL AS INTEGER) AS seconds_known, CAST(duration_ms IS NULL AS INTEGER) AS seconds_missing, tools AS tool_calls, 1 AS tool_calls_known, CAST(more_tools AS INTEGER) AS tool_calls_missing,
  CAST(coalesce(chk = 'mismatch', false) AS INTEGER) AS mismatches, CAST(coalesce(chk = 'unverifiable', false) AS INTEGER) AS unverifiable, invalid_records + CAST(state = 'invalid' AS INTEGER) AS invalid"""
_ALL = [x for m in _M for x in (m, f"{m}_known", f"{m}_missing")] + [*_C]
_SUMS = ", ".join(f"round(CAST(sum({x}) AS DOUBLE), 3) AS {x}" if x in _M else f"CAST(sum({x}) AS BIGINT) AS {x}" for x in _ALL)
_ONE = ", ".join(f"round(CAST({x} AS DOUBLE), 3) AS {x}" if x in _M else f"CAST({x} AS BIGINT) AS {x}" for x in _ALL)
WORLD = AGENTS + USERS + TURNS_OF("users", "user_turns") + _ROOTS + _LINKS + f""", cells AS (
  SELECT side, owner, turn_id, {_CELLS} FROM t2
), got AS (
  SELECT l.root_turn AS task, l.owner, l.turn_id, l.role, l.single_model, cells.* EXCLUDE (side, owner, turn_id) FROM links l JOIN cells ON cells.side = 'agent' AND cells.owner = l.owner AND cells.turn_id = l.turn_id WHERE link = 'linked'
), fit AS (
  SELECT t2.owner AS session, t2.turn_id, cells.* EXCLUDE (side, owner, turn_id) FROM t2 JOIN cells USING (side, owner, turn_id) WHERE side = 'user' AND NOT terminal_conflict AND NOT vote_conflict AND NOT foreign_usage AND (NOT owned_seen OR owned) AND (NOT in_fork OR owned_seen)
), parents AS (
  SELECT sess.turn_id AS task, {", ".join(f"coalesce({x}, {1 if x.endswith('_missing') else 0}) AS {x}" for x in _ALL)} FROM sess LEFT JOIN fit ON fit.session = sess.session AND fit.turn_id = sess.turn_id
), by_model AS (
  SELECT side, owner, turn_id, model, sum(CASE WHEN src = 'recorded' THEN tok END) AS rs, sum(CASE WHEN src = 'estimated' THEN tok END) AS es, count(*) FILTER (WHERE src = 'recorded') AS rn, count(*) FILTER (WHERE src = 'estimated') AS en FROM (
    SELECT side, owner, turn_id, model, 'recorded' AS src, total_tokens AS tok FROM req WHERE valid AND side = 'agent' UNION ALL SELECT side, owner, turn_id, single_model, 'estimated', est_total FROM t2 WHERE source = 'estimated' AND side = 'agent') GROUP BY ALL
), prof0 AS (
  SELECT task, 'role' AS dimension, role AS name, {", ".join(_ALL)} FROM got
  UNION ALL SELECT task, 'model', model, coalesce(rs, 0), CAST(rn > 0 AS INTEGER), recorded_missing, coalesce(es, 0), CAST(en > 0 AS INTEGER), estimated_missing, CASE WHEN model = single_model THEN seconds ELSE 0 END, CASE WHEN model = single_model THEN seconds_known ELSE 0 END, CASE WHEN model = single_model THEN seconds_missing ELSE 1 END,
    CASE WHEN model = single_model THEN tool_calls ELSE 0 END, CASE WHEN model = single_model THEN tool_calls_known ELSE 0 END, CASE WHEN model = single_model THEN tool_calls_missing ELSE 1 END, 0, 0, 0 FROM got JOIN by_model USING (owner, turn_id)
  UNION ALL SELECT task, 'model', single_model, {", ".join(_ALL)} FROM got WHERE single_model <> 'unknown' AND NOT EXISTS (SELECT 1 FROM by_model b WHERE b.owner = got.owner AND b.turn_id = got.turn_id AND b.model = got.single_model)
), prof AS (
  SELECT task, dimension, name, {", ".join(f"sum({x}) AS {x}" for x in _ALL)} FROM prof0 WHERE name <> '' AND name <> 'unknown' GROUP BY ALL
), kids AS (
  SELECT task, {", ".join(f"sum({x}) AS {x}" for x in _ALL)} FROM got GROUP BY 1
){LABELS.format(turns="user_turns")}, obs0 AS (
  SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY file_path, turn_seq) AS k FROM user_turns WHERE status = 'complete' AND turn_id <> ''
), obs AS (
  SELECT obs0.turn_id, task_type, followup_label = 'steering' AS steering, model, effort, uses_subagents OR kids.task IS NOT NULL AS uses, {", ".join(f"p.{x} AS parent_{x}" for x in _ALL)}, {", ".join(f"kids.{x} AS agents_{x}" for x in _ALL)}
  FROM obs0 JOIN labels USING (turn_id) LEFT JOIN parents p ON p.task = obs0.turn_id LEFT JOIN kids ON kids.task = obs0.turn_id WHERE k = 1
)"""


def _res(sides: tuple[str, ...] = ("parent", "agents")) -> str:
    out = []
    for s in sides:
        for m in _M:
            out += [f"round(CAST(coalesce(sum({s}_{m}), 0) AS DOUBLE), 3) AS {s}_{m}", f"count(*) FILTER (WHERE {s}_{m}_known > 0) AS {s}_{m}_tasks", *(f"CAST(coalesce(sum({s}_{m}_{x}), 0) AS BIGINT) AS {s}_{m}_{x}" for x in ("known", "missing"))]
        out += [f"CAST(coalesce(sum({s}_{c}), 0) AS BIGINT) AS {s}_{c}" for c in _C]
    return ", ".join(out)


_NAMES = [x for s in ("parent", "agents") for x in (*(y for m in _M for y in (f"{s}_{m}", f"{s}_{m}_tasks", f"{s}_{m}_known", f"{s}_{m}_missing")), *(f"{s}_{c}" for c in _C))]
_STAT = "count(*) AS samples, count(*) FILTER (WHERE steering) AS steering_n"


def _sides(rel: str, keys: str) -> str:
    zero = ", ".join(f"coalesce({x}, 0) AS {x}" for x in ("samples", "steering_n", *_NAMES))
    return f"SELECT {keys}, uses, {zero} FROM (SELECT {keys}, u AS uses FROM (SELECT DISTINCT {keys} FROM {rel}) CROSS JOIN (SELECT unnest([true, false]) AS u)) LEFT JOIN (SELECT {keys}, uses, {_STAT}, {_res()} FROM {rel} GROUP BY ALL) USING ({keys}, uses)"


_GROUPS = ", b1 AS (SELECT '' AS cohort, * FROM obs UNION ALL SELECT task_type AS cohort, * FROM obs), b2 AS (SELECT *, model || ' / ' || effort AS route FROM obs WHERE model <> 'unknown' AND effort <> 'unknown'), b3 AS (SELECT obs.* EXCLUDE (" + ", ".join(f"agents_{x}" for x in _ALL) + "), dimension, name, " + ", ".join(f"prof.{x} AS agents_{x}" for x in _ALL) + " FROM obs JOIN prof ON prof.task = obs.turn_id)"
_LOG = "file_path IN (SELECT file_path FROM agent_files)"
_AT = "owner, turn_id"

SQL: dict[str, str] = {
    "q9_child_turns": KIDS + f" SELECT {_AT}, start_ns, end_ns, status, terminal_conflict, ambiguous, counters, usage_records, CAST(len(settings) AS INTEGER) AS settings FROM t1",
    "q10_ownership": KIDS + f" SELECT {_AT}, in_fork, owned_seen, owned, vote_conflict FROM t1",
    "a21_children": AGENTS + f" SELECT count(*) AS created, count(*) FILTER (WHERE has_depth AND depth > 1) AS nested FROM agents WHERE NOT creation_conflict AND created_ns BETWEEN {SINCE} AND {BEFORE}",
    "a22_working": KIDS + f" SELECT status, count(*) AS n FROM {_IN} GROUP BY 1",
    "a22_roles": KIDS + " SELECT role, CAST(sum(c) AS BIGINT) AS created, CAST(sum(w) AS BIGINT) AS working FROM (SELECT role, 1 AS c, 0 AS w FROM agents WHERE NOT creation_conflict AND created_ns IS NOT NULL UNION ALL SELECT role, 0, 1 FROM t3 WHERE reason = 'included') GROUP BY 1",
    "a23_settings": KIDS + f" SELECT s[1] AS model, s[2] AS effort, count(*) AS n FROM (SELECT unnest(CASE WHEN len(settings) = 0 THEN [('unknown', 'unknown')] ELSE settings END) AS s FROM {_IN}) GROUP BY ALL",
    "a24_by_role": KIDS + f" SELECT role, source, {_TOTALS} FROM {_USED} GROUP BY ALL",
    "a24_by_model": KIDS + f" SELECT model, source, {_TOTALS} FROM {_USED} GROUP BY ALL",
    "a25_requests": KIDS + f" SELECT {_AT}, response_id, {', '.join(f'CASE WHEN valid THEN {u} END AS {u}' for u in USAGE)}, valid FROM req",
    "a26_sources": KIDS + f" SELECT {_AT}, source, valid_requests, invalid_records, CAST(rec_total AS BIGINT) AS recorded_total_tokens, CASE WHEN source = 'estimated' THEN est_total END AS estimated_total_tokens FROM {_IN}",
    "a27_estimates": KIDS + f" SELECT {_AT}, state, {', '.join(f'{u} AS estimated_{u}' for u in USAGE)} FROM est",
    "a28_checks": KIDS + f" SELECT source, coalesce(chk, '') AS \"check\", state, count(*) AS n FROM {_IN} GROUP BY ALL",
    "a29_durations": KIDS + f" SELECT CAST(sum(duration_ms) AS BIGINT) AS duration_ms, count(duration_ms) AS known, count(*) FILTER (WHERE duration_ms IS NULL) AS missing, count(*) FILTER (WHERE invalid_duration) AS invalid FROM {_IN}",
    "a30_anonymous": KIDS + f" SELECT {_AT}, usage_records, anonymous AS requests FROM t3",
    "a31_tools": KIDS + f" SELECT {_AT}, tools, more_tools AS lower_bound FROM t3",
    "a32_single_model": KIDS + f" SELECT {_AT}, single_model AS model FROM t3",
    "j8_model_at": KIDS + f" SELECT {_AT}, response_id, model FROM req WHERE valid",
    "j12_response_owners": KIDS + " SELECT * FROM own_r",
    "a39_coverage": KIDS + f""" SELECT * FROM (SELECT count(*) FILTER (WHERE id = '') AS missing_ids FROM files) CROSS JOIN (SELECT count(*) FILTER (WHERE parent_id = '') AS missing_parents, count(*) FILTER (WHERE NOT has_depth) AS missing_depth, count(*) FILTER (WHERE attribute_conflict) AS disputed_agents, count(*) FILTER (WHERE created_ns IS NULL) AS no_instant FROM agents)
 CROSS JOIN (SELECT {", ".join(f"count(*) FILTER (WHERE reason = '{x}') AS {x}" for x in ("unattributed", "before_creation", "ownership_conflict", "terminal_conflict"))}, CAST(coalesce(sum(early_ends), 0) AS BIGINT) AS terminal_mismatches FROM t3)
 CROSS JOIN (SELECT count(*) FILTER (WHERE ns IS NULL OR rec_type = 'event_msg' AND NOT child_ok OR rec_type = 'event_msg' AND kind IN ('task_started', 'task_complete', 'turn_aborted') AND coalesce(turn_id, '') = '' OR rec_type IN ('turn_context', 'token_usage_record') AND (NOT child_ok OR coalesce(turn_id, '') = '')) AS malformed FROM r WHERE {_LOG})""",
    "a40_copies": AGENTS + " SELECT owner, files, role, has_depth, forked, creation_conflict, role_conflict, depth_conflict, fork_conflict, parent_conflict, attribute_conflict FROM agents",
    "a41_merged": KIDS + f" SELECT {_AT}, what, count(*) AS n, count(DISTINCT file_path) AS files, min(ns) AS first_ns, max(ns) AS last_ns FROM f GROUP BY ALL",
    "a42_terminals": KIDS + f" SELECT {_AT}, end_ns, CASE WHEN NOT terminal_conflict THEN status END AS status, terminal_conflict, early_ends FROM t3",
    "a43_reasons": KIDS + " SELECT reason, count(*) AS n FROM t3 GROUP BY 1",
    "a44_foreign": KIDS + " SELECT reason, foreign_usage, count(*) AS n FROM t3 GROUP BY ALL",
    "a47_deltas": KIDS + " SELECT DISTINCT owner, turn_id, ns, " + ", ".join(f"CASE WHEN good THEN d.{u} END AS {u}" for u in USAGE) + f", good AS valid FROM (SELECT {_T}, ns, {{{', '.join(repr(x) + ': ' + v for x, v in {**_delta('usage', 'base')[0], 'total_tokens': _delta('usage', 'base')[1]}.items())}}} AS d, {_delta('usage', 'base')[2]} AS good FROM f WHERE what = 'counter')",
    "j9_roots": WORLD + " SELECT owner, root_session FROM roots",
    "j10_links": WORLD + f" SELECT {_AT}, root_turn, root_session, link FROM links",
    "j11_turn_sessions": WORLD + " SELECT turn_id, session FROM sess",
    "a45_agents": WORLD + f" SELECT task AS root_turn, {_SUMS} FROM got GROUP BY 1",
    "a45_parents": WORLD + f" SELECT task, {_ONE} FROM parents",
    "a45_linkage": WORLD + " SELECT link, count(*) AS n FROM links GROUP BY 1",
    "j13_profiles": WORLD + f" SELECT task, dimension, name, {_ONE} FROM prof",
    "a17_cohorts": WORLD + _GROUPS + " " + _sides("b1", "cohort"),
    "a18_routing": WORLD + _GROUPS + " " + _sides("b2", "task_type, route"),
    "a19_profiles": WORLD + _GROUPS + f" SELECT task_type, dimension, name, {_STAT}, {_res()} FROM b3 GROUP BY ALL",
    "r3_comparable": WORLD + _GROUPS + """, ch AS (SELECT cohort AS task_type, '' AS dimension, '' AS name, uses, count(*) AS samples FROM b1 GROUP BY ALL UNION ALL SELECT task_type, 'routing', route, uses, count(*) FROM b2 GROUP BY ALL UNION ALL SELECT task_type, dimension, name, true, count(*) FROM b3 GROUP BY ALL)
 SELECT * FROM ch a WHERE samples >= 10 AND task_type <> 'unknown' AND EXISTS (SELECT 1 FROM ch b WHERE b.task_type = a.task_type AND b.dimension = a.dimension AND b.samples >= 10 AND (a.dimension <> 'routing' OR b.name = a.name) AND (b.name <> a.name OR b.uses <> a.uses))""",
}
