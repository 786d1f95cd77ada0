"""The queries of ``reference`` in the SQL of the checking engine, written apart from them."""

from __future__ import annotations

from strandline.operators.golden import FOLLOWUP_LABELS, HISTORY, LEAST, MECHANISM_OF, MECHANISMS, RATES, SAMPLES, SETS, STEERING_REASONS
from strandline.operators.labels import CLASSIFIERS, VERSIONS
from strandline.operators.records import USAGE

SINCE, BEFORE = 1735689600 * 10**9, 1767225600 * 10**9


def _is(path: str, *kinds: str) -> str:
    return f"coalesce(json_type(j, '$.{path}') IN ({', '.join(map(repr, (*kinds, 'NULL')))}), true)"


def _whole(path: str) -> str:
    """An integer of 64 bits, null or nothing."""
    return f"(coalesce(json_type(j, '$.{path}') = 'NULL', true) OR json_type(j, '$.{path}') IN ('BIGINT', 'UBIGINT') AND TRY_CAST(j->>'$.{path}' AS BIGINT) IS NOT NULL)"


def _int(path: str) -> str:
    return f"CASE WHEN json_type(j, '$.{path}') IN ('BIGINT', 'UBIGINT') THEN TRY_CAST(j->>'$.{path}' AS BIGINT) END"


def _texts(*paths: str) -> str:
    return " AND ".join(_is(p, "VARCHAR") for p in paths)


def _parts(path: str) -> str:
    """A content array whose parts are objects with texts as type and text."""
    each = "coalesce(json_type(x) = 'NULL', true) OR json_type(x) = 'OBJECT' AND coalesce(json_type(x, '$.type') IN ('VARCHAR', 'NULL'), true) AND coalesce(json_type(x, '$.text') IN ('VARCHAR', 'NULL'), true)"
    return f"{_is(path, 'ARRAY')} AND len(list_filter(coalesce(json_extract(j, '$.{path}[*]'), []), lambda x: NOT ({each}))) = 0"


def _usage(path: str) -> str:
    ok = f"json_type(j, '$.{path}') = 'OBJECT' AND " + " AND ".join(_whole(f"{path}.{u}") for u in USAGE)
    return "{" + ", ".join(f"'{u}': CASE WHEN {ok} THEN {_int(f'{path}.{u}')} END" for u in USAGE) + "}"


def _ns(c: str) -> str:
    return f"CASE WHEN regexp_matches(trim({c}), '^\\d{{4}}-\\d\\d-\\d\\d[Tt ]\\d\\d:\\d\\d:\\d\\d(\\.\\d{{1,9}})?([Zz]|[+-]\\d\\d:\\d\\d)$') THEN CAST(epoch(TRY_CAST(regexp_replace(upper(trim({c})), '\\.\\d+', '') AS TIMESTAMPTZ)) AS BIGINT) * 1000000000 + CAST(rpad(regexp_extract({c}, '\\.(\\d{{1,9}})', 1), 9, '0') AS BIGINT) END"


_FIELDS = "turn_id root_turn_id model effort name tool_name call_id role message thread_id response_id last_agent_message".split()
_TOTAL, _META = "info.total_token_usage", "internal_chat_message_metadata_passthrough"
_KINDS = f"{_is(f'{_META}.content_item_kinds', 'ARRAY')} AND len(list_filter(coalesce(json_extract(j, '$.{_META}.content_item_kinds[*]'), []), lambda x: json_type(x) NOT IN ('VARCHAR', 'NULL'))) = 0"
_CONTENT = lambda path, kind: f"[x->>'$.text' FOR x IN coalesce(json_extract(j, '$.{path}[*]'), []) IF x->>'$.type' = '{kind}' AND x->>'$.text' <> '']"
REC = f"""
WITH RECURSIVE r0 AS (
  SELECT *, CASE WHEN json_type(TRY_CAST(payload AS JSON)) = 'OBJECT' THEN TRY_CAST(payload AS JSON) END AS j FROM rollout_records
), r1 AS (
  SELECT file_path, line_no, record_id, j, j IS NOT NULL AS readable, {_ns("rec_ts")} AS ns, rec_ts, rec_type, j->>'$.type' AS kind, payload,
    {", ".join(f"j->>'$.{f}' AS {f}" for f in _FIELDS)}, {_int("duration_ms")} AS duration_ms, NOT {_whole("duration_ms")} AS bad_duration, {_int("time_to_first_token_ms")} AS ttft,
    {_usage("usage")} AS usage, {_usage(_TOTAL)} AS cnt, (j->>'$.{_TOTAL}') IS NOT NULL AS has_count, (j->>'$.info') IS NOT NULL AS has_info,
    CASE WHEN j IS NULL THEN false WHEN rec_type = 'event_msg' THEN {_texts("type", "turn_id")} AND {_whole("duration_ms")} AND {_whole("time_to_first_token_ms")} AND {_is("info", "OBJECT")} AND {_is(_TOTAL, "OBJECT")} AND {_whole(_TOTAL + ".total_tokens")}
      WHEN rec_type = 'turn_context' THEN {_texts("turn_id", "model", "effort")} WHEN rec_type = 'response_item' THEN {_texts("type", "name", "tool_name")} ELSE false END AS turn_ok,
    CASE WHEN j IS NULL THEN false WHEN rec_type = 'event_msg' THEN {_texts("type", "turn_id", "message", "last_agent_message", "item.type")} AND {_is("item", "OBJECT")} AND {_parts("item.content")}
      WHEN rec_type = 'response_item' THEN {_texts("type", "role", _META + ".turn_id")} AND {_is(_META, "OBJECT")} AND {_KINDS} AND {_parts("content")} ELSE false END AS inter_ok,
    CASE WHEN j IS NULL THEN false WHEN rec_type = 'event_msg' THEN {_texts("type", "turn_id")} WHEN rec_type = 'turn_context' THEN {_texts("turn_id", "model", "effort", "root_turn_id")}
      WHEN rec_type = 'token_usage_record' THEN {_texts("thread_id", "turn_id", "response_id", "root_turn_id")} WHEN rec_type = 'response_item' THEN {_texts("type", "call_id")} ELSE rec_type = 'compacted' END AS child_ok,
    j->>'$.{_META}.turn_id' AS input_turn_id
  FROM r0
), r AS (
  SELECT *, {", ".join(f"usage.{u} AS {u}" for u in USAGE)}, cnt.total_tokens AS counter FROM r1
)"""
_TOOL = "coalesce(rec_type = 'response_item' AND kind IN ('function_call', 'custom_tool_call'), false)"
_SPAWN = "(coalesce(regexp_matches(trim(name), '(^|[./:]|__)spawn_agent$'), false) OR coalesce(regexp_matches(trim(tool_name), '(^|[./:]|__)spawn_agent$'), false))"
_START, _END = "coalesce(rec_type = 'event_msg' AND kind = 'task_started', false)", "coalesce(rec_type = 'event_msg' AND kind IN ('task_complete', 'turn_aborted'), false)"
_STATUS = "CASE WHEN end_kind = 'task_complete' THEN 'complete' WHEN end_kind = 'turn_aborted' THEN 'aborted' ELSE 'incomplete' END"
_ORD = "(line_no, record_id)"


def TURNS_OF(files: str, name: str) -> str:
    """The turns of all files, or of those of a relation, as ``name``."""
    source = "r" if not files else f"r SEMI JOIN {files} USING (file_path)"
    started = "" if not files else " AND start_ns IS NOT NULL"
    return f""", w1 AS (
  SELECT *, {_START} AS is_start, {_END} AS is_end, CASE WHEN rec_type = 'event_msg' AND kind = 'token_count' AND has_info THEN coalesce(counter, 0) END AS c FROM {source} WHERE turn_ok
), w2 AS (
  SELECT *, sum(CAST(is_start AS INTEGER)) OVER f AS seg, coalesce(last_value(c IGNORE NULLS) OVER f, 0) AS total FROM w1 WINDOW f AS (PARTITION BY file_path ORDER BY line_no, record_id ROWS UNBOUNDED PRECEDING)
), w3 AS (
  SELECT *, max(seg) OVER (PARTITION BY file_path) AS last_seg, coalesce(sum(CAST(is_end AS INTEGER)) OVER (PARTITION BY file_path, seg ORDER BY line_no, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed,
    first_value(turn_id) OVER (PARTITION BY file_path, seg ORDER BY line_no, record_id) AS open_id FROM w2 WHERE seg > 0
), w4 AS (
  SELECT file_path, seg, arg_min_null(open_id, {_ORD}) AS turn_id, bool_or(is_end) AS ended, max(last_seg) AS last_seg, arg_min(kind, {_ORD}) FILTER (WHERE is_end) AS end_kind,
    coalesce(arg_max(model, {_ORD}) FILTER (WHERE rec_type = 'turn_context' AND coalesce(turn_id, '') = coalesce(open_id, '') AND model <> ''), 'unknown') AS model,
    coalesce(arg_max(effort, {_ORD}) FILTER (WHERE rec_type = 'turn_context' AND coalesce(turn_id, '') = coalesce(open_id, '') AND effort <> ''), 'unknown') AS effort,
    arg_min_null(ns, {_ORD}) AS start_ns, arg_max(total, {_ORD}) - arg_min(total, {_ORD}) AS tokens,
    arg_min(coalesce(duration_ms, 0), {_ORD}) FILTER (WHERE is_end) AS duration_ms, arg_min(CASE WHEN kind = 'task_complete' THEN coalesce(ttft, 0) END, {_ORD}) FILTER (WHERE is_end) AS ttft_ms,
    count(*) FILTER (WHERE {_TOOL}) AS tool_calls, bool_or({_TOOL} AND {_SPAWN}) AS uses_subagents
  FROM w3 WHERE closed = 0 GROUP BY file_path, seg
), {name} AS (
  SELECT file_path, CAST(seg AS INTEGER) AS turn_seq, turn_id, {_STATUS} AS status, model, effort, start_ns, CAST(tokens AS BIGINT) AS tokens, duration_ms, ttft_ms, tool_calls, uses_subagents FROM w4 WHERE (ended OR seg = last_seg){started}
)"""


TURNS = REC + TURNS_OF("", "turns")
_INTER = f""", i1 AS (
  SELECT *, {_START} AS is_start, {_END} AS is_end FROM r WHERE inter_ok
), i2 AS (
  SELECT file_path, line_no, record_id, is_start AND (lag(is_end) OVER f IS NULL OR lag(is_end) OVER f OR coalesce(turn_id, '') = '' OR turn_id IS DISTINCT FROM lag(turn_id) OVER f) AS fresh
  FROM i1 WHERE is_start OR is_end WINDOW f AS (PARTITION BY file_path ORDER BY line_no, record_id)
), i3 AS (
  SELECT i1.*, sum(CAST(coalesce(fresh, false) AS INTEGER)) OVER (PARTITION BY file_path ORDER BY line_no, record_id ROWS UNBOUNDED PRECEDING) AS seg FROM i1 LEFT JOIN i2 USING (file_path, line_no, record_id)
), i4 AS (
  SELECT *, coalesce(sum(CAST(is_end AS INTEGER)) OVER (PARTITION BY file_path, seg ORDER BY line_no, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed, first_value(turn_id) OVER (PARTITION BY file_path, seg ORDER BY line_no, record_id) AS open_id FROM i3 WHERE seg > 0
), i5 AS (
  SELECT file_path, seg, arg_min_null(open_id, {_ORD}) AS turn_id, arg_min_null(ns, {_ORD}) AS start_ns, arg_min(kind, {_ORD}) FILTER (WHERE is_end) AS end_kind,
    coalesce(arg_max(done, {_ORD}) FILTER (WHERE done IS NOT NULL), arg_min(said, {_ORD}) FILTER (WHERE said IS NOT NULL)) AS prompt,
    arg_min(last_agent_message, {_ORD}) FILTER (WHERE is_end AND kind = 'task_complete' AND last_agent_message IS NOT NULL) AS answer
  FROM (SELECT *, CASE WHEN rec_type = 'event_msg' AND kind = 'item_completed' AND coalesce(turn_id, '') = coalesce(open_id, '') AND j->>'$.item.type' = 'UserMessage' THEN {_CONTENT("item.content", "text")}[1] END AS done,
    CASE WHEN rec_type = 'event_msg' AND kind = 'user_message' AND message <> '' THEN message
      WHEN rec_type = 'response_item' AND kind = 'message' AND role = 'user' AND coalesce(input_turn_id, '') = coalesce(open_id, '') AND list_contains(coalesce(j->>'$.{_META}.content_item_kinds[*]', []), 'user.text') THEN nullif(array_to_string({_CONTENT("content", "input_text")}, ''), '') END AS said
    FROM i4 WHERE closed = 0) GROUP BY file_path, seg
), inter AS (
  SELECT file_path, CAST(seg AS INTEGER) AS seq, turn_id, start_ns, {_STATUS} AS status, coalesce(prompt, '') AS prompt, coalesce(answer, '') AS answer FROM i5
), follow AS (
  SELECT file_path, seq, previous_turn_id, turn_id, previous_answer, prompt FROM (
    SELECT *, lag(turn_id) OVER w AS previous_turn_id, lag(answer) OVER w AS previous_answer, lag(status) OVER w AS previous_status FROM inter WINDOW w AS (PARTITION BY file_path ORDER BY seq)
  ) WHERE status = 'complete' AND previous_status = 'complete' AND regexp_matches(prompt, '[^\\s\\p{{Z}}]')
)"""
INTER = REC + _INTER


def _pick(c: str, at: int, values: tuple[str, ...]) -> str:
    return f"[{', '.join(map(repr, values))}][ascii(substr(md5({c}), {at}, 1)) % {len(values)} + 1]"


_MS = f"[{', '.join(map(repr, MECHANISMS))}]"
_FOLLOW_ON = lambda key, ms: ", ".join(f"CASE WHEN list_contains({ms}, '{m}') THEN {_pick(key, 6 + n, SETS[f])} END AS {f}" for n, (f, m) in enumerate(MECHANISM_OF.items()))
#: The stand-in labels of the turns of a relation ``turns``.
LABELS = f""", lab0 AS (
  SELECT turn_id, ['bugfix', 'bugfix', 'bugfix', 'bugfix', 'bugfix', 'tests', 'tests', 'other'][ascii(substr(md5(turn_id), 1, 1)) % 8 + 1] AS task_type, {_pick("turn_id", 2, FOLLOWUP_LABELS)} AS followup_label, {_pick("turn_id", 3, STEERING_REASONS)} AS reason, {_MS}[1:ascii(substr(md5(turn_id), 5, 1)) % 5] AS ms
  FROM (SELECT DISTINCT turn_id FROM {{turns}} WHERE turn_id <> '')
), labels AS (
  SELECT turn_id, task_type, followup_label, steering_reason, prevention_mechanisms, {_FOLLOW_ON("turn_id", "prevention_mechanisms")} FROM (SELECT turn_id, task_type, followup_label, CASE WHEN followup_label = 'steering' THEN reason END AS steering_reason, CASE WHEN followup_label = 'steering' THEN ms END AS prevention_mechanisms FROM lab0)
)"""
OBS = TURNS + LABELS.format(turns="turns") + """, obs AS (
  SELECT turn_id, task_type, followup_label = 'steering' AS steering, tokens, duration_ms / 1000.0 AS seconds, tool_calls AS tools, model, effort, uses_subagents AS uses
  FROM (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY file_path, turn_seq) AS k FROM turns WHERE status = 'complete' AND turn_id <> '') JOIN labels USING (turn_id) WHERE k = 1
)"""
_MARKED = "SELECT file_path FROM r WHERE contains(payload, 'token tally') AND (rec_type = 'event_msg' AND kind = 'user_message' AND contains(message, 'token tally') AND " + _texts("type", "message") + " OR rec_type = 'response_item' AND kind = 'message' AND role = 'user' AND " + _texts("type", "role") + " AND " + _parts("content") + " AND len(list_filter(coalesce(json_extract(j, '$.content[*]'), []), lambda x: contains(x->>'$.text', 'token tally'))) > 0)"
#: The files of user sessions.
USERS = _INTER + """, marked AS (
  """ + _MARKED + """
), users AS (
  SELECT file_path, coalesce(j->>'$.id', '') AS id, coalesce(j->>'$.forked_from_id', '') <> '' AS forked FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY line_no, record_id) AS k FROM r WHERE rec_type = 'session_meta')
  WHERE k = 1 AND readable AND """ + _texts("id", "originator", "thread_source", "forked_from_id") + """ AND j->>'$.thread_source' = 'user' AND file_path NOT IN (SELECT file_path FROM marked) AND file_path IN (SELECT file_path FROM inter WHERE start_ns IS NOT NULL)
)"""
_STATS = "count(*) AS samples, count(*) FILTER (WHERE steering) AS steering_n, round(count(*) FILTER (WHERE steering) / count(*), 6) AS steering_rate, round(avg(greatest(tokens, 0)), 6) AS mean_tokens, round(avg(seconds), 6) AS mean_seconds, round(avg(tools), 6) AS mean_tools"
_AVG = "round(sum(tokens) / count(*), 6) AS mean_tokens, round(sum(duration_ms) / count(*) / 1000.0, 6) AS mean_seconds, round(sum(tool_calls) / count(*), 6) AS mean_tools"
_TOKENS = " AND ".join(f"coalesce({p} >= 0 AND {p} <= tot, true)" for p in USAGE[:-1])
_VALID = f"coalesce(tot >= 0, false) AND {_TOKENS} AND coalesce(input_tokens + output_tokens = tot, true) AND coalesce(cached_input_tokens <= input_tokens, true) AND coalesce(reasoning_output_tokens <= output_tokens, true)"
_USED = REC + f""", u AS (
  SELECT *, {_VALID} AS valid FROM (SELECT *, coalesce(total_tokens, input_tokens + output_tokens) AS tot FROM r WHERE rec_type = 'token_usage_record' AND readable)
)"""
#: Inputs of a labeling: interactions with the last follow-up of their turn.
_INPUTS = INTER + """, inputs AS (
  SELECT t.turn_id, t.prompt, f.followup_id, f.followup, f.previous_answer FROM (SELECT coalesce(turn_id, '') AS turn_id, prompt FROM inter) t LEFT JOIN (
    SELECT coalesce(previous_turn_id, '') AS turn_id, arg_max_null(turn_id, (file_path, seq)) AS followup_id, arg_max(prompt, (file_path, seq)) AS followup, arg_max(previous_answer, (file_path, seq)) AS previous_answer FROM follow GROUP BY 1) f USING (turn_id)
  WHERE t.prompt <> '' OR f.followup IS NOT NULL
)"""
_ENDED = lambda ps: ", ".join(f"{p}, chr(0)" for p in ps)
_KEY = "'semantic:' || sha256(concat(" + _ENDED([*map(repr, VERSIONS), "'m'", "'low'", "turn_id", "prompt"]) + ", CASE WHEN followup IS NOT NULL THEN concat(" + _ENDED(["coalesce(followup_id, '')", "followup", "coalesce(previous_answer, '')"]) + ") ELSE '' END))"
_CASES = f"""
WITH c AS (
  SELECT *, {_FOLLOW_ON("case_id", "prevention_mechanisms")} FROM cases
)"""
_SAID = ", ".join(f"CASE WHEN ascii(substr(md5(case_id), {10 + n}, 1)) % 4 = 0 THEN {_pick('case_id', 1 + n, v)} ELSE {f} END AS p_{f}" for n, (f, v) in enumerate(SETS.items()))
_GOLD = _CASES + f""", g AS (
  SELECT *, {_SAID}, CASE WHEN ascii(substr(md5(case_id), 9, 1)) % 2 = 0 THEN prevention_mechanisms ELSE {_MS}[1:ascii(substr(md5(case_id), 5, 1)) % 5] END AS p_ms FROM c
), x AS (
  {" UNION ALL ".join(f"SELECT '{f}' AS field, nullif({f}, '') AS expected, p_{f} AS predicted FROM g" for f in SETS)}
)"""
_SIDES = "SELECT {keys}, u AS uses FROM (SELECT DISTINCT {keys} FROM {rel}) CROSS JOIN (SELECT unnest([true, false]) AS u)"
_SHARE = "SELECT * FROM (SELECT {f} AS label, count(*) AS n FROM labels WHERE {f} IS NOT NULL GROUP BY 1) WHERE {w} ORDER BY n DESC, label LIMIT 1"
_HAS = lambda f: f"coalesce({f}, '') <> ''"
_LATE = " OR ".join(_HAS(f) for f in [*SETS][1:])
_OTHER = "coalesce(followup_label, '') NOT IN ('', 'steering')"
_M0 = "coalesce(prevention_mechanisms, [])"
_VIOLATIONS = [
    ("NOT regexp_matches(coalesce(case_id, ''), '^case-[0-9a-f]{2,}$')", "invalid id"), ("k > 1", "duplicate id"), ("coalesce(prompt, '') = '' AND coalesce(followup_prompt, '') = ''", "no input"),
    (f"NOT ({_HAS('task_type')} OR {_LATE}) AND prevention_mechanisms IS NULL", "nothing expected"), *((f"{_HAS(f)} AND {f} NOT IN {tuple(v)}", f"unknown {f}") for f, v in SETS.items()),
    (f"{_HAS('task_type')} AND coalesce(prompt, '') = ''", "task type without prompt"), (f"coalesce(followup_prompt, '') = '' AND ({_LATE} OR prevention_mechanisms IS NOT NULL)", "label without follow-up"),
    (f"len(list_filter({_M0}, lambda m: NOT list_contains({_MS}, m))) > 0", "unknown mechanism"), (f"len(list_distinct({_M0})) < len({_M0})", "duplicate mechanism"), (f"{_OTHER} AND {_HAS('steering_reason')}", "reason without steering"),
    (f"{_OTHER} AND ({' OR '.join(_HAS(f) for f in MECHANISM_OF)} OR len({_M0}) > 0)", "steering field without steering"), *((f"prevention_mechanisms IS NOT NULL AND {_HAS(f)} AND NOT list_contains(prevention_mechanisms, '{m}')", f"{f} without mechanism") for f, m in MECHANISM_OF.items()),
]
_RULES = [
    ("prompt = '' AND task_type IS NOT NULL", "task type without prompt"), (f"prompt <> '' AND coalesce(task_type NOT IN {SETS['task_type']}, true)", "task type"),
    (f"followup IS NULL AND ({' OR '.join(f'{f} IS NOT NULL' for f in [*SETS][1:])} OR np OR len({_M0}) > 0)", "follow-up field without follow-up"), (f"followup IS NOT NULL AND coalesce(followup_label NOT IN {SETS['followup_label']}, true)", "follow-up label"),
    (f"followup IS NOT NULL AND followup_label <> 'steering' AND ({' OR '.join(f'{f} IS NOT NULL' for f in [*SETS][2:])} OR np OR len({_M0}) > 0)", "steering field without steering"), (f"followup IS NOT NULL AND followup_label = 'steering' AND coalesce(steering_reason NOT IN {SETS['steering_reason']}, true)", "steering reason"),
    (f"followup IS NOT NULL AND followup_label = 'steering' AND (len(list_filter({_M0}, lambda m: NOT list_contains({_MS}, m))) > 0 OR len(list_distinct({_M0})) < len({_M0}))", "mechanisms"), (f"followup IS NOT NULL AND followup_label = 'steering' AND (len({_M0}) > 0) = np", "not_preventable against mechanisms"),
    *((f"followup IS NOT NULL AND followup_label = 'steering' AND CASE WHEN list_contains({_M0}, '{m}') THEN coalesce({f} NOT IN {SETS[f]}, true) ELSE {f} IS NOT NULL END", f) for f, m in MECHANISM_OF.items()),
]
_FIRST = lambda rules: "CASE " + " ".join(f"WHEN {c} THEN '{p}'" for c, p in rules) + " END"
_CASE_IN = "SELECT case_id AS turn_id, coalesce(prompt, '') AS prompt, nullif(followup_prompt, '') AS followup, coalesce(previous_answer, '') AS previous_answer, followup_label, prevention_mechanisms FROM cases"


def _classifier(c) -> str:
    if c.field == "task_type":
        where, parts = "prompt <> ''", ["prompt"]
    else:
        where, parts = "followup IS NOT NULL", ["previous_answer", "followup"]
        where += f" AND followup_label = '{c.label}'" if c.label else ""
        where += f" AND list_contains(prevention_mechanisms, '{c.mechanism}')" if c.mechanism else ""
    key = ", chr(0), ".join([f"'{c.version}'", "turn_id", *parts])
    return f"SELECT '{c.name}' AS classifier, turn_id, '{c.name}:' || sha256(concat({key})) AS cache_key FROM ci WHERE {where}"


_CLASSIFIED = f"WITH ci AS ({_CASE_IN}), k AS ({' UNION ALL '.join(map(_classifier, CLASSIFIERS.values()))})"


def _redact(c: str) -> str:
    t = f"coalesce({c}, '')"
    for pattern, name in (
        ("(?s)```.*?```", "[redacted code]"), ("(?i)\\b[A-Z0-9._%+\\-]+@[A-Z0-9.\\-]+\\.[A-Z]{2,}\\b", "[redacted email]"),
        ("(?i)\\b(?:bearer\\s+|token\\s*[=:]\\s*|api[_-]?key\\s*[=:]\\s*|sk-[a-z0-9_-]+|gh[pousr]_[a-z0-9_-]+)[^\\s,;]*", "[redacted token]"), ("/Users/[^\\s\"'']+|/home/[^\\s\"'']+|[A-Za-z]:\\\\Users\\\\[^\\s\"'']+", "[redacted local path]"),
    ):
        t = f"regexp_replace({t}, '{pattern}', '{name}', 'g')"
    return f"(SELECT CASE WHEN length(t) > 2400 THEN left(t, 1200) || chr(10) || '...[truncated]...' || chr(10) || right(t, 1200) ELSE t END FROM (SELECT {t} AS t))"


_AT = lambda at, f: f"CASE WHEN {{}} THEN {_pick('turn_id', at, SETS[f])} END"
_GIVEN = {"task_type": "prompt <> ''", "followup_label": "followup IS NOT NULL", "steering_reason": "steers", **{f: f"steers AND list_contains(ms, '{m}')" for f, m in MECHANISM_OF.items()}}
_CONFIDENT = dict(zip(SETS, ("task_confidence", "followup_confidence", "steering_reason_confidence", "prompt_issue_confidence", "agents_rule_confidence", "skill_confidence", "validation_confidence")))
#: What the rule labeler says of the cases.
_RULED = f"""
WITH ci AS ({_CASE_IN}), k AS (
  SELECT turn_id, prompt, followup, coalesce(followup IS NOT NULL AND {_pick("turn_id", 2, FOLLOWUP_LABELS)} = 'steering', false) AS steers, {_MS}[1:ascii(substr(md5(turn_id), 5, 1)) % 4] AS ms FROM ci WHERE prompt <> '' OR followup IS NOT NULL
), ruled AS (
  SELECT turn_id, {", ".join(_AT({"task_type": 1, "followup_label": 2, "steering_reason": 3}.get(f, 3 + n), f).format(_GIVEN[f]) + f" AS {f}, CASE WHEN {_GIVEN[f]} THEN 1.0::DOUBLE END AS {_CONFIDENT[f]}" for n, f in enumerate(SETS))},
    CASE WHEN steers THEN array_to_string(ms, ',') END AS prevention_mechanisms, steers AND len(ms) = 0 AS not_preventable, CASE WHEN steers AND len(ms) > 0 THEN 1.0::DOUBLE END AS prevention_confidence FROM k
)"""
_SNAPSHOT = INTER + ", fl AS (SELECT previous_turn_id AS turn_id FROM follow)" + LABELS.format(turns="fl") + """, sn AS (
  SELECT cohort, count(*) AS samples, round(count(*) FILTER (WHERE followup_label = 'steering') * 100.0 / count(*), 6) AS steering_rate FROM (SELECT '' AS cohort, followup_label FROM fl JOIN labels USING (turn_id) UNION ALL SELECT task_type, followup_label FROM fl JOIN labels USING (turn_id)) GROUP BY 1
)"""
_ONCE = _SNAPSHOT + TURNS_OF("", "turns") + f""", av AS (SELECT {_AVG} FROM turns WHERE status = 'complete'), vals AS (
  SELECT 'tasks' AS metric, CAST(count(*) AS DOUBLE) AS value FROM inter UNION ALL SELECT s, count(*) FILTER (WHERE status = s) FROM inter, (SELECT unnest(['complete', 'aborted', 'incomplete']) AS s) GROUP BY s
  UNION ALL SELECT 'followups', count(*) FROM follow UNION ALL SELECT 'mean_tokens', mean_tokens FROM av UNION ALL SELECT 'mean_seconds', mean_seconds FROM av UNION ALL SELECT 'mean_tools', mean_tools FROM av
), hist(metric, expected, digits) AS (VALUES {", ".join(f"('{m}', {v}::DOUBLE, {n})" for m, v, n in HISTORY)}), want(cohort, expected, tolerance) AS (VALUES {", ".join(f"('{c}', {v}::DOUBLE, {t}::DOUBLE)" for c, v, t in RATES)}), guard AS (
  SELECT metric, expected, round(value, 6) AS actual, CASE WHEN coalesce(CASE WHEN digits = 0 THEN round(value, 0) ELSE round(value, 1) END <> expected, true) THEN 'mismatch' ELSE 'pass' END AS verdict FROM hist LEFT JOIN vals USING (metric)
  UNION ALL SELECT 'steering ' || CASE WHEN cohort = '' THEN 'all' ELSE cohort END, expected, steering_rate, CASE WHEN samples IS NULL OR cohort <> '' AND samples < {LEAST} OR abs(steering_rate - expected) > tolerance + 1e-9 THEN 'warning' ELSE 'pass' END FROM want LEFT JOIN sn USING (cohort)
  UNION ALL SELECT 'samples', {SAMPLES}, samples, CASE WHEN coalesce(samples, 0) <> {SAMPLES} THEN 'warning' ELSE 'pass' END FROM want LEFT JOIN sn USING (cohort) WHERE cohort = ''
)"""
_HYPOTHESIS = f"""g AS (SELECT task_type, model, effort, {_STATS} FROM obs GROUP BY ALL HAVING count(*) >= 10), pr AS (
  SELECT a.task_type, a.model, a.effort AS e1, b.effort AS e2, CASE WHEN cb < ca THEN b ELSE a END AS lo, CASE WHEN cb < ca THEN a ELSE b END AS hi FROM (SELECT *, mean_tokens + 100 * mean_seconds + 1000 * mean_tools AS ca FROM g) a JOIN (SELECT *, mean_tokens + 100 * mean_seconds + 1000 * mean_tools AS cb FROM g) b ON a.task_type = b.task_type AND a.model = b.model AND a.effort < b.effort
), hyp AS (
  SELECT task_type, model, lo.effort AS better, hi.effort AS worse, round(lo.mean_tokens + 100 * lo.mean_seconds + 1000 * lo.mean_tools, 4) AS better_cost, round(hi.mean_tokens + 100 * hi.mean_seconds + 1000 * hi.mean_tools, 4) AS worse_cost FROM pr
  WHERE lo.mean_tokens <= hi.mean_tokens AND lo.mean_seconds <= hi.mean_seconds AND lo.mean_tools <= hi.mean_tools AND lo.steering_rate <= hi.steering_rate AND (lo.mean_tokens < hi.mean_tokens OR lo.mean_seconds < hi.mean_seconds OR lo.mean_tools < hi.mean_tools) ORDER BY task_type, model, e1, e2 LIMIT 1
)"""
_NONE = "NULL::BIGINT AS samples, NULL::DOUBLE AS rate"

SQL: dict[str, str] = {
    "s3_decode": REC + " SELECT rec_type, kind, count(*) AS n, count(*) FILTER (WHERE readable) AS readable_n, count(*) FILTER (WHERE ns IS NULL) AS no_instant FROM r GROUP BY ALL",
    "s6_file_status": REC + " SELECT file_path, count(*) AS records, count(*) FILTER (WHERE NOT readable) AS unreadable FROM r GROUP BY 1",
    "f1_as_of": REC + f" SELECT file_path, count(*) AS n FROM r WHERE ns IS NULL OR ns <= {BEFORE} GROUP BY 1",
    "f2_as_of_strict": REC + f" SELECT file_path, count(*) AS n FROM r WHERE ns <= {BEFORE} GROUP BY 1",
    "f3_window": TURNS + f" SELECT status, count(*) AS n FROM turns WHERE start_ns BETWEEN {SINCE} AND {BEFORE} GROUP BY 1",
    "f4_user_sessions": "SELECT project, count(*) AS files, count(DISTINCT id) AS ids FROM sessions WHERE lower(trim(thread_source)) = 'user' GROUP BY 1",
    "f6_originator": "SELECT originator = 'ci_runner' AS excluded, count(*) AS n FROM sessions GROUP BY 1",
    "f7_tool_calls": REC + f" SELECT coalesce(name, tool_name) AS tool, {_SPAWN} AS spawn, count(*) AS n FROM r WHERE {_TOOL} GROUP BY ALL",
    "f11_not_blank": "SELECT status, count(*) AS n FROM interactions WHERE regexp_matches(prompt, '[^\\s\\p{Z}]') GROUP BY 1",
    "q1_turns": TURNS + " SELECT * FROM turns",
    "q6_interactions": INTER + " SELECT * FROM inter",
    "a1_totals": TURNS + " SELECT count(DISTINCT file_path) AS sessions, count(*) AS turns, count(*) FILTER (WHERE status = 'complete') AS completed, CAST(sum(tokens) FILTER (WHERE status = 'complete') AS BIGINT) AS sum_tokens, CAST(sum(duration_ms) FILTER (WHERE status = 'complete') AS BIGINT) AS sum_duration_ms, CAST(sum(tool_calls) FILTER (WHERE status = 'complete') AS BIGINT) AS sum_tool_calls FROM turns",
    "a2_statuses": TURNS + " SELECT status, count(*) AS n FROM turns GROUP BY 1",
    "a3_models": TURNS + " SELECT model, effort, count(*) AS n FROM turns GROUP BY ALL",
    "a4_averages": TURNS + f" SELECT {_AVG} FROM turns WHERE status = 'complete'",
    "a5_snapshot": TURNS + _INTER + f" SELECT * FROM (SELECT count(*) AS tasks, count(*) FILTER (WHERE status = 'complete') AS complete, count(*) FILTER (WHERE status = 'aborted') AS aborted, count(*) FILTER (WHERE status = 'incomplete') AS incomplete FROM inter) CROSS JOIN (SELECT {_AVG} FROM turns WHERE status = 'complete')",
    "a6_label_shares": "SELECT followup_label AS label, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM cases WHERE followup_label IS NOT NULL GROUP BY 1",
    "a7_behaviour": "SELECT " + ", ".join(f"count(*) FILTER (WHERE followup_label = '{x}') AS {x}" for x in FOLLOWUP_LABELS) + ", round(count(*) FILTER (WHERE followup_label = 'steering') / count(followup_label), 6) AS steering_rate FROM cases",
    "a8_task_types": "SELECT task_type AS label, count(*) AS n FROM cases WHERE task_type IS NOT NULL GROUP BY 1",
    "a9_steering_by_type": "SELECT task_type, count(*) AS followups, count(*) FILTER (WHERE followup_label = 'steering') AS steering_n, round(count(*) FILTER (WHERE followup_label = 'steering') / count(*), 6) AS rate FROM cases WHERE task_type IS NOT NULL AND followup_label IS NOT NULL GROUP BY 1",
    "a10_mechanisms": "WITH c AS (SELECT case_id, CASE WHEN len(prevention_mechanisms) = 0 THEN ['not_preventable'] ELSE list_distinct(prevention_mechanisms) END AS m FROM cases WHERE prevention_mechanisms IS NOT NULL) SELECT mechanism, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM c), 6) AS pct FROM (SELECT unnest(m) AS mechanism FROM c) GROUP BY 1",
    "j1_observations": OBS + " SELECT turn_id, task_type, steering, tokens, round(seconds, 6) AS seconds, tools, model, effort, uses FROM obs",
    "a12_overall": OBS + f" SELECT {_STATS} FROM obs",
    "a13_by_type": OBS + f" SELECT task_type, {_STATS} FROM obs GROUP BY 1",
    "a14_models": OBS + f" SELECT * EXCLUDE (k) FROM (SELECT *, count(*) OVER (PARTITION BY task_type) AS k FROM (SELECT task_type, model, effort, {_STATS} FROM obs GROUP BY ALL HAVING count(*) >= 10)) WHERE k >= 2",
    "a15_agents": OBS + f" SELECT * EXCLUDE (k, low) FROM (SELECT *, count(*) OVER () AS k, min(samples) OVER () AS low FROM (SELECT uses, {_STATS} FROM obs GROUP BY 1)) WHERE k = 2 AND low >= 10",
    "a16_agents_by_type": OBS + f" SELECT * EXCLUDE (k, low) FROM (SELECT *, count(*) OVER w AS k, min(samples) OVER w AS low FROM (SELECT task_type, uses, {_STATS} FROM obs GROUP BY ALL) WINDOW w AS (PARTITION BY task_type)) WHERE k = 2 AND low >= 10",
    "a20_coverage": REC + " SELECT file_path, count(total_tokens) AS known, count(*) FILTER (WHERE total_tokens IS NULL) AS missing, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS total, round(sum(total_tokens) / count(total_tokens), 6) AS mean FROM r WHERE rec_type = 'token_usage_record' AND readable GROUP BY 1",
    "a46_validated": _USED + f" SELECT record_id, {', '.join(USAGE[:-1])}, tot AS total_tokens, valid FROM u",
    "a38_top_reason": "SELECT steering_reason AS label, count(*) AS n FROM cases WHERE steering_reason <> 'other' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1",
    "o6_extremes": OBS + f", g AS (SELECT task_type, {_STATS} FROM obs WHERE task_type NOT IN ('', 'unknown', 'other') GROUP BY 1 HAVING count(*) >= 10), l AS (SELECT * FROM g ORDER BY steering_rate, task_type LIMIT 1), h AS (SELECT * FROM g ORDER BY steering_rate DESC, task_type LIMIT 1) SELECT l.task_type AS lowest, l.steering_rate AS lowest_rate, h.task_type AS highest, h.steering_rate AS highest_rate FROM l, h WHERE (SELECT count(*) FROM g) >= 2 AND l.steering_rate < h.steering_rate",
    "s4_first_meta": REC + " SELECT file_path, j->>'$.id' AS id, j->>'$.originator' AS originator, j->>'$.thread_source' AS thread_source, j->>'$.forked_from_id' AS forked_from_id, rec_ts AS started_at FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY line_no, record_id) AS k FROM r WHERE rec_type = 'session_meta') WHERE k = 1 AND readable AND " + _texts("id", "originator", "thread_source", "forked_from_id"),
    "s5_child_meta": REC + f""", m AS (SELECT file_path, rec_ts, j, j->'$.source.subagent.thread_spawn' AS s FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY line_no, record_id) AS k FROM r WHERE rec_type = 'session_meta') WHERE k = 1 AND readable AND {_texts(*("id originator thread_source forked_from_id".split()), *(f"source.subagent.thread_spawn.{x}" for x in ("id", "parent_thread_id", "agent_role")))} AND {_whole("source.subagent.thread_spawn.depth")})
 SELECT file_path, coalesce(j->>'$.id', '') AS id, coalesce(s->>'$.parent_thread_id', '') AS parent_id, coalesce(s->>'$.agent_role', '') AS role, coalesce(CAST(s->>'$.depth' AS BIGINT), 0) AS depth, (s->>'$.depth') IS NOT NULL AS has_depth, coalesce(rec_ts, '') AS started_at, coalesce(j->>'$.forked_from_id', '') AS forked_from_id, coalesce(j->>'$.originator', '') AS originator
 FROM m WHERE json_type(s) = 'OBJECT' AND j->>'$.thread_source' = 'subagent' AND (coalesce(s->>'$.id', '') = '' OR coalesce(j->>'$.id', '') = '' OR s->>'$.id' = j->>'$.id')""",
    "f5_unmarked": REC + f", marked AS ({_MARKED}) SELECT file_path, count(*) AS n FROM r WHERE file_path NOT IN (SELECT file_path FROM marked) GROUP BY 1",
    "q8_followups": INTER + " SELECT previous_turn_id, turn_id, previous_answer, prompt FROM follow",
    "a33_accuracy": _GOLD + " SELECT field, count(*) AS samples, count(*) FILTER (WHERE expected IS NOT DISTINCT FROM predicted) AS correct, round(count(*) FILTER (WHERE expected IS NOT DISTINCT FROM predicted) / count(*), 6) AS accuracy FROM x WHERE expected IS NOT NULL GROUP BY 1",
    "a34_confusion": _GOLD + " SELECT field, expected, coalesce(predicted, '') AS predicted, count(*) AS n FROM x WHERE expected IS NOT NULL AND expected IS DISTINCT FROM predicted GROUP BY ALL UNION ALL SELECT 'prevention', e, p, count(*) FROM (SELECT array_to_string(list_sort(list_distinct(prevention_mechanisms)), ',') AS e, array_to_string(list_sort(list_distinct(coalesce(p_ms, []))), ',') AS p FROM g WHERE prevention_mechanisms IS NOT NULL) WHERE e <> p GROUP BY ALL",
    "a35_micro": _GOLD + ", s AS (SELECT len(list_intersect(prevention_mechanisms, coalesce(p_ms, []))) AS tp, len(list_distinct(prevention_mechanisms)) AS e, len(list_distinct(coalesce(p_ms, []))) AS p FROM g WHERE prevention_mechanisms IS NOT NULL) SELECT count(*) AS samples, count(*) FILTER (WHERE tp = e AND e = p) AS exact, round(CASE WHEN sum(p) > 0 THEN sum(tp) / sum(p) ELSE 0.0 END, 6) AS precision, round(CASE WHEN sum(e) > 0 THEN sum(tp) / sum(e) ELSE 0.0 END, 6) AS recall, round(CASE WHEN sum(e) + sum(p) > 0 THEN 2.0 * sum(tp) / (sum(e) + sum(p)) ELSE 0.0 END, 6) AS f1 FROM s",
    "c1_inputs": _INPUTS + " SELECT * FROM inputs",
    "c1_problems": _INPUTS + " SELECT turn_id, problem FROM (SELECT turn_id, CASE WHEN turn_id = '' THEN 'empty id' WHEN count(*) > 1 THEN 'repeated id' WHEN bool_or(NOT regexp_matches(followup, '[^\\s\\p{Z}]')) THEN 'blank follow-up' END AS problem FROM inputs GROUP BY 1) WHERE problem IS NOT NULL",
    "c5_cache_keys": _INPUTS + f" SELECT turn_id, {_KEY} AS cache_key FROM inputs",
    "j6_cache_pending": _INPUTS + f", k AS (SELECT turn_id, {_KEY} AS cache_key FROM inputs) SELECT * FROM k WHERE cache_key NOT IN (SELECT cache_key FROM k WHERE right(turn_id, 1) IN ('0', '2', '4', '6', '8'))",
    "c11_violations": _CASES + f", v AS (SELECT * EXCLUDE (prompt), coalesce(prompt, '') AS prompt, nullif(followup_prompt, '') AS followup, coalesce(len(prevention_mechanisms) = 0, false) AS np FROM c) SELECT turn_id, problem FROM (SELECT case_id AS turn_id, {_FIRST(_RULES)} AS problem FROM v) WHERE problem IS NOT NULL",
    "c6_labels": _RULED + " SELECT * FROM ruled",
    "c12_views": _RULED + " SELECT view, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS view FROM ruled WHERE {f} IS NOT NULL" for f in SETS) + " UNION ALL SELECT 'prevention' FROM ruled WHERE followup_label = 'steering') GROUP BY 1",
    "c16_classifier_cases": _CLASSIFIED + " SELECT * FROM k",
    "j5_cascade": _CLASSIFIED + " SELECT classifier, count(*) AS cases FROM k GROUP BY 1",
    "j14_in_order": "SELECT CAST(substr(case_id, 6) AS BIGINT) AS input_idx, case_id AS turn_id, CASE WHEN CAST(substr(case_id, 6) AS BIGINT) % 3 <> 0 THEN task_type END AS task_type, CAST(substr(case_id, 6) AS BIGINT) % 3 <> 0 AS found FROM cases",
    "c24_redacted": f"SELECT case_id, {_redact('prompt')} AS prompt, {_redact('previous_answer')} AS previous_answer, {_redact('followup_prompt')} AS followup_prompt FROM cases",
    "c25_candidates": _INPUTS + f", top AS (SELECT *, row_number() OVER (ORDER BY lower(prompt || chr(0) || coalesce(followup, '')), turn_id) AS k FROM inputs) SELECT 'case-' || lpad(CAST(k AS VARCHAR), 6, '0') AS id, {_redact('prompt')} AS prompt, {_redact('previous_answer')} AS previous_answer, {_redact('followup')} AS followup FROM top WHERE k <= 50",
    "c26_violations": _CASES + f", v AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY prompt, followup_prompt) AS k FROM c) SELECT case_id, problem FROM (SELECT case_id, {_FIRST(_VIOLATIONS)} AS problem FROM v) WHERE problem IS NOT NULL",
    "j7_problems": "WITH rs AS (SELECT case_id FROM cases WHERE right(case_id, 1) <> '3' UNION ALL SELECT case_id FROM cases WHERE right(case_id, 1) = '7') SELECT 'result count' AS problem, '' AS case_id WHERE (SELECT count(*) FROM cases) <> (SELECT count(*) FROM rs) UNION ALL SELECT 'duplicate result', case_id FROM rs GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'missing result', case_id FROM cases WHERE case_id NOT IN (SELECT case_id FROM rs)",
    "j3_followup_labels": INTER + ", fl AS (SELECT previous_turn_id AS turn_id FROM follow WHERE previous_turn_id <> '')" + LABELS.format(turns="fl") + ", lb AS (SELECT * FROM labels WHERE right(turn_id, 1) <> '0') SELECT turn_id, task_type, followup_label, CASE WHEN n > 1 THEN 'repeated' WHEN followup_label IS NULL THEN 'no label' END AS problem FROM (SELECT turn_id, count(*) AS n FROM fl GROUP BY 1) LEFT JOIN lb USING (turn_id)",
    "j4_type_and_label": INTER + ", fl AS (SELECT previous_turn_id AS turn_id FROM follow WHERE previous_turn_id <> '')" + LABELS.format(turns="fl") + " SELECT task_type, count(*) AS followups, count(*) FILTER (WHERE followup_label = 'steering' AND right(turn_id, 1) <> '0') AS steering_n FROM fl JOIN labels USING (turn_id) GROUP BY 1",
    "a11_recommendations": TURNS + LABELS.format(turns="turns") + " SELECT 'prompt_issue' AS field, prompt_issue AS label, count(*) AS n FROM labels WHERE prompt_issue IS NOT NULL GROUP BY 2 UNION ALL SELECT 'agents_rule', agents_rule, count(*) FROM labels WHERE agents_rule <> 'other' GROUP BY 2 UNION ALL SELECT 'skill_candidate', skill_candidate, count(*) FROM labels WHERE skill_candidate <> 'other' GROUP BY 2 HAVING count(*) >= 2",
    "a11_reasons": "SELECT steering_reason AS label, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM cases WHERE steering_reason IS NOT NULL GROUP BY 1",
    "a36_snapshot": _SNAPSHOT + " SELECT * FROM sn",
    "a37_guard": _ONCE + " SELECT * FROM guard",
    "x7_verdict": _ONCE + " SELECT count(*) FILTER (WHERE verdict <> 'pass') = 0 AS passes, count(*) FILTER (WHERE verdict = 'mismatch') > 0 AS fails FROM guard",
    "r1_hypothesis": OBS + ", " + _HYPOTHESIS + " SELECT * FROM hyp",
    "r4_insights": OBS + ", " + _HYPOTHESIS + f""", ty AS (SELECT task_type, {_STATS} FROM obs WHERE task_type NOT IN ('', 'unknown', 'other') GROUP BY 1 HAVING count(*) >= 10), v AS ({_SHARE.format(f="validation_type", w="label <> 'other'")}), rs AS ({_SHARE.format(f="steering_reason", w="true")}), pi AS ({_SHARE.format(f="prompt_issue", w="label <> 'other'")}), ar AS ({_SHARE.format(f="agents_rule", w="label <> 'other'")}), sk AS ({_SHARE.format(f="skill_candidate", w="label <> 'other'")})
 SELECT * FROM (SELECT 'strength' AS priority, 'task_type' AS kind, task_type AS label, samples, steering_rate AS rate FROM ty ORDER BY steering_rate, task_type LIMIT 1) UNION ALL SELECT * FROM (SELECT 'weakness', 'task_type', task_type, samples, steering_rate FROM ty ORDER BY steering_rate DESC, task_type LIMIT 1)
 UNION ALL SELECT 'weakness', 'steering_reason', label, {_NONE} FROM rs UNION ALL SELECT * FROM (SELECT 'high', 'validation_type', label, {_NONE} FROM v UNION ALL SELECT 'high', 'steering_reason', label, {_NONE} FROM rs WHERE NOT EXISTS (FROM v))
 UNION ALL SELECT * FROM (SELECT 'medium', 'prompt_issue', label, {_NONE} FROM pi UNION ALL SELECT 'medium', 'agents_rule', label, {_NONE} FROM ar WHERE NOT EXISTS (FROM pi)) UNION ALL SELECT 'low', 'skill_candidate', label, {_NONE} FROM sk WHERE n >= 2 UNION ALL SELECT 'low', 'routing', model || ' / ' || better, {_NONE} FROM hyp""",
}
