"""Turns of agents: what their files say, merged, counted and linked to user turns."""

import json

import pytest

from strandline.operators import children as C
from strandline.operators.records import USAGE
from strandline.plans.children import World

AT = "2026-10-01T00:00:{}Z"


def rec(at, kind, **payload):
    return AT.format(at) if len(at) <= 5 else at, kind, payload


def ev(at, kind, turn, **x):
    return rec(at, "event_msg", type=kind, turn_id=turn, **x)


def meta(id, at="00", parent="root", role="role", depth=1, fork="", source="subagent", spawn=True):
    thread = {"subagent": {"thread_spawn": {"id": id, "parent_thread_id": parent, "agent_role": role, "depth": depth}}} if spawn else {"subagent": {"other": "guardian"}}
    return rec(at, "session_meta", id=id, thread_source=source, forked_from_id=fork, source=thread if source == "subagent" else None)


def ctx(at, turn, model, root="", effort="high"):
    return rec(at, "turn_context", turn_id=turn, model=model, effort=effort, root_turn_id=root)


def usage(i=None, c=None, o=None, r=None, t=None):
    return {k: v for k, v in zip(USAGE, (i, c, o, r, t)) if v is not None}


def req(at, thread, turn, response, u, root=""):
    return rec(at, "token_usage_record", thread_id=thread, turn_id=turn, response_id=response, root_turn_id=root, usage=u)


def cnt(at, u, **x):
    return rec(at, "event_msg", type="token_count", info={"total_token_usage": u}, **x)


def begin(child, turn="turn", **m):
    return [meta(child, **m), ev("01", "task_started", turn), ctx("02", turn, "m1", root="")]


def world(spark, files, **x):
    rows = []
    for name, recs in files.items():
        rows += [(len(rows) + i, name, i + 1, at, kind, json.dumps(p)) for i, (at, kind, p) in enumerate(recs)]
    return World(spark.createDataFrame(rows, "record_id bigint, file_path string, line_no int, rec_ts string, rec_type string, payload string"), **x)


ONE = usage(100, 40, 10, 4)
DONE = ev("09", "task_complete", "turn", duration_ms=1000)


@pytest.fixture(scope="module")
def many(spark):
    """One world of many agents; each stands for a scenario of its own."""
    dur = {"none": [None], "zero": [0], "negative": [-1], "text": ["1000"], "twice": [1000, 1000], "half": [None, 1000], "differ": [1000, 2000], "fraction": [1.5]}
    files = {f"d-{k}": [*begin(k), *(ev("05", "task_complete", "turn", duration_ms=v) for v in vs)] for k, vs in dur.items()}
    files |= {
        "aborted": [*begin("aborted"), ev("05", "turn_aborted", "turn", duration_ms=1000)],
        "copy1": (same := [*begin("copied"), req("03", "copied", "turn", "cp", ONE), DONE]), "copy2": same, "copy3": [*same[:3]],
        "models": [*begin("models"), req("03", "models", "turn", "md1", ONE), ctx("04", "turn", "m2"), req("05", "models", "turn", "md2", usage(10, 0, 1, 0)), DONE],
        "counter": [*begin("counter"), ctx("04", "turn", "m2"), cnt("05", ONE), DONE],
        "one": [*begin("one"), req("03", "one", "turn", "shared", ONE)], "two": [*begin("two"), req("03", "two", "turn", "shared", ONE)],
        "overflow": [*begin("overflow"), req("03", "overflow", "turn", "ov1", usage(t=2**63 - 1)), req("04", "overflow", "turn", "ov2", usage(t=1)), req("05", "overflow", "turn", "ov3", {"total_tokens": 2**63})],
        "overlap": [*begin("overlap"), cnt("03", ONE), ev("04", "task_started", "second"), cnt("05", usage(120, 0, 10, 0))],
        "snapshots": [*begin("snapshots"), cnt("03", usage(100, 0, 10, 0)), cnt("2026-10-01T03:00:03+03:00", usage(120, 0, 10, 0))],
        "steps": [*begin("steps"), cnt("03", usage(50, 0, 10, 0)), cnt("04", usage(70, 0, 20, 0)), cnt("2026-10-01T00:00:04+00:00", usage(70, 0, 20, 0))],
        "falls": [*begin("falls"), cnt("03", usage(50, 0, 10, 0)), cnt("04", usage(10, 0, 5, 0))],
        "compacted": [*begin("compacted")[:1], rec("00", "compacted"), *begin("compacted")[1:], cnt("03", usage(50, 0, 10, 0))],
        "other-counter": [*begin("other"), req("03", "other", "turn", "oc", ONE), cnt("04", ONE, turn_id="elsewhere")],
        "agree": [*begin("agree"), req("03", "agree", "turn", "ag", usage(100, t=110)), req("04", "agree", "turn", "ag", usage(100, 40, 10, 4)), req("05", "agree", "turn", "ag2", usage(1, t=1)), req("05", "agree", "turn", "ag2", usage(2, t=2)), req("06", "agree", "turn", "", ONE), cnt("07", ONE)],
        "before": [*begin("before"), req("00", "before", "turn", "early", ONE)],
        "both-ends": [*begin("both"), ev("05", "task_complete", "turn"), ev("05", "turn_aborted", "turn")], "orphan1": [meta("orphan"), *[ev("01", "task_complete", "nostart")] * 2], "orphan2": [meta("orphan"), ev("2026-10-01T03:00:01+03:00", "task_complete", "nostart")],
        "fork-foreign": [*begin("ff", fork="x"), req("03", "parent", "turn", "f1", ONE)], "fork-own": [*begin("fo", fork="x"), req("03", "fo", "turn", "f2", ONE), cnt("04", ONE)], "fork-split": [*begin("fs", fork="x"), req("03", "fs", "turn", "f3", ONE), req("04", "parent", "turn", "f4", ONE)],
        "role1": begin("roles", role="a"), "role2": begin("roles", role="b"), "forks1": begin("forks"), "forks2": [*begin("forks", fork="x"), req("03", "forks", "turn", "fk", ONE)],
        "bare": [meta("bare", parent="", role="", depth=None), ev("01", "task_started", "turn")], "late-made": [meta("late", at="08"), ev("01", "task_started", "turn")], "noid": [meta("", parent="")], "deep": [meta("deep", depth=2)],
        "guardian": [meta("guardian", spawn=False), ev("05", "task_started", "g")], "bad": [*begin("bad"), ("nope", "event_msg", {}), ev("03", "task_started", ""), rec("03", "turn_context", turn_id=5), rec("03", "token_usage_record", thread_id="bad"), rec("03", "event_msg", type=7)],
        "restart": [*begin("restart"), ev("02", "task_started", "turn"), cnt("03", ONE), ev("00", "task_complete", "turn"), rec("04", "response_item", type="function_call", call_id="c1"), rec("04", "response_item", type="custom_tool_call"), DONE, rec("10", "response_item", type="function_call", call_id="c2")],
    }
    w = world(spark, files)
    turns = {(r.owner, r.turn_id): r for r in w.turns.collect()}
    return w, turns, {r.owner: r for r in w.agents.collect()}


def test_durations(many):
    got = {k: (r.duration_ms, r.invalid_duration) for (k, _), r in many[1].items() if k in ("none", "zero", "negative", "text", "twice", "half", "differ", "fraction", "aborted")}
    assert got == {"none": (None, False), "zero": (0, False), "negative": (None, True), "text": (None, True), "twice": (1000, False), "half": (1000, False), "differ": (None, True), "fraction": (None, True), "aborted": (None, False)}
    assert many[1]["text", "turn"].status == "complete" and many[1]["aborted", "turn"].status == "aborted"


def test_usage_and_its_sources(many):
    _, turns, _ = many
    of = lambda k, turn="turn": turns[k, turn]
    assert (of("copied").recorded_total_tokens, of("copied").valid_requests, of("copied").reason) == (110, 1, "included")
    assert [(of(k).valid_requests, of(k).invalid_requests, of(k).source) for k in ("one", "two")] == [(0, 1, "missing")] * 2
    assert (of("overflow").source, of("overflow").overflow, of("overflow").recorded_total_tokens, of("overflow").invalid_requests) == ("recorded", True, None, 1)
    assert (of("agree").valid_requests, of("agree").recorded_total_tokens, of("agree").recorded_cached_input_tokens, of("agree").invalid_records, of("agree").check) == (1, 110, 40, 2, "equal")
    assert (of("before").source, of("before").invalid_requests) == ("missing", 1)
    assert (of("other").source, of("other").state, of("other").check) == ("recorded", "invalid", "unverifiable")
    states = {k: (of(k).state, of(k).source, of(k).estimated_total_tokens) for k in ("counter", "overlap", "snapshots", "steps", "falls", "compacted", "restart")}
    assert states == {"counter": ("valid", "estimated", 110), "overlap": ("invalid", "missing", None), "snapshots": ("invalid", "missing", None), "steps": ("valid", "estimated", 90), "falls": ("invalid", "missing", None), "compacted": ("invalid", "missing", None), "restart": ("valid", "estimated", 110)}
    assert of("overlap", "second").state == "invalid" and of("fo").state == "missing"
    assert (of("restart").tools, of("restart").more_tools, of("restart").early_ends) == (1, True, 1)


def test_models_of_requests_and_estimates(many):
    w, _, _ = many
    rows = C.usage_rows(w.facts, w.counted).where("owner in ('models', 'counter')").collect()
    assert {(r.owner, r.source, r.model): r.total_tokens for r in rows} == {("models", "recorded", "m1"): 110, ("models", "recorded", "m2"): 11, ("counter", "estimated", "unknown"): 110}


def test_reasons_and_conflicts(many):
    _, turns, agents = many
    assert {k: turns[k, "turn"].reason for k in ("ff", "fo", "fs", "both", "roles", "forks", "late", "bare")} == {"ff": "unattributed", "fo": "included", "fs": "unattributed", "both": "terminal_conflict", "roles": "conflict", "forks": "conflict", "late": "before_creation", "bare": "included"}
    assert turns["orphan", "nostart"].early_ends == 1 and turns["orphan", "nostart"].reason == "outside"
    assert (agents["roles"].role, agents["roles"].role_conflict, agents["forks"].forked, agents["forks"].fork_conflict, agents["copied"].files) == ("unknown", True, False, True, 3)
    assert (agents["bare"].role, agents["bare"].has_depth, agents["bare"].parent_id) == ("unknown", False, "") and "guardian" not in agents and "" not in agents and agents["deep"].depth == 2


def test_malformed_records(many):
    w, _, _ = many
    bad = w.records.join(w.owners.where("owner = 'bad'").select("file_path"), "file_path", "left_semi")
    assert bad.where(C.malformed()).count() == 5


def test_windows_are_independent(spark):
    day = 86400 * 10**9
    since = 1790812800 * 10**9  # 2026-10-01
    files = {"older": [meta("older", at="2026-09-30T23:00:00Z"), ev("00", "task_started", "edge"), ev("2026-10-02T00:00:00Z", "task_complete", "edge"), ev("2026-10-02T00:00:00.000000001Z", "task_started", "late")], "newer": [meta("newer", at="2026-10-02T00:00:00Z")]}
    w = world(spark, files, since_ns=since, before_ns=since + day)
    assert [(r.turn_id, r.status) for r in w.counted.collect()] == [("edge", "complete")]
    assert [r.owner for r in w.agents.where(f"created_ns between {since} and {since + day}").collect()] == ["newer"]


def test_nested_agents_end_to_end(spark):
    u = lambda n: usage(n, n // 2, 10, 4)
    said = {"message": "x"}
    user = [
        meta("root", source="user"), ev("01", "task_started", "u1"), ev("02", "user_message", "u1", **said), ctx("02", "u1", "pm", "u1"), req("11", "root", "u1", "p1", u(20), "u1"), cnt("11", u(200)), ev("12", "task_complete", "u1", duration_ms=10000),
        ev("20", "task_started", "u2"), ev("21", "user_message", "u2", **said), ctx("21", "u2", "pm", "u2"), cnt("38", usage(230, 100, 20, 4)), ev("40", "task_complete", "u2", duration_ms=20000),
    ]
    first, call, end = req("05", "child", "c1", "cr", u(100), "u1"), rec("04", "response_item", type="function_call", call_id="k"), ev("10", "task_complete", "c1", duration_ms=8000)
    child = [
        meta("child", at="02", role="reviewer"), ev("03", "task_started", "c1"), ctx("04", "c1", "actual", "u1"), first, first, call, call, cnt("09", usage(999, 0, 0, 0)), end, end,
        ev("22", "task_started", "c2"), ctx("23", "c2", "other", "u2"), req("24", "child", "c2", "cr2", u(50), "u2"), ev("30", "task_complete", "c2", duration_ms=7000),
    ]
    nested = [
        meta("nested", at="04", parent="child", role="researcher", depth=2, fork="child"), ev("03", "task_started", "c1"), ctx("04", "c1", "copied", "u1"), first, end,
        ev("05", "task_started", "n1"), ctx("06", "n1", "nested-model", "u1"), req("07", "nested", "n1", "nr", u(200), "u1"), rec("08", "response_item", type="custom_tool_call", call_id="n"), ev("09", "task_complete", "n1", duration_ms=4000),
    ]
    files = {"user": user, "child": child, "copy": child, "nested": nested}
    cases = {"no-root": ("", "", "root", ""), "two-roots": ("u1", "u2", "root", ""), "outside": ("out", "out", "root", ""), "no-ancestor": ("u1", "u1", "missing", ""), "cycle": ("u1", "u1", "cycle", ""), "foreign-fork": ("u1", "u1", "root", "root"), "foreign": ("u1", "u1", "root", "plain")}
    for k, (c, r, parent, fork) in cases.items():
        files[k] = [meta(k, at="02", parent=parent, fork="root" if fork == "root" else ""), ev("03", "task_started", "c"), ctx("04", "c", "m", c), req("05", "root" if fork else k, "c", f"r-{k}", u(100), r), ev("06", "task_complete", "c")]
    w = world(spark, files)
    links = {(r.owner, r.turn_id): r.link for r in w.links.collect()}
    assert links == {("child", "c1"): "linked", ("child", "c2"): "linked", ("nested", "n1"): "linked", ("nested", "c1"): "excluded", **{(k, "c"): "excluded" if k.startswith("foreign") else "unlinked" for k in cases}}
    agents = {r.root_turn: r for r in C.summed(w.linked, "root_turn").collect()}
    a = agents["u1"]
    assert (a.recorded.total, a.recorded.known, a.estimated.known, a.seconds.total, a.tool_calls.total, a.mismatches) == (320.0, 2, 0, 12.0, 2.0, 1) and agents["u2"].recorded.total == 60.0
    parents = {r.task: r for r in C.parent_metrics(w.sessions, w.all_turns).collect()}
    assert (parents["u1"].recorded.total, parents["u1"].estimated.known, parents["u1"].seconds.total, parents["u1"].mismatches) == (30.0, 0, 10.0, 1) and parents["u2"].estimated.total == 40.0
    names = {(r.task, r.dimension, r.name): r.recorded.total for r in w.profiles.collect()}
    assert names == {("u1", "role", "reviewer"): 110.0, ("u1", "role", "researcher"): 210.0, ("u1", "model", "actual"): 110.0, ("u1", "model", "nested-model"): 210.0, ("u2", "role", "reviewer"): 60.0, ("u2", "model", "other"): 60.0}
    obs = w.observations.collect()
    assert sorted((o.turn_id, o.uses) for o in obs) == [("u1", True), ("u2", True)]
