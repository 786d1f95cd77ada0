import json

import pytest

from strandline.operators import children as C
from strandline.operators import effectiveness as E
from strandline.operators import golden as G
from strandline.operators import labels as L
from strandline.operators import records as R
from strandline.operators import turns as T
from strandline.operators import usage as U
from strandline.sources import cache, rollouts

T0 = "2025-01-01T00:00:{:02d}Z"


def frame(spark, *files):
    rows, n = [], 0
    for f, recs in enumerate(files):
        for i, (kind, payload) in enumerate(recs):
            n += 1
            rows.append((n, f"f{f}", i + 1, T0.format(i), kind, payload if isinstance(payload, str | None) else json.dumps(payload)))
    return R.decode(spark.createDataFrame(rows, "record_id bigint, file_path string, line_no int, rec_ts string, rec_type string, payload string"))


def ev(kind, turn="t", **x):
    return "event_msg", {"type": kind, "turn_id": turn, **x}


def count(n):
    return "event_msg", {"type": "token_count", "info": {"total_token_usage": {"total_tokens": n}}}


def call(name, **x):
    return "response_item", {"type": "function_call", "name": name, **x}


def test_counter_reset_and_open_tail(spark):
    r = frame(spark, [count(40), ev("task_started", "a"), count(55), ev("task_complete", "a", duration_ms=7, time_to_first_token_ms=2), count(3), ev("task_started", "b"), count(8)])
    got = [(x.turn_id, x.status, x.tokens, x.duration_ms, x.ttft_ms) for x in T.turns(r).orderBy("turn_seq").collect()]
    assert got == [("a", "complete", 15, 7, 2), ("b", "incomplete", 5, None, None)]


def test_spawn_names(spark):
    names = ["spawn_agent", "agents.spawn_agent", "x/spawn_agent", "mcp__spawn_agent", "x_spawn_agent", "spawn_agents"]
    r = frame(spark, [ev("task_started"), *(call(n) for n in names), ("response_item", {"type": "message", "name": "spawn_agent"}), ev("task_complete")])
    assert [x.spawn for x in r.where(R.is_tool_call()).orderBy("line_no").select(R.is_spawn().alias("spawn")).collect()] == [True] * 4 + [False] * 2
    assert [(x.tool_calls, x.uses_subagents) for x in T.turns(r).collect()] == [(6, True)]


def test_restart_keeps_interaction_and_replaces_turn(spark):
    r = frame(spark, [ev("task_started", "a"), ev("user_message", "a", message="one"), ev("task_complete", "a", last_agent_message="A"), ev("task_started", "b"), ev("user_message", "b", message="two"), ev("task_started", "b"), ev("task_started", "c"), ev("user_message", "c", message="three"), ev("task_complete", "zzz", last_agent_message="C"), ("event_msg", None), ("event_msg", "{bad")])
    assert [(x.turn_id, x.status) for x in T.turns(r).orderBy("turn_seq").collect()] == [("a", "complete"), ("c", "complete")]
    i = T.interactions(r)
    assert [(x.turn_id, x.status, x.prompt, x.answer) for x in i.orderBy("seq").collect()] == [("a", "complete", "one", "A"), ("b", "incomplete", "two", ""), ("c", "complete", "three", "C")]
    assert T.followups(i).count() == 0  # an open interaction stands between


def test_followups_need_a_prompt(spark):
    rows = [("f", k, f"t{k}", "complete", p, f"a{k}") for k, p in enumerate(["x", "y", "  ", "z"])] + [("g", 0, "u", "complete", "q", "")]
    df = spark.createDataFrame(rows, "file_path string, seq int, turn_id string, status string, prompt string, answer string")
    assert {(r.previous_turn_id, r.turn_id, r.previous_answer) for r in T.followups(df).collect()} == {("t0", "t1", "a0"), ("t2", "t3", "a2")}


def test_model_and_effort_of_own_contexts(spark):
    ctx = lambda t, m, e="": ("turn_context", {"turn_id": t, "model": m, "effort": e})
    r = frame(spark, [ev("task_started", "a"), ctx("a", "m1", "low"), ctx("a", ""), ctx("b", "m9", "high"), ctx("a", "m2"), ev("turn_aborted", "a", duration_ms=3)])
    assert [(x.model, x.effort, x.status, x.duration_ms, x.ttft_ms) for x in T.turns(r).collect()] == [("m2", "low", "aborted", 3, None)]


@pytest.mark.parametrize("u,valid,total", [
    ((100, 40, 10, 5, 110), True, 110), ((100, None, 10, None, None), True, 110), ((None, None, None, None, 110), True, 110), ((0, 0, 0, 0, 0), True, 0), ((None,) * 5, False, None),
    ((-1, None, 1, None, 0), False, 0), ((100, 0, 10, 5, 115), False, 115), ((10, 20, 1, None, 11), False, 11), ((10, None, 1, 2, 11), False, 11), ((200, None, None, None, 110), False, 110), ((2**63 - 1, None, 1, None, None), False, None),
])
def test_usage_validity(spark, u, valid, total):
    df = spark.createDataFrame([u], ", ".join(f"{p} bigint" for p in R.USAGE))
    got = U.validated(df).collect()[0]
    assert (bool(got.valid), got.total_tokens) == (valid, total)


def test_window_ends_are_inside_to_the_nanosecond(spark):
    rows = [(1, "f", 1, "2025-01-01T00:00:00.000000001Z", "x", "{}"), (2, "f", 2, "2025-01-01T00:00:00.000000002+00:00", "x", "{}"), (3, "f", 3, "2025-01-01", "x", "{}"), (4, "f", 4, None, "x", "{}")]
    r = R.decode(spark.createDataFrame(rows, "record_id bigint, file_path string, line_no int, rec_ts string, rec_type string, payload string"))
    s = 1735689600 * 10**9
    assert [x.record_id for x in R.in_window(r, s + 1, s + 1).collect()] == [1]
    assert sorted(x.record_id for x in R.as_of(r, s + 1).collect()) == [1, 3, 4] and R.as_of(r, s + 1, strict=True).count() == 1


def test_cohorts(spark):
    rows = [(f"t{i}", "bugfix" if i % 2 else "tests", i % 3 == 0, -5 if i == 0 else 10, 1.0, 2, "m", "low", i < 19) for i in range(20)]
    obs = spark.createDataFrame(rows, "turn_id string, task_type string, steering boolean, tokens bigint, seconds double, tools bigint, model string, effort string, uses boolean")
    assert E.overall(obs).collect()[0].mean_tokens == 9.5  # a negative count is 0 here
    assert E.with_and_without(obs).count() == 0 and E.model_comparisons(obs).count() == 0
    cell, zero = "named_struct('total', 0D, 'known', 0L, 'missing', 1L)", "0L"
    none = spark.sql(f"select '' as task, {', '.join(f'{cell} as {m}' for m in C.METRICS)}, {', '.join(f'{zero} as {c}' for c in C.COUNTS)}")
    obs = E.with_evidence(obs, none, none)
    assert {(r.cohort, r.uses): r.samples for r in E.cohorts(obs).collect()} == {("", True): 19, ("", False): 1, ("bugfix", True): 9, ("bugfix", False): 1, ("tests", True): 10, ("tests", False): 0}
    assert E.routing_cohorts(obs).count() == 4


def test_labeling_pipeline(spark):
    recs = [{"turn_id": f"t{i}", "prompt": "p", "followup": "f"} for i in range(5)]
    calls, waits = [], []

    def picky(batch):
        calls.append(len(batch))
        if len(calls) == 1:
            raise L.TransientError
        if len(batch) > 2:
            raise L.InvalidAnswer
        return L.rule_labeler(batch)

    assert [a["turn_id"] for a in L.label_batch(recs, picky, wait=waits.append)] == [r["turn_id"] for r in recs]
    assert waits == [1.0] and max(calls) == 5
    with pytest.raises(L.InvalidAnswer):
        L.label_batch(recs[:1], lambda b: [])
    big = [{"turn_id": str(i), "prompt": '"' * 24 * 1024} for i in range(20)]
    plan = L.plan_batches(big)
    assert sum(map(len, plan)) == 20 and all(sum(len(L.serialise(r).encode()) + 1 for r in b) <= L.BUDGET for b in plan) and len(plan) > 1
    cut = L.cap_text("я" * 30000)
    assert len(cut.encode()) <= L.TEXT_CAP and "�" not in cut and L.cap_text("x") == "x"
    df = spark.createDataFrame([("a", "p", None, None, None), ("b", "p", "x", "c", "f")], "turn_id string, prompt string, previous_answer string, followup_id string, followup string")
    got = {r.turn_id: r.followup_label for r in L.label(df, L.rule_labeler, workers=2).collect()}
    assert got["a"] is None and got["b"] in G.FOLLOWUP_LABELS
    keys = {r.k for m in ("m", "n") for r in df.select(L.cache_key(m, "low").alias("k")).collect()}
    assert len(keys) == 4 and all(k.startswith("semantic:") for k in keys)


def test_cache_and_private_files(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert cache.read_cache(spark, path, "label string").count() == 0
    for v in ("old", "new"):
        cache.append_cache(spark.createDataFrame([("k", v)], "cache_key string, label string"), path)
    assert [tuple(r) for r in cache.read_cache(spark, path, "label string").collect()] == [("k", "new")]
    f = tmp_path / "d" / "fixture.json"
    cache.write_private(str(f), {"cases": []})
    assert f.stat().st_mode & 0o777 == 0o600 and cache.read_fixture(str(f)) == {"cases": []}
    cache.write_private(str(f), {"other": 1})
    with pytest.raises(ValueError):
        cache.read_fixture(str(f))


def test_answers_and_their_problems(spark):
    full = {"turn_id": "t", "task_type": "bugfix", "task_confidence": 0.5, "followup_label": "steering", "followup_confidence": 1.0, "steering_reason": "other", "steering_reason_confidence": 1.0, "prevention_mechanisms": ["skill"], "not_preventable": False, "prevention_confidence": 0.1, "skill_candidate": "other", "skill_confidence": 1.0}
    record = {"turn_id": "t", "prompt": "p", "followup_id": "u", "followup": "f", "previous_answer": ""}
    wrong = {
        None: {}, "task type": {"task_type": "none"}, "not_preventable": {"not_preventable": None}, "follow-up label": {"followup_confidence": None}, "steering field without steering": {"followup_label": "question"}, "steering reason": {"steering_reason": None},
        "mechanisms": {"prevention_mechanisms": ["skill", "skill"]}, "not_preventable against mechanisms": {"not_preventable": True}, "prevention confidence": {"prevention_confidence": None}, "skill_candidate": {"skill_candidate": None}, "validation_type": {"validation_type": "tests"},
    }
    assert [L.answer_problem(record, full | x) for x in wrong.values()] == [*wrong]
    assert L.answer_problem(record | {"followup": None}, full) == "follow-up field without follow-up" and L.answer_problem(record | {"prompt": ""}, full) == "task type without prompt"
    rows = [{**record, **{n: None for n in L.NAMES}, **full, **x, "turn_id": str(p)} for p, x in wrong.items()]
    df = spark.createDataFrame([tuple(r.get(c) for c in (*L.NAMES, "prompt", "followup")) for r in rows], L.RESULT + ", prompt string, followup string")
    assert {r.turn_id: r.problem for r in L.result_violations(df).collect()} == {p: p for p in wrong if p}
    with pytest.raises(L.InvalidAnswer):
        L.check_answer([record], [full | {"mood": 1}])
    assert isinstance(L.sort_error(RuntimeError("HTTP 503 from provider")), L.TransientError) and isinstance(L.sort_error(RuntimeError("input_too_large")), L.TooLarge)
    sizes = []

    def small(batch):
        sizes.append(len(batch))
        if len(batch) > 1:
            raise RuntimeError("Input exceeds the maximum length")
        return L.rule_labeler(batch)

    assert len(L.label_batch([{"turn_id": str(i), "prompt": "p"} for i in range(4)], small)) == 4 and sizes == [4, 2, 1, 1, 2, 1, 1]


def test_keys_follow_every_part(spark):
    base = ("t", "p", "u", "f", "a")
    other = [("t2", *base[1:]), ("t", "p2", *base[2:]), ("t", "p", "u2", "f", "a"), ("t", "p", "u", "f2", "a"), ("t", "p", "u", "f", "a2"), ("t", "p", None, None, None), ("t", "p\x00u", None, None, None)]
    df = spark.createDataFrame([base, *other], "turn_id string, prompt string, followup_id string, followup string, previous_answer string")
    keys = [r[0] for v in (L.VERSIONS, ("x", *L.VERSIONS[1:])) for m, e in (("m", "low"), ("n", "low"), ("m", "high")) for r in df.select(L.cache_key(m, e, v)).collect()]
    assert len(set(keys)) == len(keys) == 48
    import hashlib

    want = hashlib.sha256("".join(x + "\0" for x in (*L.VERSIONS, "m", "low", "t", "p", "u", "f", "a")).encode()).hexdigest()
    assert keys[0] == "semantic:" + want


def test_cache_keeps_what_was_done(spark, tmp_path):
    df = spark.createDataFrame([(f"t{i}", "p", None, None, None) for i in range(6)], "turn_id string, prompt string, followup_id string, followup string, previous_answer string")
    path, seen = str(tmp_path / "labels"), L.label_into
    assert seen(df.where("turn_id < 't4'"), L.rule_labeler, path, "m", "low", slices=2) == {"total": 4, "hits": 0, "evaluated": 4}
    assert seen(df, L.rule_labeler, path, "m", "low", slices=2) == {"total": 6, "hits": 4, "evaluated": 2}
    assert seen(df, L.rule_labeler, path, "m", "high", slices=1)["hits"] == 0
    with pytest.raises(ValueError):
        seen(df, L.rule_labeler, path, "-m", "low")


def test_classifiers(spark):
    rows = spark.createDataFrame([("a", "p", None, None, None), ("b", "", "x", "f", ""), ("c", "p", "y", "g", "")], "turn_id string, prompt string, followup_id string, followup string, previous_answer string")
    labels = spark.createDataFrame([("b", "steering", ["skill"]), ("c", "question", None)], "turn_id string, followup_label string, prevention_mechanisms array<string>")
    taken = {n: "".join(sorted(r.turn_id for r in L.classifier_cases(c, rows, labels).collect())) for n, c in L.CLASSIFIERS.items()}
    assert taken == {"task-type": "ac", "steering": "bc", "steering-reason": "b", "prevention": "b", "prompt-quality": "", "agents-rules": "", "skill-candidates": "b", "validation": ""}

    def says(records):
        return [{"turn_id": json.loads(r)["turn_id"], "prevention_mechanisms": ["skill", "skill"], "not_preventable": False, "skill_candidate": "other"} for r in records]

    got = [[tuple(r) for r in L.classify(L.CLASSIFIERS[n], rows, labels, says).collect()] for n in ("prevention", "skill-candidates")]
    assert got == [[("b", "skill", False)], [("b", "other", False)]]
    with pytest.raises(L.InvalidAnswer):
        L.classifier_check(L.CLASSIFIERS["steering"])([{"turn_id": "b"}], [{"turn_id": "b", "followup_label": "no"}])


def test_diagnostics_hide_prompts():
    secret = "my prompt"
    assert L.diagnostic("noise " + secret) == "error output omitted for privacy"
    assert L.diagnostic(f"x\nERROR {{\n \"error\": {{\"code\": \"c\", \"message\": \"bad  {secret}\"}}}}", secret) == "c: bad [prompt omitted]"
    assert L.diagnostic(f"[ERROR] failed Records: {secret}") == "[ERROR] failed" and len(L.diagnostic("ERROR " + "x" * 900)) == 515


def test_redaction_and_validation(spark):
    df = spark.createDataFrame([("email a@example.com token=abc123 /Users/alice/project\n```go\nsecret()\n```",), ("Bearer abc.def, sk-12x ghp_9z C:\\Users\\me\\f",), ("é" * 5000 + "end",), (None,)], "t string")
    a, b, c, d = [r[0] for r in df.select(G.redact(df.t)).collect()]
    assert a == "email [redacted email] [redacted token] [redacted local path]\n[redacted code]" and b == "[redacted token], [redacted token] [redacted token] [redacted local path]"
    assert c == "é" * 1200 + G.CUT + "é" * 1197 + "end" and d == ""
    names = ("case_id", "prompt", "followup_prompt", *G.FIELDS, "prevention_mechanisms")
    ok = {"case_id": "case-0a", "prompt": "p", "followup_prompt": "f", "task_type": "bugfix"}
    wrong = {
        "invalid id": {"case_id": "case-x1"}, "no input": {"prompt": "", "followup_prompt": None}, "nothing expected": {"task_type": None}, "unknown task_type": {"task_type": "nope"}, "unknown validation_type": {"validation_type": "nope"}, "task type without prompt": {"prompt": ""},
        "label without follow-up": {"followup_prompt": "", "prevention_mechanisms": []}, "unknown mechanism": {"prevention_mechanisms": ["skill", "magic"]}, "duplicate mechanism": {"prevention_mechanisms": ["skill", "skill"]}, "reason without steering": {"followup_label": "question", "steering_reason": "other"},
        "steering field without steering": {"followup_label": "question", "prevention_mechanisms": ["skill"]}, "agents_rule without mechanism": {"agents_rule": "other", "prevention_mechanisms": ["skill"]}, None: {"followup_label": "question", "prevention_mechanisms": []},
    }
    rows = [{**ok, "case_id": f"case-{i:02x}", **x} for i, x in enumerate(wrong.values())] + [{**ok, "case_id": "case-ff"}] * 2
    got = G.violations(spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f"{n} string" for n in names[:-1]) + ", prevention_mechanisms array<string>"))
    assert sorted(r.problem for r in got.collect()) == sorted([*(p for p in wrong if p), "duplicate id"])


def test_guard_at_its_bounds(spark):
    snap = spark.createDataFrame([(m, v) for m, v, _ in G.HISTORY], "metric string, value double")
    run = lambda s, *rates: {r.metric: r.verdict for r in G.guard(s, spark.createDataFrame([*rates], "cohort string, samples bigint, steering_rate double")).collect() if r.verdict != "pass"}
    best = [("", 930, 14.8), ("refactor", 10, 30.0), ("architecture", 10, 20.6)]
    assert run(snap, *best) == {} and run(snap, ("", 930, 16.3), ("refactor", 10, 38.0), ("architecture", 10, 12.6)) == {}
    assert run(snap, ("", 930, 16.31), ("refactor", 10, 38.01), ("architecture", 9, 20.6)) == {"steering all": "warning", "steering refactor": "warning", "steering architecture": "warning"}
    off = spark.createDataFrame([(m, v + (0.04 if d else 0.4) + (1 if m == "tasks" else 0)) for m, v, d in G.HISTORY if m != "aborted"], "metric string, value double")
    assert run(off, *best[:2]) == {"tasks": "mismatch", "aborted": "mismatch", "steering architecture": "warning"}


def test_last_followup_of_a_turn_counts(spark):
    tasks = spark.createDataFrame([("a", 1, "t", "p"), ("a", 2, "z", ""), ("b", 1, "y", "")], "file_path string, seq int, turn_id string, prompt string")
    follow = spark.createDataFrame([("a", 2, "t", "zz", "A", "one"), ("b", 1, "t", "aa", "B", "two"), ("b", 1, "y", "q", "C", "three")], "file_path string, seq int, previous_turn_id string, turn_id string, previous_answer string, prompt string")
    got = {r.turn_id: (r.followup_id, r.followup, r.previous_answer) for r in L.inputs(tasks, follow).collect()}
    assert got == {"t": ("aa", "two", "B"), "y": ("q", "three", "C")}


def test_first_pair_of_efforts_in_order(spark):
    rows = [(f"{e}{i}", "bugfix", False, t, 1.0, 1, "m", e, False) for e, t in (("a", 100), ("b", 60), ("c", 80), ("d", 50)) for i in range(10)]
    obs = spark.createDataFrame(rows, "turn_id string, task_type string, steering boolean, tokens bigint, seconds double, tools bigint, model string, effort string, uses boolean")
    assert [tuple(r)[2:4] for r in E.routing_hypothesis(obs).collect()] == [("b", "a")]
    assert E.routing_hypothesis(obs.where("effort in ('c', 'd')")).collect()[0].better == "d"


def test_rollout_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "rollout-1.jsonl").write_text('{"timestamp":"x","type":"event_msg","payload":{"type":"task_started"}}\n{bad\n{"type":"compacted","payload":null}')
    (tmp_path / "rollout-2.jsonl").write_text('{"type":"t","payload":"' + "y" * 200 + '"}\n')
    (tmp_path / "other.jsonl").write_text("{}")
    lines = rollouts.lines(spark, str(tmp_path))
    st = {r.file_path[-15:]: (r.lines, r.malformed, r.too_long) for r in rollouts.file_status(lines, cap=100).collect()}
    assert st == {"rollout-1.jsonl": (3, 1, False), "rollout-2.jsonl": (1, 0, True)}
    got = [(r.line_no, r.rec_type, r.payload) for r in rollouts.records(lines, cap=100).orderBy("line_no").collect()]
    assert got == [(1, "event_msg", '{"type":"task_started"}'), (3, "compacted", None)]
    assert R.decode(rollouts.records(lines)).count() == 3
    assert rollouts.inside(str(tmp_path), str(tmp_path / "a")) == str((tmp_path / "a").resolve())
    (tmp_path / "link").symlink_to("/etc")
    with pytest.raises(ValueError):
        rollouts.inside(str(tmp_path), str(tmp_path / "link" / "passwd"))


def test_lines_of_split_files_keep_their_numbers(spark, tmp_path):
    n = 3000
    (tmp_path / "rollout-x.jsonl").write_text("".join(f'{{"type":"t","payload":"{i}"}}\n' + ("\n" if i % 7 == 0 else "") for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        rows = rollouts.lines(spark, str(tmp_path)).orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == n and rows[8].line_no == 11 and [json.loads(r.line)["payload"] for r in rows] == [str(i) for i in range(n)]


def test_streaming(spark, tmp_path):
    from strandline.streaming.records import first_deliveries, token_windows

    src = str(tmp_path / "in")
    spark.sql("select timestamp'2025-01-01 00:01:00' as ts, 'a' as kind, 5L as tokens, timestamp'2025-01-01 00:01:00' as ingested_at, 'f' as file_path, 1 as line_no union all select timestamp'2025-01-01 00:02:00', 'a', 6L, timestamp'2025-01-01 00:02:00', 'f', 1").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    for name, df, mode, want in (("w", token_windows(stream), "complete", [(2, 11)]), ("d", first_deliveries(stream), "append", [(1,)])):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(60)
        rows = spark.sql("select n, tokens from w" if name == "w" else "select count(*) from d").collect()
        assert [tuple(r) for r in rows] == want


def test_reports(spark):
    from strandline.plans import report

    df = spark.createDataFrame([("<complete>", 3)], "status string, n bigint")
    assert "&lt;complete&gt;" in report.html_report({"status": df}, "ru") and "Состояние" in report.text_report({"status": df}, "ru")
    assert report.word("nothing") == "nothing" and report.rate_bar(7.0) == 100
    with pytest.raises(ValueError):
        report.text_report({"x": df.withColumnRenamed("status", "prompt")})
