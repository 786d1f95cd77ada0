"""The functions a user calls, over a folder of rollout files, and what reports are made of."""

import datetime
import json
import urllib.error
import urllib.request

import pytest

from strandline import api
from strandline.errors import EvaluationError, FixtureError, NoticeError, UsageError
from strandline.operators import labels as L
from strandline.plans import report
from test_children import ev, meta, rec

BEFORE = datetime.datetime(2026, 10, 2, tzinfo=datetime.UTC)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("rollouts")
    user = [meta("root", source="user")]
    for i in range(12):
        user += [ev(f"{3 * i:02d}", "task_started", f"u{i}"), ev(f"{3 * i + 1:02d}", "user_message", f"u{i}", message=f"do the task {i} for a@b.example"), ev(f"{3 * i + 2:02d}", "task_complete", f"u{i}", duration_ms=1000, last_agent_message="done")]
    child = [meta("child"), ev("05", "task_started", "c"), rec("06", "token_usage_record", thread_id="child", turn_id="c", response_id="r", usage={"total_tokens": 7}), ev("07", "task_complete", "c", duration_ms=2000)]
    for name, recs in (("rollout-user.jsonl", user), ("rollout-child.jsonl", child)):
        (top / name).write_text("".join(json.dumps({"timestamp": t, "type": k, "payload": p}) + "\n" for t, k, p in recs))
    return str(top)


def test_quick_over_files(spark, root, tmp_path, capsys):
    frames = api.quick(api.records_of(spark, root), report.Window.of(0, BEFORE))
    assert tuple(frames["totals"].collect()[0]) == (1, 12, 12, 0, 12000, 0)
    assert [tuple(r) for r in frames["tokens"].select("role", "source", "requests", "total_tokens").collect()] == [("role", "recorded", 1, 7)]
    assert tuple(frames["durations"].collect()[0]) == (2000, 1, 0) and frames["agents"].collect()[0].created == 1
    assert api.main(["quick", root, "--days", "0", "--before", "2026-10-02T00:00:00+00:00", "--html", str(tmp_path / "html")]) == 0
    out = capsys.readouterr().out
    assert "== Totals" in out and out.strip().endswith("report.html") and "do the task" not in out
    assert api.main(["quick", root, "--before", "2026-10-02T00:00:00"]) == 1
    assert api.quick(api.records_of(spark, root), report.Window.of(1, datetime.datetime(2027, 1, 1, tzinfo=datetime.UTC)))["totals"].collect()[0].turns == 0


def test_analysis_sends_only_what_is_not_cached(spark, root, tmp_path):
    raw, path, said = api.records_of(spark, root), str(tmp_path / "cache"), []
    frames, lines, advice = api.analyze(raw, report.Window.of(0, BEFORE), L.rule_labeler, path, notice=said.append)
    assert said == ["Texts of 12 tasks are sent to the labeler."] and sum(r.n for r in frames["behaviour"].collect()) == 11
    assert lines[0] == "== Strength" and all(a.checklist for a in advice)

    def never(batch):
        raise AssertionError("sent")

    again, *_ = api.analyze(raw, report.Window.of(0, BEFORE), never, path, notice=said.append)
    assert len(said) == 1 and again["behaviour"].count() == frames["behaviour"].count()

    def closed(_):
        raise OSError("closed")

    with pytest.raises(NoticeError):
        api.analyze(raw, report.Window.of(0, BEFORE), never, str(tmp_path / "other"), notice=closed)
    with pytest.raises(UsageError):
        api.Config(workers=33).settled()
    assert api.Config(workers=0, batch=-1, retries=0).settled() == api.Config(retries=0)


def test_fixtures(spark, root, tmp_path):
    path = str(tmp_path / "fixture.json")
    assert api.golden_export(api.records_of(spark, root), report.Window.of(0, BEFORE), path, 5) == 5
    with open(path) as f:
        fixture = json.load(f)
    assert fixture["cases"][0]["id"] == "case-000001" and "a@b.example" not in json.dumps(fixture)
    with pytest.raises(FixtureError):
        api.golden_evaluate(spark, path, L.rule_labeler)
    fixture["provenance"] = {"status": "approved", "approved_by": "x", "approved_at": "2026-10-01T00:00:00Z", "source": "y"}
    for c in fixture["cases"]:
        c["expected"] = {"task_type": L.rule_labeler([json.dumps({"turn_id": c["id"], "prompt": "p"})])[0]["task_type"]}
    from strandline.sources.cache import write_private

    write_private(path, fixture)
    got = api.golden_evaluate(spark, path, L.rule_labeler)
    assert [tuple(r) for r in got["accuracy"].collect()] == [("task_type", 5, 5, 1.0)] and got["confusion"].count() == 0
    fixture["cases"][0]["expected"]["task_type"] = "nope"
    write_private(path, fixture)
    with pytest.raises(EvaluationError):
        api.golden_evaluate(spark, path, L.rule_labeler)
    fixture["cases"][0]["mood"] = 1
    write_private(path, fixture)
    with pytest.raises(FixtureError):
        api.golden_evaluate(spark, path, L.rule_labeler)
    with pytest.raises(UsageError):
        api.golden_export(api.records_of(spark, root), report.Window.of(0, BEFORE), path, 501)


def test_recommendations_need_evidence():
    tops = {"validation_type": ("tests", 3), "steering_reason": ("other", 2), "prompt_issue": ("other", 9), "skill_candidate": ("verification_workflow", 1)}
    assert report.recommendations(tops, 9, 5) == []
    assert [(r.priority, r.family) for r in report.recommendations(tops, 10, 5)] == [("high", "validation_type"), ("high", "steering_reason")]
    assert [r.family for r in report.recommendations({}, 10, 1, "ru")] == ["general"] and report.recommendations({}, 10, 0) == []


def test_words_in_both_languages():
    assert report.WORDS["en"].keys() == report.WORDS["ru"].keys()
    assert [report.language_of(e) for e in ({}, {"LANG": "ru_RU.UTF-8"}, {"LC_ALL": "de_DE", "LANG": "ru"}, {"LC_ALL": "", "LANG": "en_US"})] == ["en", "ru", "en", "en"]
    lines = report.insight_lines([("strength", "task_type", "bugfix", 12, 0.25), ("low", "routing", "m / low", None, None)], "en")
    assert lines[1] == "  bugfix: 25% of 12 tasks were corrected." and lines[-1].startswith("  Try m / low") and lines[3] == "  " + report.word("limited")


def test_page_is_written_once_and_served_here_only(spark, tmp_path):
    page = report.html_report({"status": spark.createDataFrame([("<x>", 1)], "status string, n bigint")}, bars={"steering_rate": 7.0}, advice=[report.Recommendation("high", "f", "<b>", "o")], insights=["<i>"])
    assert "&lt;x&gt;" in page and "&lt;b&gt;" in page and "&lt;i&gt;" in page and "value=100" in page
    now = datetime.datetime(2026, 1, 1, tzinfo=datetime.UTC)
    a, b = report.write_report(str(tmp_path), page, now), report.write_report(str(tmp_path), page, now)
    assert a != b
    with report.serve(a) as url:
        assert urllib.request.urlopen(url, timeout=5).read().decode() == page
        for bad in (urllib.request.Request(url, headers={"Host": "evil.example"}), url + "other"):
            with pytest.raises(urllib.error.HTTPError):
                urllib.request.urlopen(bad, timeout=5)
    with pytest.raises(OSError):
        urllib.request.urlopen(url, timeout=2)


def test_stages_and_progress():
    clock = iter(range(100)).__next__
    s = report.Stages(clock)
    with s.stage("a"):
        pass
    with s.stage("a"):
        pass
    assert s.lines() == ["a: 2.000 s"]
    said = []
    g = report.Gate(said.append)
    assert g.open(0) is False and said == []
    for i in range(101):
        g.progress(i, 100)
    assert said == [f"{10 * k} %" for k in range(11)]
