"""What a user runs: quick counts, labelled analysis, and fixtures, over a folder of rollout files or a table of records."""

from __future__ import annotations

import argparse
import datetime
import os
import sys
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.errors import EvaluationError, UsageError
from strandline.operators import children as C
from strandline.operators import effectiveness as E
from strandline.operators import golden as G
from strandline.operators import labels as L
from strandline.operators import turns as T
from strandline.operators import usage as U
from strandline.plans import report
from strandline.plans.children import World
from strandline.session import cut, local_session, ship
from strandline.sources import cache, rollouts

Labeler = Callable[[list[str]], list[dict]]


@dataclass(frozen=True)
class Config:
    """Settings of a labeling. Numbers below their least fall back to the default; no retries are zero, not the default."""

    model: str = "default"
    effort: str = "low"
    workers: int = L.WORKERS
    batch: int = L.BATCH
    retries: int = L.RETRIES

    def settled(self) -> Config:
        d = Config()
        L.check_labeler(self.model, self.effort)
        if self.workers > 32:
            raise UsageError("workers")
        return replace(self, workers=self.workers if self.workers >= 1 else d.workers, batch=self.batch if self.batch >= 1 else d.batch, retries=self.retries if self.retries >= 0 else d.retries)


def records_of(spark: SparkSession, root: str) -> DataFrame:
    """The records of the rollout files below a folder."""
    return rollouts.records(rollouts.lines(spark, root))


def quick(raw: DataFrame, window: report.Window) -> dict[str, DataFrame]:
    """The frames of the quick report: turns of user sessions in the window, and what agents did."""
    w = World(raw, window.since_ns, window.before_ns)
    inside = lambda df, c: df.where(F.col(c).between(window.since_ns if window.since_ns is not None else -(2**63), window.before_ns))
    t = cut(inside(w.user_turns, "start_ns"))
    made = inside(w.agents.where("not creation_conflict"), "created_ns")
    used = C.usage_rows(w.facts, w.counted)
    return {
        "totals": T.totals(t), "status": T.histogram(t, "status"), "averages": T.averages(t), "models": T.histogram(t, "model", "effort"),
        "agents": made.agg(F.count("*").alias("created"), F.count_if(F.col("has_depth") & (F.col("depth") > 1)).alias("nested")), "working": w.counted.groupBy("status").agg(F.count("*").alias("n")),
        "roles": T.histogram(w.counted, "role"), "tokens": U.usage_totals(used, "role", "source"), "durations": w.counted.agg(F.try_sum("duration_ms").alias("duration_ms"), F.count("duration_ms").alias("known"), F.count_if(F.col("duration_ms").isNull()).alias("missing")), "coverage": T.histogram(w.turns, "reason"),
    }


def analyze(raw: DataFrame, window: report.Window, labeler: Labeler, cache_path: str, config: Config = Config(), notice: Callable[[str], object] = print, language: str = "en") -> tuple[dict[str, DataFrame], list[str], list[report.Recommendation]]:
    """Frames, insights and recommendations of the labelled turns. Without any follow-up only the quick frames come back and nothing is sent."""
    config = config.settled()
    frames, w = quick(raw, window), World(raw, window.since_ns, window.before_ns)
    i = cut(T.interactions(w.records.join(w.users.select("file_path"), "file_path", "left_semi")).where(F.col("start_ns").between(window.since_ns if window.since_ns is not None else -(2**63), window.before_ns)))
    f = T.followups(i)
    if f.isEmpty():
        return frames, [report.word("limited", language)], []
    rows = cut(L.inputs(i, f))
    if not L.input_problems(rows).isEmpty():
        raise EvaluationError("inputs with an empty or repeated id or a blank follow-up")
    held = cache.read_cache(raw.sparkSession, cache_path, L.RESULT)
    keyed = rows.withColumn("cache_key", L.cache_key(config.model, config.effort))
    gate = report.Gate(notice, language)
    if gate.open(L.pending(keyed, held).count()):
        L.label_into(rows, labeler, cache_path, config.model, config.effort, workers=config.workers, most=config.batch)
    labels = cut(keyed.select("cache_key").join(cache.read_cache(raw.sparkSession, cache_path, L.RESULT), "cache_key").drop("cache_key"))
    obs = cut(E.observations(w.user_turns, labels, w.linked.select(F.col("root_turn").alias("task"))))
    tops = {x: E.top_label(labels, x, () if x == "steering_reason" else ("other",)).collect() for x in G.FIELDS[2:]}
    named = raw.sparkSession.createDataFrame([(k, r[0].label) for k, r in tops.items() if r] or [("", "")], "field string, label string")
    lines = report.insight_lines([tuple(r) for r in E.insights(obs, named).collect()], language)
    steering = labels.where("followup_label = 'steering'").count()
    advice = report.recommendations({k: (r[0].label, r[0].n) for k, r in tops.items() if r}, obs.count(), steering, language)
    more = {"behaviour": E.label_shares(labels, "followup_label"), "task_types": E.label_shares(labels, "task_type"), "cohorts": E.with_and_without(obs), "routing": E.model_comparisons(obs)}
    return frames | more, lines, advice


def golden_export(raw: DataFrame, window: report.Window, path: str, limit: int = 50) -> int:
    """A fixture of the first redacted cases; its approval is left open. How many cases it has comes back."""
    if not 1 <= limit <= 500:
        raise UsageError("limit")
    w = World(raw, window.since_ns, window.before_ns)
    i = cut(T.interactions(w.records.join(w.users.select("file_path"), "file_path", "left_semi")))
    cases = [{k: v for k, v in r.asDict().items() if v} for r in G.candidates(L.inputs(i, T.followups(i)), limit).collect()]
    names = {"id": "id", "prompt": "prompt", "previous_answer": "previous_answer", "followup": "followup_prompt"}
    cache.write_private(path, {"format_version": "1", "methodology": dict(zip(("methodology_version", "prompt_version", "schema_version"), L.VERSIONS)), "provenance": {"status": "candidate"}, "cases": [{names[k]: v for k, v in c.items()} for c in cases]})
    return len(cases)


def golden_evaluate(spark: SparkSession, path: str, labeler: Labeler, config: Config = Config()) -> dict[str, DataFrame]:
    """Accuracy, confusions and scores of a labeler over an approved fixture, without any cache; EvaluationError if the fixture breaks a rule or results do not fit the cases."""
    config = config.settled()
    fixture = cache.read_fixture(path)
    cache.check_approval(fixture)
    ddl = "case_id string, prompt string, previous_answer string, followup_prompt string, " + ", ".join(f"{f} string" for f in G.FIELDS) + ", prevention_mechanisms array<string>"
    rows = [(c.get("id"), c.get("prompt"), c.get("previous_answer"), c.get("followup_prompt"), *(c.get("expected", {}).get(f) for f in (*G.FIELDS, "prevention_mechanisms"))) for c in fixture["cases"]]
    cases = spark.createDataFrame(rows, ddl)
    broken = G.violations(cases).limit(1).collect()
    if broken:
        raise EvaluationError(f"{broken[0].case_id}: {broken[0].problem}")
    later = F.nullif("followup_prompt", F.lit(""))
    inputs = cases.select(F.col("case_id").alias("turn_id"), F.coalesce("prompt", F.lit("")).alias("prompt"), F.when(later.isNotNull(), F.concat("case_id", F.lit("-followup"))).alias("followup_id"), later.alias("followup"), F.coalesce("previous_answer", F.lit("")).alias("previous_answer"))
    results = cut(L.label(inputs, labeler, workers=config.workers, most=config.batch).withColumnRenamed("turn_id", "case_id"))
    if not G.result_problems(cases.select("case_id"), results.select("case_id")).isEmpty():
        raise EvaluationError("results do not fit the cases")
    names = (*G.FIELDS, "prevention_mechanisms")
    pairs = cases.select("case_id", F.struct(*names).alias("expected")).join(results.select("case_id", F.struct(*names).alias("predicted")), "case_id")
    return {"accuracy": G.accuracy(pairs), "confusion": G.confusion(pairs), "micro": G.micro_scores(pairs)}


def main(args: list[str] | None = None) -> int:
    """``quick ROOT [--days N] [--before T] [--html FOLDER]`` and ``golden-export ROOT FILE [--limit N]``; labelling needs a labeler and is called from Python."""
    p = argparse.ArgumentParser(prog="strandline")
    sub = p.add_subparsers(dest="command", required=True)
    q, g = sub.add_parser("quick"), sub.add_parser("golden-export")
    for x in (q, g):
        x.add_argument("root")
        x.add_argument("--days", type=int, default=30)
        x.add_argument("--before", default=None)
    q.add_argument("--html", default=None)
    g.add_argument("file")
    g.add_argument("--limit", type=int, default=50)
    o = p.parse_args(args)
    before = datetime.datetime.fromisoformat(o.before) if o.before else datetime.datetime.now(datetime.UTC)
    spark = SparkSession.getActiveSession() or local_session()
    ship(spark)
    language, stages = report.language_of(dict(os.environ)), report.Stages()
    try:
        window = report.Window.of(o.days, before)
        raw = records_of(spark, o.root)
        if o.command == "quick":
            with stages.stage("aggregation"):
                frames = quick(raw, window)
            with stages.stage("report"):
                print(report.text_report(frames, language))
            if o.html:
                print(report.write_report(o.html, report.html_report(frames, language)))
        else:
            print(golden_export(raw, window, o.file, o.limit))
    except UsageError as e:
        print(f"usage: {e}", file=sys.stderr)
        return 1
    return 0
