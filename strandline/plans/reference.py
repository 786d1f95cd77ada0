"""Queries of the session-analytics operators over rollout_records, sessions, subagent_meta, interactions and cases.

Labels come from a fixed rule on the md5 of a turn's key: a stand-in for the injected labeler that both
engines can compute, not a judgement.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import effectiveness as E
from strandline.operators import golden as G
from strandline.operators import labels as L
from strandline.operators import records as R
from strandline.operators import turns as T
from strandline.operators import usage as U
from strandline.session import cut
from strandline.sources.tables import table

#: The window of the windowed queries: all of 2025, as nanoseconds.
SINCE, BEFORE = 1735689600 * 10**9, 1767225600 * 10**9
USAGE = R.USAGE
Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    Q[f.__name__] = f
    return f


def _rec(spark: SparkSession, d: str) -> DataFrame:
    return R.decode(table(spark, d, "rollout_records"))


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return T.turns(_rec(spark, d))


def _pick(c: Column, at: int, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.ascii(F.substring(F.md5(c), at, 1)) % len(values) + 1)


#: Of eight equal parts of the turns, the task types they get.
_TYPES = (*["bugfix"] * 5, *["tests"] * 2, "other")


def stand_in_labels(t: DataFrame) -> DataFrame:
    """(turn_id, every label) of the turns by the rule: most turns are of one type, so that cohorts are large enough to compare. Follow-on labels are there where their mechanism is."""
    k, at = F.col("turn_id"), lambda n: F.ascii(F.substring(F.md5("turn_id"), n, 1))
    ids = t.where("turn_id <> ''").select("turn_id").distinct()
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), at(1) % 8 + 1)
    steering = _pick(k, 2, G.FOLLOWUP_LABELS) == "steering"
    ms = F.when(steering, F.slice(F.array(*map(F.lit, G.MECHANISMS)), 1, at(5) % 5))
    rows = ids.select("turn_id", kind.alias("task_type"), _pick(k, 2, G.FOLLOWUP_LABELS).alias("followup_label"), F.when(steering, _pick(k, 3, G.STEERING_REASONS)).alias("steering_reason"), ms.alias("prevention_mechanisms"))
    return rows.select("*", *(F.when(F.array_contains("prevention_mechanisms", m), _pick(k, 6 + n, G.SETS[f])).alias(f) for n, (f, m) in enumerate(G.MECHANISM_OF.items())))


def _obs(spark: SparkSession, d: str) -> DataFrame:
    t = cut(_turns(spark, d))  # read twice: for the turns and for the ids that get labels
    return E.observations(t, stand_in_labels(t))


@query
def s3_decode(spark, d):
    return _rec(spark, d).groupBy("rec_type", "kind").agg(F.count("*").alias("n"), F.count_if("readable").alias("readable_n"), F.count_if(F.col("ns").isNull()).alias("no_instant"))


@query
def s4_first_meta(spark, d):
    return R.first_meta(table(spark, d, "rollout_records"))


@query
def s5_child_meta(spark, d):
    return R.child_meta(table(spark, d, "rollout_records"))


@query
def s6_file_status(spark, d):
    r = _rec(spark, d)
    return r.groupBy("file_path").agg(F.count("*").alias("records"), F.count_if(~F.col("readable")).alias("unreadable"))


@query
def f1_as_of(spark, d):
    return R.as_of(_rec(spark, d), BEFORE).groupBy("file_path").agg(F.count("*").alias("n"))


@query
def f2_as_of_strict(spark, d):
    return R.as_of(_rec(spark, d), BEFORE, strict=True).groupBy("file_path").agg(F.count("*").alias("n"))


@query
def f3_window(spark, d):
    return R.in_window(_turns(spark, d), SINCE, BEFORE, "start_ns").groupBy("status").agg(F.count("*").alias("n"))


@query
def f4_user_sessions(spark, d):
    s = table(spark, d, "sessions").where(F.lower(F.trim("thread_source")) == "user")
    return s.groupBy("project").agg(F.count("*").alias("files"), F.countDistinct("id").alias("ids"))


@query
def f5_unmarked(spark, d):
    return R.without_marked_files(table(spark, d, "rollout_records"), "token tally").groupBy("file_path").agg(F.count("*").alias("n"))


@query
def f6_originator(spark, d):
    s = table(spark, d, "sessions")
    return s.groupBy((F.col("originator") == "ci_runner").alias("excluded")).agg(F.count("*").alias("n"))


@query
def f7_tool_calls(spark, d):
    r = _rec(spark, d).where(R.is_tool_call())
    return r.groupBy(F.coalesce("name", "tool_name").alias("tool"), R.is_spawn().alias("spawn")).agg(F.count("*").alias("n"))


@query
def f11_not_blank(spark, d):
    i = table(spark, d, "interactions").where(~F.col("prompt").rlike(r"(?U)^\s*$"))
    return i.groupBy("status").agg(F.count("*").alias("n"))


@query
def q1_turns(spark, d):
    return _turns(spark, d)


@query
def q6_interactions(spark, d):
    return T.interactions(_rec(spark, d))


@query
def q8_followups(spark, d):
    return T.followups(T.interactions(_rec(spark, d))).select("previous_turn_id", "turn_id", "previous_answer", "prompt")


@query
def a1_totals(spark, d):
    return T.totals(_turns(spark, d))


@query
def a2_statuses(spark, d):
    return T.histogram(_turns(spark, d), "status")


@query
def a3_models(spark, d):
    return T.histogram(_turns(spark, d), "model", "effort")


@query
def a4_averages(spark, d):
    return T.averages(_turns(spark, d))


@query
def a5_snapshot(spark, d):
    i = T.interactions(_rec(spark, d)).agg(F.count("*").alias("tasks"), *(F.count_if(F.col("status") == s).alias(s) for s in ("complete", "aborted", "incomplete")))
    return i.join(F.broadcast(T.averages(_turns(spark, d))))  # one row each


@query
def a6_label_shares(spark, d):
    return E.label_shares(table(spark, d, "cases"), "followup_label")


@query
def a7_behaviour(spark, d):
    c = table(spark, d, "cases")
    n = {x: F.count_if(F.col("followup_label") == x) for x in G.FOLLOWUP_LABELS}
    return c.agg(*(v.alias(k) for k, v in n.items()), F.round(n["steering"] / F.count("followup_label"), 6).alias("steering_rate"))


@query
def a8_task_types(spark, d):
    return E.label_shares(table(spark, d, "cases"), "task_type").select("label", "n")


@query
def a9_steering_by_type(spark, d):
    c = table(spark, d, "cases").where("task_type is not null and followup_label is not null")
    return c.groupBy("task_type").agg(F.count("*").alias("followups"), F.count_if(F.col("followup_label") == "steering").alias("steering_n"), F.round(F.count_if(F.col("followup_label") == "steering") / F.count("*"), 6).alias("rate"))


@query
def a10_mechanisms(spark, d):
    return E.mechanism_shares(table(spark, d, "cases"))


@query
def j1_observations(spark, d):
    o = _obs(spark, d)
    return o.select("turn_id", "task_type", "steering", "tokens", F.round("seconds", 6).alias("seconds"), "tools", "model", "effort", "uses")


@query
def a12_overall(spark, d):
    return E.overall(_obs(spark, d))


@query
def a13_by_type(spark, d):
    return E.by_type(_obs(spark, d))


@query
def a14_models(spark, d):
    return E.model_comparisons(_obs(spark, d))


@query
def a15_agents(spark, d):
    return E.with_and_without(_obs(spark, d))


@query
def a16_agents_by_type(spark, d):
    return E.with_and_without(_obs(spark, d), "task_type")


@query
def a20_coverage(spark, d):
    return E.coverage_mean(_rec(spark, d).where("rec_type = 'token_usage_record' and readable"), "total_tokens", "file_path")


@query
def a46_validated(spark, d):
    u = U.validated(_rec(spark, d).where("rec_type = 'token_usage_record' and readable"))
    return u.select("record_id", *USAGE, "valid")


def _cases(spark: SparkSession, d: str) -> DataFrame:
    """Golden cases; the four follow-on labels that the table lacks are there where their mechanism is, by the rule."""
    c = table(spark, d, "cases")
    return c.select("*", *(F.when(F.array_contains("prevention_mechanisms", m), _pick(F.col("case_id"), 6 + n, G.SETS[f])).alias(f) for n, (f, m) in enumerate(G.MECHANISM_OF.items())))


def _golden(spark: SparkSession, d: str) -> DataFrame:
    """(case_id, expected, predicted): of the predictions a part is wrong by the rule."""
    c, k = _cases(spark, d), F.col("case_id")
    at = lambda n: F.ascii(F.substring(F.md5("case_id"), n, 1))
    said = [F.when(at(10 + n) % 4 == 0, _pick(k, 1 + n, v)).otherwise(F.col(f)).alias(f) for n, (f, v) in enumerate(G.SETS.items())]
    ms = F.when(at(9) % 2 == 0, F.col("prevention_mechanisms")).otherwise(F.slice(F.array(*map(F.lit, G.MECHANISMS)), 1, at(5) % 5))
    return c.select("case_id", F.struct(*G.FIELDS, "prevention_mechanisms").alias("expected"), F.struct(*said, ms.alias("prevention_mechanisms")).alias("predicted"))


@query
def a33_accuracy(spark, d):
    return G.accuracy(_golden(spark, d))


@query
def a34_confusion(spark, d):
    return G.confusion(_golden(spark, d))


@query
def a35_micro(spark, d):
    return G.micro_scores(_golden(spark, d))


@query
def a38_top_reason(spark, d):
    return E.top_label(table(spark, d, "cases"), "steering_reason", drop=("other",))


@query
def r1_hypothesis(spark, d):
    return E.routing_hypothesis(_obs(spark, d))


@query
def o6_extremes(spark, d):
    return E.extremes(_obs(spark, d))


def _inputs(spark: SparkSession, d: str) -> DataFrame:
    i = cut(T.interactions(_rec(spark, d)))  # read for the tasks and for their follow-ups
    return L.inputs(i, T.followups(i))


@query
def c1_inputs(spark, d):
    return _inputs(spark, d)


@query
def c1_problems(spark, d):
    return L.input_problems(_inputs(spark, d))


@query
def c5_cache_keys(spark, d):
    return _inputs(spark, d).select("turn_id", L.cache_key("m", "low").alias("cache_key"))


@query
def j6_cache_pending(spark, d):
    keyed = _inputs(spark, d).withColumn("cache_key", L.cache_key("m", "low"))
    held = keyed.where(F.substring("turn_id", -1, 1).isin("0", "2", "4", "6", "8")).select("cache_key")
    return L.pending(keyed, held).select("turn_id", "cache_key")


def _case_inputs(spark: SparkSession, d: str) -> DataFrame:
    later = F.nullif("followup_prompt", F.lit(""))
    return table(spark, d, "cases").select(F.col("case_id").alias("turn_id"), F.coalesce("prompt", F.lit("")).alias("prompt"), F.when(later.isNotNull(), F.concat("case_id", F.lit("-followup"))).alias("followup_id"), later.alias("followup"), F.when(later.isNotNull(), F.coalesce("previous_answer", F.lit(""))).alias("previous_answer"))


@query
def c6_labels(spark, d):
    return _labelled(spark, d).withColumn("prevention_mechanisms", F.array_join("prevention_mechanisms", ","))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return L.label(_case_inputs(spark, d).where("prompt <> '' or followup is not null"), L.rule_labeler)


@query
def c11_violations(spark, d):
    """The labels of the cases themselves, held against the contract of results; confidences are 1 where a label is."""
    c = _cases(spark, d)
    own = c.select(F.col("case_id").alias("turn_id"), *G.FIELDS, "prevention_mechanisms", *(F.when(F.col(f).isNotNull(), F.lit(1.0)).alias(x) for f, x in L.CONFIDENCE.items()), F.coalesce(F.size("prevention_mechanisms") == 0, F.lit(False)).alias("not_preventable"), F.when(F.size("prevention_mechanisms") > 0, F.lit(1.0)).alias("prevention_confidence"))
    return L.result_violations(_case_inputs(spark, d).join(own, "turn_id"))


@query
def c12_views(spark, d):
    views = L.result_views(_labelled(spark, d))
    out = [v.select(F.lit(n).alias("view"), "turn_id") for n, v in views.items()]
    whole = out[0]
    for o in out[1:]:
        whole = whole.unionByName(o)
    return whole.groupBy("view").agg(F.count("*").alias("n"))


@query
def c16_classifier_cases(spark, d):
    """Of each single-label classifier the cases it takes with their cache keys; labels are the cases' own."""
    rows, labels, whole = _case_inputs(spark, d), _cases(spark, d).withColumnRenamed("case_id", "turn_id").select("turn_id", "followup_label", "prevention_mechanisms"), None
    for c in L.CLASSIFIERS.values():
        one = L.classifier_cases(c, rows, labels).select(F.lit(c.name).alias("classifier"), "turn_id", L.classifier_key(c).alias("cache_key"))
        whole = one if whole is None else whole.unionByName(one)
    return whole


@query
def j5_cascade(spark, d):
    return c16_classifier_cases(spark, d).groupBy("classifier").agg(F.count("*").alias("cases"))


@query
def j14_in_order(spark, d):
    """Labels of the cases in their order; every third case has none, and is marked."""
    c = table(spark, d, "cases").select(F.col("case_id").alias("turn_id"), F.expr("cast(substr(case_id, 6) as bigint)").alias("input_idx"), "task_type")
    return L.in_order(c.select("turn_id", "input_idx"), c.where("input_idx % 3 <> 0").select("turn_id", "task_type")).select("input_idx", "turn_id", "task_type", "found")


@query
def c24_redacted(spark, d):
    c = table(spark, d, "cases")
    return c.select("case_id", *(G.redact(F.col(x)).alias(x) for x in ("prompt", "previous_answer", "followup_prompt")))


@query
def c25_candidates(spark, d):
    return G.candidates(_inputs(spark, d))


@query
def c26_violations(spark, d):
    return G.violations(_cases(spark, d))


@query
def j7_problems(spark, d):
    """Results of the cases with some left out and some given twice, held against the cases."""
    c = table(spark, d, "cases").select("case_id")
    last = F.substring("case_id", -1, 1)
    return G.result_problems(c, c.where(last != "3").unionByName(c.where(last == "7")))


@query
def j3_followup_labels(spark, d):
    """Follow-ups with the labels of the turn before them; a turn id of two follow-ups and one without labels are problems."""
    f = T.followups(T.interactions(_rec(spark, d))).where("previous_turn_id <> ''")
    labels = stand_in_labels(f.select(F.col("previous_turn_id").alias("turn_id"))).where("substr(turn_id, -1, 1) <> '0'")
    one = f.groupBy(F.col("previous_turn_id").alias("turn_id")).agg(F.count("*").alias("n")).join(labels, "turn_id", "left")
    return one.select("turn_id", "task_type", "followup_label", F.when(F.col("n") > 1, "repeated").when(F.col("followup_label").isNull(), "no label").alias("problem"))


@query
def j4_type_and_label(spark, d):
    """Follow-ups by the task type of the turn before them (inner), with the label where there is one: without one they do not steer."""
    f = T.followups(T.interactions(_rec(spark, d))).where("previous_turn_id <> ''").select(F.col("previous_turn_id").alias("turn_id"))
    labels = stand_in_labels(f)
    rows = f.join(labels.select("turn_id", "task_type"), "turn_id").join(labels.where("substr(turn_id, -1, 1) <> '0'").select("turn_id", "followup_label"), "turn_id", "left")
    return rows.groupBy("task_type").agg(F.count("*").alias("followups"), F.count_if(F.coalesce(F.col("followup_label") == "steering", F.lit(False))).alias("steering_n"))


def _turn_labels(spark: SparkSession, d: str) -> DataFrame:
    return stand_in_labels(_turns(spark, d))


@query
def a11_recommendations(spark, d):
    """Prompt issues with ``other``, agents' rules without, skills without and met twice at least."""
    t = _turn_labels(spark, d)
    kinds = (("prompt_issue", (), 1), ("agents_rule", ("other",), 1), ("skill_candidate", ("other",), 2))
    whole = None
    for f, drop, least in kinds:
        one = E.label_shares(t, f, drop, least).select(F.lit(f).alias("field"), "label", "n")
        whole = one if whole is None else whole.unionByName(one)
    return whole


@query
def a11_reasons(spark, d):
    return E.label_shares(table(spark, d, "cases"), "steering_reason")


@query
def a36_snapshot(spark, d):
    i = T.interactions(_rec(spark, d))
    f = cut(T.followups(i))
    return G.semantic_snapshot(f, stand_in_labels(f.select(F.col("previous_turn_id").alias("turn_id"))))


@query
def a37_guard(spark, d):
    r = _rec(spark, d)
    i = cut(T.interactions(r))
    f = cut(T.followups(i))
    counts = i.agg(F.count("*").alias("tasks"), *(F.count_if(F.col("status") == s).alias(s) for s in ("complete", "aborted", "incomplete")))
    wide = counts.join(F.broadcast(f.agg(F.count("*").alias("followups")))).join(F.broadcast(T.averages(T.turns(r))))  # one row each
    snap = wide.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in wide.columns))).alias("x")).select("x.*")
    return G.guard(snap, G.semantic_snapshot(f, stand_in_labels(f.select(F.col("previous_turn_id").alias("turn_id")))))


@query
def x7_verdict(spark, d):
    return G.guard_passes(a37_guard(spark, d))


@query
def r4_insights(spark, d):
    t = cut(_turns(spark, d))
    labels, tops = stand_in_labels(t), None
    for f in ("validation_type", "steering_reason", "prompt_issue", "agents_rule", "skill_candidate"):
        drop = () if f == "steering_reason" else ("other",)
        one = E.top_label(labels, f, drop).where("n >= 2" if f == "skill_candidate" else "true").select(F.lit(f).alias("field"), "label")
        tops = one if tops is None else tops.unionByName(one)
    return E.insights(E.observations(t, labels), tops)


QUERIES = Q
