"""Labelled fixtures: redaction, candidates, validation and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Closed label sets (fixed values).
TASK_TYPES = ("bugfix", "feature", "refactor", "tests", "code_review", "architecture", "devops", "research", "documentation", "other")
FOLLOWUP_LABELS = ("steering", "continuation", "user_correction", "question")
STEERING_REASONS = ("misunderstood_request", "overengineering", "implementation_error", "ignored_constraints", "insufficient_validation", "architecture_mismatch", "wrong_output_format", "other")
MECHANISMS = ("agents_md", "skill", "task_prompt", "validation")
PROMPT_ISSUES = ("missing_constraints", "missing_context", "ambiguous_request", "missing_acceptance", "missing_scope", "wrong_assumption", "other")
AGENTS_RULES = ("avoid_unnecessary_complexity", "preserve_project_architecture", "follow_explicit_constraints", "avoid_scope_creep", "inspect_existing_code_first", "validate_before_completion", "follow_requested_output_format", "other")
SKILLS = ("implementation_prompt_file", "bounded_architecture_review", "verification_workflow", "other")
VALIDATIONS = ("tests", "static_analysis", "runtime_smoke_check", "deployment_check", "output_validation", "diff_review", "data_validation", "other")
SETS = {"task_type": TASK_TYPES, "followup_label": FOLLOWUP_LABELS, "steering_reason": STEERING_REASONS, "prompt_issue": PROMPT_ISSUES, "agents_rule": AGENTS_RULES, "skill_candidate": SKILLS, "validation_type": VALIDATIONS}
FIELDS = tuple(SETS)
#: The mechanism that each follow-on label belongs to (fixed values).
MECHANISM_OF = {"prompt_issue": "task_prompt", "agents_rule": "agents_md", "skill_candidate": "skill", "validation_type": "validation"}
#: Length of an exported text in code points, and what stands between its head and tail (fixed values).
CAP, CUT = 2400, "\n...[truncated]...\n"
#: What an exported text may not hold, with its placeholder (fixed values).
SECRETS = (
    (r"(?s)```.*?```", "[redacted code]"),
    (r"(?i)\b[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}\b", "[redacted email]"),
    (r"(?i)\b(?:bearer\s+|token\s*[=:]\s*|api[_-]?key\s*[=:]\s*|sk-[a-z0-9_-]+|gh[pousr]_[a-z0-9_-]+)[^\s,;]*", "[redacted token]"),
    (r"/Users/[^\s\"']+|/home/[^\s\"']+|[A-Za-z]:\\Users\\[^\s\"']+", "[redacted local path]"),
)


def redact(c: Column, cap: int = CAP) -> Column:
    """Fenced code, email addresses, credentials and home paths become placeholders, in this order; of what then exceeds the cap head and tail stay."""
    t = F.coalesce(c, F.lit(""))
    for pattern, name in SECRETS:
        t = F.regexp_replace(t, pattern, name)
    head = cap // 2
    return F.when(F.char_length(t) > cap, F.concat(F.substring(t, 1, head), F.lit(CUT), F.right(t, F.lit(cap - head)))).otherwise(t)


def candidates(inputs: DataFrame, n: int = 50) -> DataFrame:
    """The first ``n`` of (turn_id, prompt, previous_answer, followup) by lower-case text and id, as redacted cases named in order. A global top-k, taken before numbering."""
    key = F.lower(F.concat(F.coalesce("prompt", F.lit("")), F.lit("\x00"), F.coalesce("followup", F.lit(""))))
    top = inputs.withColumn("k", key).orderBy("k", "turn_id").limit(n)
    w = Window.orderBy("k", "turn_id")  # n rows
    return top.select(F.format_string("case-%06d", F.row_number().over(w)).alias("id"), redact(F.col("prompt")).alias("prompt"), redact(F.col("previous_answer")).alias("previous_answer"), redact(F.col("followup")).alias("followup"))


def violations(cases: DataFrame) -> DataFrame:
    """(case_id, problem): the first broken rule of each case, in order of precedence. Null and empty labels are absent; null mechanisms are absent, an empty list is an answer."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    any_of = lambda *cs: [has(c) for c in cs]
    either = lambda cs: cs[0] if len(cs) == 1 else cs[0] | either(cs[1:])
    mechanisms, given = F.coalesce("prevention_mechanisms", F.array().cast("array<string>")), F.col("prevention_mechanisms").isNotNull()
    other = has("followup_label") & (F.col("followup_label") != "steering")
    late = any_of(*FIELDS[1:])
    copies = F.row_number().over(Window.partitionBy("case_id").orderBy("prompt", "followup_prompt"))
    rules = [
        (~F.coalesce("case_id", F.lit("")).rlike("^case-[0-9a-f]{2,}$"), "invalid id"),
        (copies > 1, "duplicate id"),
        (~has("prompt") & ~has("followup_prompt"), "no input"),
        (~either(any_of(*FIELDS)) & ~given, "nothing expected"),
        *((has(f) & ~F.col(f).isin(*v), f"unknown {f}") for f, v in SETS.items()),
        (has("task_type") & ~has("prompt"), "task type without prompt"),
        (~has("followup_prompt") & (either(late) | given), "label without follow-up"),
        (F.size(F.array_except(mechanisms, F.array(*map(F.lit, MECHANISMS)))) > 0, "unknown mechanism"),
        (F.size(F.array_distinct(mechanisms)) < F.size(mechanisms), "duplicate mechanism"),
        (other & has("steering_reason"), "reason without steering"),
        (other & (either(any_of(*MECHANISM_OF)) | (F.size(mechanisms) > 0)), "steering field without steering"),
        *((given & has(f) & ~F.array_contains(mechanisms, m), f"{f} without mechanism") for f, m in MECHANISM_OF.items()),
    ]
    problem = F.coalesce(*(F.when(c, F.lit(p)) for c, p in rules))
    return cases.select("case_id", problem.alias("problem")).where("problem is not null")


def result_problems(cases: DataFrame, results: DataFrame) -> DataFrame:
    """(problem, case_id) of what forbids an evaluation: another number of results than cases, a result given twice, a case without result. No rows where all is in order."""
    n = cases.agg(F.count("*").alias("cases")).join(F.broadcast(results.agg(F.count("*").alias("results"))))  # one row each
    off = n.where("cases <> results").select(F.lit("result count").alias("problem"), F.lit("").alias("case_id"))
    twice = results.groupBy("case_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate result").alias("problem"), "case_id")
    missing = cases.join(results, "case_id", "left_anti").select(F.lit("missing result").alias("problem"), "case_id")
    return off.unionByName(twice).unionByName(missing)


def _unpivot(pairs: DataFrame) -> DataFrame:
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.nullif(F.col(f"expected.{f}"), F.lit("")).alias("expected"), F.col(f"predicted.{f}").alias("predicted")) for f in FIELDS))
    return pairs.select(F.explode(each).alias("x")).select("x.*").where("expected is not null")


def accuracy(pairs: DataFrame) -> DataFrame:
    """(field, samples, correct, accuracy) over (expected, predicted) structs; only fields with an expected value count."""
    g = _unpivot(pairs).groupBy("field").agg(F.count("*").alias("samples"), F.count_if(F.col("expected").eqNullSafe(F.col("predicted"))).alias("correct"))
    return g.withColumn("accuracy", F.round(F.col("correct") / F.col("samples"), 6)).orderBy("field")


def confusion(pairs: DataFrame) -> DataFrame:
    """(field, expected, predicted, n) of the mismatches; sets of mechanisms are one value, sorted and joined by commas."""
    wrong = _unpivot(pairs).where("not expected <=> predicted").select("field", "expected", F.coalesce("predicted", F.lit("")).alias("predicted"))
    one = lambda c: F.array_join(F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>")))), ",")
    sets = pairs.where("expected.prevention_mechanisms is not null").select(F.lit("prevention").alias("field"), one(F.col("expected.prevention_mechanisms")).alias("expected"), one(F.col("predicted.prevention_mechanisms")).alias("predicted")).where("expected <> predicted")
    return wrong.unionByName(sets).groupBy("field", "expected", "predicted").agg(F.count("*").alias("n")).orderBy("field", "expected", "predicted")


def micro_scores(pairs: DataFrame, field: str = "prevention_mechanisms") -> DataFrame:
    """Micro precision, recall, F1 and exact matches of a set of labels; null expects nothing, an empty set is an answer."""
    e, p = F.array_distinct(f"expected.{field}"), F.array_distinct(F.coalesce(f"predicted.{field}", F.array().cast("array<string>")))
    rows = pairs.where(F.col(f"expected.{field}").isNotNull()).select(F.size(F.array_intersect(e, p)).alias("tp"), F.size(e).alias("e"), F.size(p).alias("p"))
    sums = rows.agg(F.count("*").alias("samples"), F.coalesce(F.sum("tp"), F.lit(0)).alias("tp"), F.coalesce(F.sum("e"), F.lit(0)).alias("e"), F.coalesce(F.sum("p"), F.lit(0)).alias("p"), F.count_if((F.col("tp") == F.col("e")) & (F.col("e") == F.col("p"))).alias("exact"))
    ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    return sums.select("samples", "exact", ratio(F.col("tp"), F.col("p")).alias("precision"), ratio(F.col("tp"), F.col("e")).alias("recall"), ratio(2.0 * F.col("tp"), F.col("e") + F.col("p")).alias("f1"))


def semantic_snapshot(followups: DataFrame, labels: DataFrame) -> DataFrame:
    """(cohort, samples, steering_rate): follow-ups with a label, over all (``""``) and by the task type of the turn before them, the rate in percent."""
    rows = followups.select(F.col("previous_turn_id").alias("turn_id")).join(labels.where("followup_label <> ''").select("turn_id", F.coalesce("task_type", F.lit("unknown")).alias("task_type"), "followup_label"), "turn_id")
    both = rows.withColumn("cohort", F.explode(F.array(F.lit(""), F.col("task_type"))))
    return both.groupBy("cohort").agg(F.count("*").alias("samples"), F.round(F.count_if(F.col("followup_label") == "steering") * 100.0 / F.count("*"), 6).alias("steering_rate"))


#: The snapshot of the one history the guard knows (fixed values): metric, value, decimals it is compared in.
HISTORY = (("tasks", 1046.0, 0), ("complete", 1023.0, 0), ("aborted", 20.0, 0), ("incomplete", 3.0, 0), ("followups", 930.0, 0), ("mean_tokens", 1652761.0, 0), ("mean_seconds", 258.3, 1), ("mean_tools", 15.6, 1))
#: Its steering rates in percent with their tolerance, and the least samples of a cohort; "" is all (fixed values).
RATES, SAMPLES, LEAST = (("", 14.8, 1.5), ("refactor", 30.0, 8.0), ("architecture", 20.6, 8.0)), 930, 10


def guard(snapshot: DataFrame, rates: DataFrame, history: tuple = HISTORY, expected: tuple = RATES, samples: int = SAMPLES) -> DataFrame:
    """(metric, expected, actual, verdict): a (metric, value) snapshot and a :func:`semantic_snapshot` held against a history.

    A rounded value that differs is a ``mismatch``; a rate beyond its tolerance, a cohort that is absent or has
    too few samples, and another number of samples are a ``warning``.
    """
    spark = snapshot.sparkSession
    want = F.broadcast(spark.createDataFrame([*history], "metric string, expected double, digits int"))
    off = [F.coalesce(F.round("value", d) != F.col("expected"), F.lit(True)) for d in (0, 1)]
    exact = want.join(snapshot, "metric", "left").select("metric", "expected", F.round("value", 6).alias("actual"), F.when(F.when(F.col("digits") == 0, off[0]).otherwise(off[1]), "mismatch").otherwise("pass").alias("verdict"))
    near = F.broadcast(spark.createDataFrame([*expected], "cohort string, expected double, tolerance double")).join(rates, "cohort", "left")
    beyond = F.col("samples").isNull() | (F.col("cohort") != "") & (F.col("samples") < LEAST) | (F.abs(F.col("steering_rate") - F.col("expected")) > F.col("tolerance") + 1e-9)
    rate = near.select(F.concat(F.lit("steering "), F.when(F.col("cohort") == "", "all").otherwise(F.col("cohort"))).alias("metric"), "expected", F.col("steering_rate").alias("actual"), F.when(beyond, "warning").otherwise("pass").alias("verdict"))
    count = near.where("cohort = ''").select(F.lit("samples").alias("metric"), F.lit(float(samples)).alias("expected"), F.col("samples").cast("double").alias("actual"), F.when(F.coalesce(F.col("samples"), F.lit(0)) != samples, "warning").otherwise("pass").alias("verdict"))
    return exact.unionByName(rate).unionByName(count)


def guard_passes(checks: DataFrame) -> DataFrame:
    """(passes, fails): a guard passes without mismatch and warning and fails with a mismatch."""
    bad = lambda v: F.count_if(F.col("verdict") == v)
    return checks.agg((bad("mismatch") + bad("warning") == 0).alias("passes"), (bad("mismatch") > 0).alias("fails"))
