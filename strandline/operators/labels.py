"""Labelling of turns by an injected labeler: inputs, cache, budgeted batches, retries, splits and validation."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.golden import FIELDS, FOLLOWUP_LABELS, MECHANISM_OF, MECHANISMS, SETS, TASK_TYPES

#: Limits of a labeling call, versions in its key, marks of failures worth another try (fixed values).
BATCH, BUDGET, TEXT_CAP, RETRIES, WORKERS = 20, 512 * 1024, 24 * 1024, 2, 6
VERSIONS = ("semantic-v2", "semantic-judge-v2", "semantic-schema-v2")
TRANSIENT = ("rate limit", "ratelimit", "timeout", "temporar", "unavailable", "429", "500", "502", "503", "504", "provider")
TOO_LARGE = ("input_too_large", "input exceeds the maximum length")
EFFORTS = ("minimal", "low", "medium", "high", "xhigh")
CONFIDENCE = {"task_type": "task_confidence", "followup_label": "followup_confidence", "steering_reason": "steering_reason_confidence", "prompt_issue": "prompt_issue_confidence", "agents_rule": "agents_rule_confidence", "skill_candidate": "skill_confidence", "validation_type": "validation_confidence"}
RESULT = "turn_id string, " + ", ".join(f"{f} string, {c} double" for f, c in CONFIDENCE.items()) + ", prevention_mechanisms array<string>, not_preventable boolean, prevention_confidence double"
NAMES = tuple(x.split()[0] for x in RESULT.split(", "))


class TransientError(Exception):
    """A failure worth another try."""


class InvalidAnswer(Exception):
    """An answer that breaks the contract; a batch is halved, a single record fails."""


class TooLarge(Exception):
    """An input the labeler does not take whole; a batch is halved."""


def sort_error(e: Exception) -> Exception:
    """``e`` as the kind of failure its message shows."""
    text = str(e).lower()
    if isinstance(e, TransientError | InvalidAnswer | TooLarge):
        return e
    return TooLarge(str(e)) if any(m in text for m in TOO_LARGE) else TransientError(str(e)) if any(m in text for m in TRANSIENT) else e


def diagnostic(text: str, prompt: str = "", most: int = 512) -> str:
    """What may be shown of a labeler's error output: code and message of its first error object, else its first error line up to the records, never the prompt; a fixed text where there is neither."""
    lines = text.split("\n")
    errors = [(i, x.strip()) for i, x in enumerate(lines) if x.strip().upper().startswith(("ERROR", "[ERROR]"))]
    shown = ""
    for i, line in errors:
        if "{" not in line:
            continue
        try:
            found, _ = json.JSONDecoder().raw_decode("\n".join([line[line.index("{") :], *lines[i + 1 :]]))
        except ValueError:
            continue
        inner = found.get("error") if isinstance(found.get("error"), dict) else found
        pick = lambda *names: next((inner[n].strip() for n in names if isinstance(inner.get(n), str)), "")  # noqa: B023, E731
        parts = [x for x in (pick("code", "type", "error_code"), pick("message", "detail", "error")) if x]
        if parts:
            shown = " ".join(": ".join(parts).split())
            break
    if not shown and errors:
        line = errors[0][1]
        at = line.upper().find("RECORDS:")
        shown = line[:at].strip() if at >= 0 else line
    if not shown:
        return "error output omitted for privacy"
    if prompt:
        shown = shown.replace(prompt, "[prompt omitted]")
    return shown if len(shown.encode()) <= most else shown.encode()[:most].decode("utf-8", "ignore") + "..."


def check_labeler(model: str, effort: str) -> None:
    """ValueError unless the model's name is plain text that no shell or option could misread, and the effort a known one."""
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._/-]*", model) or effort not in EFFORTS:
        raise ValueError("model or effort")


def inputs(tasks: DataFrame, followups: DataFrame) -> DataFrame:
    """(turn_id, prompt, followup_id, followup, previous_answer): each interaction with the last follow-up of its turn id, in the order of files and places; those with neither prompt nor follow-up are left out. Both come with (file_path, seq)."""
    last = followups.groupBy(F.coalesce("previous_turn_id", F.lit("")).alias("id")).agg(F.max_by(F.struct("turn_id", "prompt", "previous_answer"), F.struct("file_path", "seq")).alias("f"))
    rows = tasks.select(F.coalesce("turn_id", F.lit("")).alias("turn_id"), "prompt").join(last.withColumnRenamed("id", "turn_id"), "turn_id", "left")
    rows = rows.select("turn_id", F.coalesce("prompt", F.lit("")).alias("prompt"), F.col("f.turn_id").alias("followup_id"), F.col("f.prompt").alias("followup"), F.col("f.previous_answer").alias("previous_answer"))
    return rows.where((F.col("prompt") != "") | F.col("followup").isNotNull())


def input_problems(rows: DataFrame) -> DataFrame:
    """(turn_id, problem) of inputs no labeling may start with: an empty id, an id given twice, a blank follow-up."""
    blank = F.col("followup").isNotNull() & F.col("followup").rlike(r"(?U)^\s*$")
    g = rows.groupBy("turn_id").agg(F.count("*").alias("n"), F.max(blank).alias("blank"))
    return g.select("turn_id", F.when(F.col("turn_id") == "", "empty id").when(F.col("n") > 1, "repeated id").when(F.col("blank"), "blank follow-up").alias("problem")).where("problem is not null")


def cache_key(model: str, effort: str, versions: tuple[str, ...] = VERSIONS) -> Column:
    """SHA-256 over versions, settings and the record's id and prompt, and over the follow-up's id, prompt and answer if there is one; a NUL follows each, so that no two records can run together."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    ended = lambda ps: F.concat(*(x for p in ps for x in (p, F.lit("\x00"))))
    own = ended([*map(F.lit, (*versions, model, effort)), text("turn_id"), text("prompt")])
    later = F.when(F.col("followup").isNotNull(), ended([text("followup_id"), text("followup"), text("previous_answer")])).otherwise("")
    return F.concat(F.lit("semantic:"), F.sha2(F.concat(own, later), 256))


def pending(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows whose key the cache does not have."""
    return rows.join(cache.select("cache_key"), "cache_key", "left_anti")


def cap_text(text: str | None, cap: int = TEXT_CAP, marker: str = "\n…\n") -> str | None:
    """Head and tail of a text within ``cap`` bytes of UTF-8, never splitting a code point."""
    raw = (text or "").encode("utf-8", "replace")
    if text is None or len(raw) <= cap:
        return text
    room = cap - len(marker.encode())
    head, tail = raw[: room // 2], raw[len(raw) - (room - room // 2) :]
    return head.decode("utf-8", "ignore") + marker + tail.decode("utf-8", "ignore")


def serialise(record: dict) -> str:
    """Compact JSON of a record: turn_id, prompt and, if it has one, its follow-up."""
    out = {"turn_id": record["turn_id"], "prompt": cap_text(record.get("prompt") or "")}
    if record.get("followup") is not None:
        out["followup"] = {"turn_id": record.get("followup_id") or "", "prompt": cap_text(record["followup"]), "previous_answer": cap_text(record.get("previous_answer") or "")}
    return json.dumps(out, ensure_ascii=False, separators=(",", ":"))


def plan_batches(records: list[dict], most: int = BATCH, budget: int = BUDGET) -> list[list[dict]]:
    """Greedy batches in order, within a count and a size in bytes; a record above the budget goes alone."""
    out: list[list[dict]] = []
    size = 0
    for r in records:
        n = len(serialise(r).encode()) + 1
        if not out or len(out[-1]) >= most or size + n > budget:
            out.append([])
            size = 0
        out[-1].append(r)
        size += n
    return out


def answer_problem(record: dict, a: dict) -> str | None:
    """The first rule that an answer breaks, or None: a task type exactly where there is a prompt, a follow-up label exactly where there is a follow-up, and what belongs to steering only there."""
    given = lambda *cs: any(a.get(c) is not None for c in cs)
    known = lambda f: a.get(f) in SETS[f] and a.get(CONFIDENCE[f]) is not None
    late = [x for f in FIELDS[2:] for x in (f, CONFIDENCE[f])]
    mechanisms = list(a["prevention_mechanisms"]) if a.get("prevention_mechanisms") is not None else []
    if not record.get("prompt"):
        if given("task_type", "task_confidence"):
            return "task type without prompt"
    elif not known("task_type"):
        return "task type"
    if a.get("not_preventable") is None:
        return "not_preventable"
    steering_fields = given(*late, "prevention_confidence") or a["not_preventable"] or mechanisms
    if record.get("followup") is None:
        return "follow-up field without follow-up" if given("followup_label", "followup_confidence") or steering_fields else None
    if not known("followup_label"):
        return "follow-up label"
    if a["followup_label"] != "steering":
        return "steering field without steering" if steering_fields else None
    if not known("steering_reason"):
        return "steering reason"
    if set(mechanisms) - set(MECHANISMS) or len(set(mechanisms)) < len(mechanisms):
        return "mechanisms"
    if bool(mechanisms) == bool(a["not_preventable"]):
        return "not_preventable against mechanisms"
    if given("prevention_confidence") != bool(mechanisms):
        return "prevention confidence"
    for f, m in MECHANISM_OF.items():
        if not known(f) if m in mechanisms else given(f, CONFIDENCE[f]):
            return f
    return None


def check_answer(batch: list[dict], answers: list[dict]) -> list[dict]:
    """The answers in the order of the batch; InvalidAnswer unless each id is there once, without unknown fields, and breaks no rule."""
    by = {a.get("turn_id"): a for a in answers}
    if len(by) != len(answers) or by.keys() != {r["turn_id"] for r in batch}:
        raise InvalidAnswer("ids")
    for r in batch:
        a = by[r["turn_id"]]
        problem = "unknown field" if a.keys() - set(NAMES) else answer_problem(r, a)
        if problem:
            raise InvalidAnswer(f"{r['turn_id']}: {problem}")
    return [by[r["turn_id"]] for r in batch]


def result_violations(rows: DataFrame) -> DataFrame:
    """(turn_id, problem): the rules of :func:`answer_problem` over a table of inputs joined with their results (RESULT), in one pass."""
    c, has = F.col, lambda *cs: F.coalesce(*(F.when(F.col(x).isNotNull(), F.lit(True)) for x in cs), F.lit(False))
    known = lambda f: F.coalesce(c(f).isin(*SETS[f]), F.lit(False)) & has(CONFIDENCE[f])
    late = [x for f in FIELDS[2:] for x in (f, CONFIDENCE[f])]
    ms = F.coalesce("prevention_mechanisms", F.array().cast("array<string>"))
    steering_fields = has(*late, "prevention_confidence") | F.coalesce(c("not_preventable"), F.lit(False)) | (F.size(ms) > 0)
    prompt, late_one = F.coalesce(c("prompt"), F.lit("")) != "", has("followup")
    steering = late_one & (c("followup_label") == "steering")
    rules = [
        (~prompt & has("task_type", "task_confidence"), "task type without prompt"), (prompt & ~known("task_type"), "task type"), (~has("not_preventable"), "not_preventable"),
        (~late_one & (has("followup_label", "followup_confidence") | steering_fields), "follow-up field without follow-up"), (late_one & ~known("followup_label"), "follow-up label"),
        (late_one & (c("followup_label") != "steering") & steering_fields, "steering field without steering"), (steering & ~known("steering_reason"), "steering reason"),
        (steering & ((F.size(F.array_except(ms, F.array(*map(F.lit, MECHANISMS)))) > 0) | (F.size(F.array_distinct(ms)) < F.size(ms))), "mechanisms"),
        (steering & ((F.size(ms) > 0) == c("not_preventable")), "not_preventable against mechanisms"), (steering & (has("prevention_confidence") != (F.size(ms) > 0)), "prevention confidence"),
        *((steering & F.when(F.array_contains(ms, m), ~known(f)).otherwise(has(f, CONFIDENCE[f])), f) for f, m in MECHANISM_OF.items()),
    ]
    return rows.select("turn_id", F.coalesce(*(F.when(r, F.lit(p)) for r, p in rules)).alias("problem")).where("problem is not null")


def label_batch(batch: list[dict], labeler: Callable[[list[str]], list[dict]], retries: int = RETRIES, wait: Callable[[float], None] = time.sleep, check: Callable[[list[dict], list[dict]], list[dict]] = check_answer) -> list[dict]:
    """Answers of a batch: transient failures are tried again after 1, 2, 4... at most 5 seconds; a batch that is too large or whose answers are invalid is halved, down to single records."""
    for k in range(retries + 1):
        try:
            return check(batch, labeler([serialise(r) for r in batch]))
        except Exception as e:
            kind = sort_error(e)
            if isinstance(kind, TransientError) and k < retries:
                wait(min(5.0, 2.0**k))
                continue
            if isinstance(kind, InvalidAnswer) and len(batch) == 1 and k < retries:
                continue
            if isinstance(kind, InvalidAnswer | TooLarge) and len(batch) > 1:
                break
            if kind is e:
                raise
            raise kind from e
    half = len(batch) // 2
    return label_batch(batch[:half], labeler, retries, wait, check) + label_batch(batch[half:], labeler, retries, wait, check)


def label(rows: DataFrame, labeler: Callable[[list[str]], list[dict]], workers: int = WORKERS, most: int = BATCH, budget: int = BUDGET) -> DataFrame:
    """Labels of ``rows`` by an injected labeler, one call a batch, at most ``workers`` at a time. A failure ends the job; what :func:`label_into` has written stays."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            records = [{k: v for k, v in r.items() if v is not None} for r in p.to_dict("records")]
            for b in plan_batches(records, most, budget):
                yield pd.DataFrame([{n: a.get(n) for n in NAMES} for a in label_batch(b, labeler)], columns=[*NAMES])

    return rows.select("turn_id", "prompt", "followup_id", "followup", "previous_answer").repartition(workers, "turn_id").mapInPandas(run, RESULT)


def label_into(rows: DataFrame, labeler: Callable[[list[str]], list[dict]], path: str, model: str, effort: str, slices: int = 16, **limits: int) -> dict[str, int]:
    """Label what the cache at ``path`` does not have, a slice of the keys after the other, each appended as soon as it is done, so that a later failure costs no earlier answers. Counts of hits and evaluated records come back."""
    from strandline.sources.cache import append_cache, read_cache

    check_labeler(model, effort)
    keyed = rows.withColumn("cache_key", cache_key(model, effort))
    todo = pending(keyed, read_cache(rows.sparkSession, path, RESULT))
    total, left = keyed.count(), todo.count()
    for k in range(slices if left else 0):
        part = todo.where(F.pmod(F.xxhash64("cache_key"), F.lit(slices)) == k)
        done = label(part, labeler, **limits)
        append_cache(part.select("cache_key", "turn_id").join(done, "turn_id"), path)
    return {"total": total, "hits": total - left, "evaluated": left}


def in_order(cases: DataFrame, results: DataFrame, key: str = "turn_id", order: str = "input_idx") -> DataFrame:
    """Results in the order of their cases, with ``found`` false for a case without one."""
    return cases.select(key, order).join(results.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False))).orderBy(order)


def rule_labeler(records: list[str]) -> list[dict]:
    """A deterministic stand-in for tests: labels by hash of the id, no judgement of quality."""
    out = []
    for r in map(json.loads, records):
        h = hashlib.md5(r["turn_id"].encode()).hexdigest()
        pick = lambda at, values: values[ord(h[at]) % len(values)]  # noqa: B023, E731
        a = {"turn_id": r["turn_id"], "not_preventable": False}
        if r["prompt"]:
            a |= {"task_type": pick(0, TASK_TYPES), "task_confidence": 1.0}
        if "followup" in r:
            a |= {"followup_label": pick(1, FOLLOWUP_LABELS), "followup_confidence": 1.0}
            if a["followup_label"] == "steering":
                ms = list(MECHANISMS[: ord(h[4]) % 4])
                a |= {"steering_reason": pick(2, SETS["steering_reason"]), "steering_reason_confidence": 1.0, "prevention_mechanisms": ms, "not_preventable": not ms, "prevention_confidence": 1.0 if ms else None}
                for n, (f, m) in enumerate(MECHANISM_OF.items()):
                    if m in ms:
                        a |= {f: pick(5 + n, SETS[f]), CONFIDENCE[f]: 1.0}
        out.append(a)
    return out


def result_views(labels: DataFrame) -> dict[str, DataFrame]:
    """The narrow relations of a wide label row, one a classification."""
    out = {f: labels.where(F.col(f).isNotNull()).select("turn_id", f, c) for f, c in CONFIDENCE.items()}
    steering = labels.where("followup_label = 'steering'")
    return out | {"prevention": steering.select("turn_id", "prevention_mechanisms", "not_preventable", "prevention_confidence")}


@dataclass(frozen=True)
class Classifier:
    """One of the single-label classifiers: its key, the records of a call, what it labels and which cases it takes."""

    name: str
    version: str
    field: str
    batch: int = 10
    label: str = ""  # takes only follow-ups with this label
    mechanism: str = ""  # takes only follow-ups with this mechanism


#: The single-label classifiers (fixed values).
CLASSIFIERS = {
    c.name: c
    for c in (
        Classifier("task-type", "task-type-v1", "task_type", 25),
        Classifier("steering", "steering-v1", "followup_label"),
        Classifier("steering-reason", "steering-reason-v1", "steering_reason", label="steering"),
        Classifier("prevention", "prevention-v1", "prevention_mechanisms", label="steering"),
        Classifier("prompt-quality", "prompt-quality-v1", "prompt_issue", mechanism="task_prompt"),
        Classifier("agents-rules", "agents-rules-v1", "agents_rule", mechanism="agents_md"),
        Classifier("skill-candidates", "skill-candidates-v1", "skill_candidate", mechanism="skill"),
        Classifier("validation", "validation-v1", "validation_type", mechanism="validation"),
    )
}


def classifier_cases(c: Classifier, rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The records a classifier takes of ``rows`` (turn_id, prompt, followup, previous_answer): all prompts for task types, all follow-ups for steering, else those the earlier ``labels`` let through."""
    if c.field == "task_type":
        return rows.where("prompt <> ''")
    cases = rows.where("followup is not null")
    if c.label:
        cases = cases.join(labels.where(F.col("followup_label") == c.label).select("turn_id").distinct(), "turn_id", "left_semi")
    if c.mechanism:
        cases = cases.join(labels.where(F.array_contains("prevention_mechanisms", c.mechanism)).select("turn_id").distinct(), "turn_id", "left_semi")
    return cases


def classifier_key(c: Classifier) -> Column:
    """The cache key of a classifier's record: version, id and texts with a NUL between them, none behind the last."""
    texts = ["prompt"] if c.field == "task_type" else ["previous_answer", "followup"]
    parts = [F.lit(c.version), *(F.coalesce(F.col(x), F.lit("")) for x in ("turn_id", *texts))]
    return F.concat(F.lit(c.name + ":"), F.sha2(F.concat_ws("\x00", *parts), 256))


def classifier_check(c: Classifier) -> Callable[[list[dict], list[dict]], list[dict]]:
    """The check of a classifier's answers: each id once, a known label; mechanisms are made distinct and must be there unless the case is not preventable."""

    def check(batch: list[dict], answers: list[dict]) -> list[dict]:
        by = {a.get("turn_id"): dict(a) for a in answers}
        if len(by) != len(answers) or by.keys() != {r["turn_id"] for r in batch}:
            raise InvalidAnswer("ids")
        for a in by.values():
            if c.field == "prevention_mechanisms":
                a["prevention_mechanisms"] = list(dict.fromkeys(a.get("prevention_mechanisms") or []))
                if set(a["prevention_mechanisms"]) - set(MECHANISMS) or bool(a["prevention_mechanisms"]) == bool(a.get("not_preventable")):
                    raise InvalidAnswer(str(a.get("turn_id")))
            elif a.get(c.field) not in SETS[c.field]:
                raise InvalidAnswer(str(a.get("turn_id")))
        return [by[r["turn_id"]] for r in batch]

    return check


def classify(c: Classifier, rows: DataFrame, labels: DataFrame, labeler: Callable[[list[str]], list[dict]], workers: int = WORKERS) -> DataFrame:
    """(turn_id, value, not_preventable) of the cases of one classifier; sets of mechanisms are joined by commas."""
    check = classifier_check(c)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            records = [{k: v for k, v in r.items() if v is not None} for r in p.to_dict("records")]
            for b in plan_batches(records, c.batch):
                answers = label_batch(b, labeler, check=check)
                yield pd.DataFrame([(a["turn_id"], ",".join(a[c.field]) if isinstance(a[c.field], list) else a[c.field], a.get("not_preventable")) for a in answers], columns=["turn_id", "value", "not_preventable"])

    cases = classifier_cases(c, rows, labels)
    return cases.select("turn_id", "prompt", "followup_id", "followup", "previous_answer").repartition(workers, "turn_id").mapInPandas(run, "turn_id string, value string, not_preventable boolean")
