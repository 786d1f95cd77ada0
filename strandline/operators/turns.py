"""Turns, interactions and follow-ups from the order of records in a file, as window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from strandline.operators.records import is_spawn, is_tool_call


def in_file() -> WindowSpec:
    return Window.partitionBy("file_path").orderBy("line_no", "record_id")


def so_far() -> WindowSpec:
    return in_file().rowsBetween(Window.unboundedPreceding, 0)


def _is(*kinds: str) -> Column:
    return F.coalesce((F.col("rec_type") == "event_msg") & F.col("kind").isin(*kinds), F.lit(False))


def turns(records: DataFrame) -> DataFrame:
    """(file_path, turn_seq, turn_id, status, model, effort, start_ns, tokens, duration_ms, ttft_ms, tool_calls, uses_subagents).

    A task_started opens a turn and replaces an open one; the first terminal closes it, whatever its id; the
    turn open at the end of the file is incomplete. tokens is the counter at the close minus the counter at the
    start and may be negative; the last non-empty model and effort of the turn's own contexts count.
    """
    start, end = _is("task_started"), _is("task_complete", "turn_aborted")
    counter = F.when(_is("token_count") & F.col("has_info"), F.coalesce("counter", F.lit(0)))
    rows = records.where("turn_ok").withColumn("is_start", start).withColumn("is_end", end)
    rows = rows.withColumn("seg", F.sum(F.col("is_start").cast("int")).over(so_far())).withColumn("total", F.coalesce(F.last(counter, ignorenulls=True).over(so_far()), F.lit(0)))
    rows = rows.where("seg > 0").withColumn("last_seg", F.max("seg").over(Window.partitionBy("file_path")))
    inside = Window.partitionBy("file_path", "seg").orderBy("line_no", "record_id")
    rows = rows.withColumn("closed", F.coalesce(F.sum(F.col("is_end").cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("open_id", F.first("turn_id").over(inside.rowsBetween(Window.unboundedPreceding, 0))).where("closed = 0")
    at = F.struct("line_no", "record_id")
    context = (F.col("rec_type") == "turn_context") & (F.coalesce("turn_id", F.lit("")) == F.coalesce("open_id", F.lit("")))
    last_of = lambda c: F.coalesce(F.max_by(F.when(context & (F.col(c) != ""), F.col(c)), F.when(context & (F.col(c) != ""), at)), F.lit("unknown"))
    ended = F.when(F.col("is_end"), at)
    out = rows.groupBy("file_path", "seg").agg(
        F.min_by("open_id", at).alias("turn_id"), F.max("is_end").alias("ended"), F.max("last_seg").alias("last_seg"),
        F.min_by(F.when(F.col("is_end"), F.col("kind")), ended).alias("end_kind"), last_of("model").alias("model"), last_of("effort").alias("effort"),
        F.min_by("ns", at).alias("start_ns"), (F.max_by("total", at) - F.min_by("total", at)).alias("tokens"),
        F.min_by(F.when(F.col("is_end"), F.coalesce("duration_ms", F.lit(0))), ended).alias("duration_ms"),
        F.min_by(F.when(F.col("kind") == "task_complete", F.coalesce("time_to_first_token_ms", F.lit(0))), ended).alias("ttft_ms"),
        F.count_if(is_tool_call()).alias("tool_calls"), F.max(is_tool_call() & is_spawn()).alias("uses_subagents"),
    )
    status = F.when(F.col("end_kind") == "task_complete", "complete").when(F.col("end_kind") == "turn_aborted", "aborted").otherwise("incomplete")
    kept = out.where("ended or seg = last_seg")
    return kept.select("file_path", F.col("seg").cast("int").alias("turn_seq"), "turn_id", status.alias("status"), "model", "effort", "start_ns", "tokens", "duration_ms", "ttft_ms", "tool_calls", F.coalesce("uses_subagents", F.lit(False)).alias("uses_subagents"))


def interactions(records: DataFrame) -> DataFrame:
    """(file_path, seq, turn_id, start_ns, status, prompt, answer): like turns, but an open one is kept and a repeated start of the same non-empty id is none.

    The prompt is the last text of a completed user item of the same turn id, else the first of the user_message
    events, whatever their id, and of the response items of the same turn id with user text.
    """
    start, end = _is("task_started"), _is("task_complete", "turn_aborted")
    # only starts, ends and rows with user text count, and of them only these columns are shuffled
    legacy = F.when(_is("user_message") & (F.col("message") != ""), F.col("message"))
    response = F.when((F.col("rec_type") == "response_item") & (F.col("kind") == "message"), F.col("input_text"))
    completed = F.when(_is("item_completed"), F.col("completed_text"))
    answer = F.when(_is("task_complete"), F.col("last_agent_message"))
    rows = records.where("inter_ok").select("file_path", "line_no", "record_id", "ns", "kind", "turn_id", start.alias("is_start"), end.alias("is_end"), legacy.alias("legacy"), response.alias("response"), F.when(response.isNotNull(), F.col("input_turn_id")).alias("input_turn_id"), completed.alias("completed"), answer.alias("answer"))
    rows = rows.where("is_start or is_end or coalesce(legacy, response, completed) is not null")
    # the start or end before a row, by the window that numbers the segments
    edge = F.when(F.col("is_start") | F.col("is_end"), F.struct("is_end", F.coalesce("turn_id", F.lit("")).alias("id")))
    rows = rows.withColumn("before", F.last(edge, ignorenulls=True).over(in_file().rowsBetween(Window.unboundedPreceding, -1)))
    fresh = F.col("is_start") & (F.col("before").isNull() | F.col("before.is_end") | (F.coalesce("turn_id", F.lit("")) == "") | (F.col("turn_id") != F.col("before.id")))
    rows = rows.withColumn("fresh", F.coalesce(fresh, F.lit(False)))
    rows = rows.withColumn("seg", F.sum(F.col("fresh").cast("int")).over(so_far())).where("seg > 0")
    inside = Window.partitionBy("file_path", "seg").orderBy("line_no", "record_id")
    rows = rows.withColumn("closed", F.coalesce(F.sum(F.col("is_end").cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("open_id", F.first("turn_id").over(inside.rowsBetween(Window.unboundedPreceding, 0))).where("closed = 0")
    at = F.struct("line_no", "record_id")
    same = lambda c: F.coalesce(c, F.lit("")) == F.coalesce("open_id", F.lit(""))
    completed = F.when(same("turn_id"), F.col("completed"))
    prompt = F.coalesce("legacy", F.when(same("input_turn_id"), F.col("response")))
    answer = F.when(F.col("is_end"), F.col("answer"))
    out = rows.groupBy("file_path", "seg").agg(F.min_by("open_id", at).alias("turn_id"), F.min_by("ns", at).alias("start_ns"), F.min_by(F.when(F.col("is_end"), F.col("kind")), F.when(F.col("is_end"), at)).alias("end_kind"), F.coalesce(F.max_by(completed, F.when(completed.isNotNull(), at)), F.min_by(prompt, F.when(prompt.isNotNull(), at))).alias("prompt"), F.min_by(answer, F.when(answer.isNotNull(), at)).alias("answer"))
    status = F.when(F.col("end_kind") == "task_complete", "complete").when(F.col("end_kind") == "turn_aborted", "aborted").otherwise("incomplete")
    return out.select("file_path", F.col("seg").cast("int").alias("seq"), "turn_id", "start_ns", status.alias("status"), F.coalesce("prompt", F.lit("")).alias("prompt"), F.coalesce("answer", F.lit("")).alias("answer"))


def followups(rows: DataFrame, group: str = "file_path", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """(group, order..., previous_turn_id, turn_id, previous_answer, prompt): neighbours of one file that are both complete, the later with a prompt that is not blank."""
    w = Window.partitionBy(group).orderBy(*order)
    prev = {c: F.lag(c).over(w).alias(f"previous_{c}") for c in ("turn_id", "answer", "status")}
    pairs = rows.select(group, *order, "turn_id", "prompt", "status", *prev.values())
    return pairs.where((F.col("status") == "complete") & (F.col("previous_status") == "complete") & ~F.coalesce(F.col("prompt"), F.lit("")).rlike(r"(?U)^\s*$")).select(group, *order, "previous_turn_id", "turn_id", "previous_answer", "prompt")


def totals(t: DataFrame) -> DataFrame:
    """One row of quick totals: sessions with a turn, turns, completed turns, and sums over the completed ones."""
    done = F.col("status") == "complete"
    return t.agg(F.countDistinct("file_path").alias("sessions"), F.count("*").alias("turns"), F.count_if(done).alias("completed"), *(F.coalesce(F.sum(F.when(done, F.col(c))), F.lit(0)).cast("bigint").alias(f"sum_{c}") for c in ("tokens", "duration_ms", "tool_calls")))


def averages(t: DataFrame) -> DataFrame:
    """Means over completed turns; negative tokens count as they are."""
    done = t.where("status = 'complete'")
    mean = lambda c, k=1.0: F.round(F.sum(c) / F.count("*") / k, 6)
    return done.agg(mean("tokens").alias("mean_tokens"), mean("duration_ms", 1000.0).alias("mean_seconds"), mean("tool_calls").alias("mean_tools"))


def histogram(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys..., n), most first."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys)
