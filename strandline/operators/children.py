"""Working turns of spawned agents: the facts of their files, merged by agent and turn, and what each turn used.

Everything is keyed by (owner, turn_id), where the owner is an agent's or a user session's id: the facts of all
its files are one long table, and a turn is a group of it. The order of records in a file decides which turn is
open, by window functions over the file; nothing else depends on it. Copies of a file add no new facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions.timestamps import instant_ns
from strandline.operators.records import USAGE, is_tool_call
from strandline.operators.usage import PARTS, filled_total, is_valid, validated
from strandline.session import cut_counting, free

TURN = ("side", "owner", "turn_id")


def children(files: DataFrame) -> DataFrame:
    """``files`` of :func:`records.child_meta` as one row an agent: (owner, files, parent_id, role, depth, has_depth, started_at, forked, and a flag a conflict).

    Copies that differ in an attribute are in conflict about it; the attribute is then absent, the role ``unknown``.
    """
    many = lambda *c: F.count_distinct(F.struct(*c)) > 1
    g = files.where("id <> ''").withColumn("created_ns", instant_ns(F.col("started_at"))).groupBy(F.col("id").alias("owner")).agg(
        F.count("*").alias("files"), many("started_at").alias("creation_conflict"), many("role").alias("role_conflict"), many("depth", "has_depth").alias("depth_conflict"),
        many("forked_from_id").alias("fork_conflict"), many("parent_id").alias("parent_conflict"), *(F.min(c).alias(c) for c in ("parent_id", "role", "depth", "has_depth", "started_at", "forked_from_id", "created_ns")),
    )
    return g.select(
        "owner", "files", F.when(F.col("parent_conflict"), "").otherwise(F.col("parent_id")).alias("parent_id"),
        F.when(F.col("role_conflict") | (F.col("role") == ""), "unknown").otherwise(F.col("role")).alias("role"),
        "depth", (F.col("has_depth") & ~F.col("depth_conflict")).alias("has_depth"), "started_at", "created_ns",
        (~F.col("fork_conflict") & (F.col("forked_from_id") != "")).alias("forked"), "creation_conflict", "role_conflict", "depth_conflict", "fork_conflict", "parent_conflict",
        F.expr("creation_conflict or role_conflict or depth_conflict or fork_conflict or parent_conflict").alias("attribute_conflict"),
    )


def malformed() -> Column:
    """True for a record of an agent's file that its reader counts as malformed."""
    event, null = F.col("rec_type") == "event_msg", F.col("ns").isNull()
    lifecycle = event & F.col("child_ok") & F.col("kind").isin("task_started", "task_complete", "turn_aborted") & (F.coalesce("turn_id", F.lit("")) == "")
    keyed = F.col("rec_type").isin("turn_context", "token_usage_record") & (~F.col("child_ok") | (F.coalesce("turn_id", F.lit("")) == ""))
    return F.coalesce(null | event & ~F.col("child_ok") | lifecycle | keyed, F.lit(False))


def facts(records: DataFrame, files: DataFrame) -> DataFrame:
    """The facts of ``files`` (file_path, owner, side, forked) as a long table, a row a fact.

    what is start, end, ambiguous (its counters overlap another turn's), setting, usage, counter (``base`` is the
    counter at the turn's first start in the file, ``usage`` the snapshot) or tool. Records without a readable
    instant give none. A start opens its turn and takes the place of an open one, which leaves the counters of both
    ambiguous; an end of the same id at or after the turn's earliest start so far closes it.
    """
    rows = records.where("child_ok and ns is not null").join(files.select("file_path", "owner", "side", "forked"), "file_path")
    rows = rows.withColumn("at", F.struct("line_no", "record_id"))
    event, named = F.col("rec_type") == "event_msg", F.coalesce("turn_id", F.lit("")) != ""
    is_s, is_e = event & (F.col("kind") == "task_started") & named, event & F.col("kind").isin("task_complete", "turn_aborted") & named
    is_c, is_k, is_t = event & (F.col("kind") == "token_count") & F.col("has_count"), F.col("rec_type") == "compacted", is_tool_call()
    flags = {"s": is_s, "e": is_e, "c": is_c, "k": is_k, "t": is_t, "context": (F.col("rec_type") == "turn_context") & named, "used": (F.col("rec_type") == "token_usage_record") & named}
    flow = rows.select("*", *(F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items())).where(" or ".join(flags))
    w = Window.partitionBy("file_path").orderBy("line_no", "record_id")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    own = Window.partitionBy("file_path", "turn_id").orderBy("line_no", "record_id").rowsBetween(Window.unboundedPreceding, 0)
    flow = flow.withColumn("earliest", F.when(F.col("s"), F.min(F.when(F.col("s"), F.col("ns"))).over(own)))
    flow = flow.withColumn("seg", F.sum(F.col("s").cast("int")).over(so_far)).withColumn("open", F.last(F.when(F.col("s"), F.struct("turn_id", "earliest")), ignorenulls=True).over(so_far))
    closes = F.col("e") & (F.col("turn_id") == F.col("open.turn_id")) & (F.col("ns") >= F.col("open.earliest"))
    inside = Window.partitionBy("file_path", "seg").orderBy("line_no", "record_id").rowsBetween(Window.unboundedPreceding, 0)
    flow = flow.withColumn("cur", F.when(F.max(F.coalesce(closes, F.lit(False))).over(inside), None).otherwise(F.col("open.turn_id")))
    flow = flow.withColumn("prev", F.lag("cur").over(w)).withColumn("overlap", F.col("s") & F.coalesce(F.col("prev") != F.col("turn_id"), F.lit(False)))
    unknown = F.struct(*(F.lit(None).cast("bigint").alias(n) for n in USAGE))
    zero = F.struct(*(F.lit(0).cast("bigint").alias(n) for n in USAGE))
    counter = F.last(F.when(F.col("c"), F.col("count")).when(F.col("k") | F.col("overlap"), unknown), ignorenulls=True).over(so_far)
    flow = flow.withColumn("counter_now", F.coalesce(counter, zero))
    mine = Window.partitionBy("file_path", "cur").orderBy("line_no", "record_id").rowsBetween(Window.unboundedPreceding, 0)
    flow = flow.withColumn("base", F.first(F.when(F.col("s"), F.col("counter_now")), ignorenulls=True).over(mine))
    foreign = F.coalesce(F.col("turn_id") != F.col("cur"), F.lit(False)) & named
    # each record is up to three facts: one pass, no second reading of the file
    is_a = lambda when, what, turn: F.when(when, F.struct(F.lit(what).alias("what"), F.col(turn).alias("turn_id")))
    found = F.array_compact(F.array(
        is_a(F.col("s"), "start", "turn_id"), is_a(F.col("e"), "end", "turn_id"), is_a(F.col("overlap"), "ambiguous", "prev"), is_a(F.col("overlap"), "ambiguous", "turn_id"),
        is_a(F.col("c") & F.col("cur").isNotNull() & ~F.col("forked"), "counter", "cur"), is_a(F.col("t") & F.col("cur").isNotNull(), "tool", "cur"), is_a(F.col("context"), "setting", "turn_id"), is_a(F.col("used"), "usage", "turn_id"),
    ))
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    rows = flow.withColumn("fact", F.explode(found))
    usage = F.when(F.col("used"), F.col("usage")).when(F.col("c"), F.when(foreign, unknown).otherwise(F.col("count")))
    return rows.select(
        "owner", "side", F.col("fact.turn_id").alias("turn_id"), "file_path", "forked", "at", F.col("fact.what").alias("what"), "ns", "rec_ts", F.when(F.col("e"), F.when(F.col("kind") == "task_complete", "complete").otherwise("aborted")).alias("status"),
        "duration_ms", "bad_duration", *(blank(c) for c in ("model", "effort", "root_turn_id", "thread_id", "response_id", "call_id")), usage.alias("usage"), F.when(F.col("c"), F.col("base")).alias("base"),
    )


def timed(f: DataFrame) -> DataFrame:
    """``f`` with the earliest start of each turn and the instant of its last end at or after it."""
    w = Window.partitionBy(*TURN)
    f = f.withColumn("start_ns", F.min(F.when(F.col("what") == "start", F.col("ns"))).over(w))
    return f.withColumn("end_ns", F.max(F.when((F.col("what") == "end") & (F.col("ns") >= F.col("start_ns")), F.col("ns"))).over(w))


def ownership(f: DataFrame) -> DataFrame:
    """(owner, turn_id, owned, vote_conflict) of turns with usage in forked files: in each file the last record's thread decides, and any disagreement is a conflict."""
    vote = F.col("thread_id") == F.col("owner")
    by_file = f.where("what = 'usage' and forked").groupBy(*TURN, "file_path").agg(F.max_by(vote, "at").alias("owned"), (F.count_distinct(vote) > 1).alias("vote_conflict"))
    return by_file.groupBy(*TURN).agg(F.max("owned").alias("owned"), (F.max("vote_conflict") | (F.count_distinct("owned") > 1)).alias("vote_conflict"))


def child_turns(f: DataFrame) -> DataFrame:
    """One row a turn of the :func:`timed` facts: start, resolved end, settings, root turn, single model, tools, duration, ownership and flags.

    Of ends at the last instant two statuses are a conflict. Settings, tools and roots count from the start on;
    where a turn never starts all do. A duration counts for complete turns, if the ends at the last instant do not disagree.
    """
    w, since = F.col("what"), F.coalesce(F.col("ns") >= F.col("start_ns"), F.lit(True))
    top = (w == "end") & (F.col("ns") == F.col("end_ns"))
    timing = top & (F.col("status") == "complete")
    early = F.struct("ns", "status")
    setting, tool, usage = w == "setting", (w == "tool") & since, w == "usage"
    model, effort = (F.when(F.col(c) == "", "unknown").otherwise(F.col(c)).alias(c) for c in ("model", "effort"))
    root = F.when((F.col("root_turn_id") != "") & since & (setting | usage & (F.col("thread_id") == F.col("owner"))), F.col("root_turn_id"))
    n = lambda c: F.count_distinct(c)
    g = f.groupBy(*TURN).agg(
        F.first("start_ns").alias("start_ns"), F.first("end_ns").alias("end_ns"),
        n(F.when(top, F.col("status"))).alias("statuses"), F.min(F.when(top, F.col("status"))).alias("end_status"),
        n(F.when((w == "end") & F.coalesce(F.col("ns") < F.col("start_ns"), F.lit(True)), early)).alias("early_ends"),
        F.array_sort(F.collect_set(F.when(setting, F.struct(model, effort)))).alias("settings"),
        n(F.when(setting, F.col("model"))).alias("models"), F.min(F.when(setting, F.col("model"))).alias("some_model"), F.coalesce(F.min(F.when(setting, since & (F.col("model") != ""))), F.lit(False)).alias("clear_models"),
        n(root).alias("roots"), F.min(root).alias("root_turn"), F.count_if(usage).alias("usage_records"), F.count_if(w == "counter").alias("counters"),
        F.coalesce(F.max(w == "ambiguous"), F.lit(False)).alias("ambiguous"), F.coalesce(F.max("forked"), F.lit(False)).alias("in_fork"),
        F.coalesce(F.max(usage & since & (F.col("thread_id") != "") & (F.col("thread_id") != F.col("owner"))), F.lit(False)).alias("foreign_usage"),
        n(F.when(tool & (F.col("call_id") != ""), F.col("call_id"))).alias("tools"), F.coalesce(F.max(tool & (F.col("call_id") == "")), F.lit(False)).alias("more_tools"),
        F.max(F.when(timing, F.col("duration_ms"))).alias("duration"), (n(F.when(timing, F.col("duration_ms"))) > 1).alias("durations_differ"), F.coalesce(F.max(timing & (F.col("bad_duration") | F.coalesce(F.col("duration_ms") < 0, F.lit(False)))), F.lit(False)).alias("duration_wrong"),
    )
    bad = F.col("durations_differ") | F.col("duration_wrong")
    complete = (F.col("statuses") >= 1) & (F.col("end_status") == "complete")
    out = g.join(ownership(f), [*TURN], "left")
    return out.select(
        *TURN, "start_ns", "end_ns", F.coalesce("end_status", F.lit("incomplete")).alias("status"), (F.col("statuses") > 1).alias("terminal_conflict"), "early_ends", "settings",
        F.when(F.col("clear_models") & (F.col("models") == 1), F.col("some_model")).otherwise("unknown").alias("single_model"), F.when(F.col("roots") == 1, F.col("root_turn")).alias("root_turn"),
        "usage_records", "counters", "ambiguous", "in_fork", "foreign_usage", "tools", "more_tools",
        F.when(complete & ~bad, F.col("duration")).alias("duration_ms"), F.coalesce(complete & bad, F.lit(False)).alias("invalid_duration"),
        F.col("owned").isNotNull().alias("owned_seen"), F.coalesce("owned", F.lit(False)).alias("owned"), F.coalesce("vote_conflict", F.lit(False)).alias("vote_conflict"),
    )


def response_owners(used: DataFrame) -> DataFrame:
    """(response_id, owners): how many turns of owners claim each response; one that several claim belongs to none."""
    return used.where("thread_id = owner and response_id <> ''").groupBy("response_id").agg(F.count_distinct("owner", "turn_id").alias("owners"))


def requests(f: DataFrame) -> DataFrame:
    """(owner, turn_id, response_id, parts..., valid, model) of each request of the owner's own thread; copies are one.

    A request is valid if all its records are, do not come before the turn, agree in every part, belong to one turn
    of one owner, and are valid merged. Its model is the one set last at or before it in the turn; ``unknown`` if
    none is, or if two are at one instant or for two of its records.
    """
    since = F.coalesce(F.col("ns") >= F.col("start_ns"), F.lit(True))
    rows = f.where((F.col("what") == "setting") & since | (F.col("what") == "usage") & (F.col("thread_id") == F.col("owner")) & (F.col("response_id") != ""))
    setting = F.col("what") == "setting"
    named = F.when(F.col("model") == "", "unknown").otherwise(F.col("model"))
    here = Window.partitionBy(*TURN, "ns")
    lo, hi = (g(F.when(setting, named)).over(here) for g in (F.min, F.max))
    rows = rows.withColumn("set_model", F.when(setting, F.when(lo == hi, lo).otherwise("unknown")))
    rows = rows.withColumn("model_then", F.max(F.when(setting, F.struct("ns", "set_model"))).over(Window.partitionBy(*TURN).orderBy("ns").rangeBetween(Window.unboundedPreceding, 0))["set_model"])
    used = validated(rows.where("what = 'usage'").select("*", *(F.col(f"usage.{n}").alias(n) for n in USAGE)).drop("usage"))
    used = used.join(response_owners(used).where("owners > 1"), "response_id", "left").withColumn("one_owner", F.col("owners").isNull()).withColumn("model_then", F.coalesce("model_then", F.lit("unknown")))
    agree = F.lit(True)
    for p in USAGE:
        agree = agree & F.coalesce(F.min(p) == F.max(p), F.lit(True))
    one = used.groupBy(*TURN, "response_id").agg(*(F.max(p).alias(p) for p in USAGE), F.min(F.col("valid") & F.coalesce(F.col("ns") >= F.col("start_ns"), F.lit(True)) & F.col("one_owner")).alias("sound"), agree.alias("agree"), F.when(F.count_distinct("model_then") == 1, F.min("model_then")).otherwise("unknown").alias("model"))
    merged = one.withColumn("total_tokens", filled_total())
    return merged.select(*TURN, "response_id", *USAGE, (F.col("sound") & F.col("agree") & is_valid(F.col("total_tokens"))).alias("valid"), "model")


def anonymous_requests(f: DataFrame) -> DataFrame:
    """(owner, turn_id, anonymous): the instants of usage of the owner's thread that names no response."""
    return f.where("what = 'usage' and thread_id = owner and response_id = ''").groupBy(*TURN).agg(F.count_distinct("rec_ts").alias("anonymous"))


def _valid(struct: str) -> tuple[Column, Column]:
    """(filled total, validity) of a struct of counters."""
    total = F.coalesce(F.col(f"{struct}.total_tokens"), F.try_add(F.col(f"{struct}.input_tokens"), F.col(f"{struct}.output_tokens")))
    return total, is_valid(total, struct + ".")


def valid_delta(df: DataFrame, last: str, first: str, name: str) -> DataFrame:
    """``df`` with a struct ``name`` of the differences of two structs of cumulative counters: (parts..., valid). A counter that falls, or is not valid before or after, makes it invalid; a missing part stays missing."""
    (lt, lok), (ft, fok) = _valid(last), _valid(first)
    parts = [p for p in USAGE if p != "total_tokens"]
    lv, fv = {p: F.col(f"{last}.{p}") for p in parts} | {"total_tokens": lt}, {p: F.col(f"{first}.{p}") for p in parts} | {"total_tokens": ft}
    falls = F.lit(False)
    for p in USAGE:
        falls = falls | F.coalesce(lv[p] < fv[p], F.lit(False))
    df = df.withColumn(name, F.struct(*(F.try_subtract(lv[p], fv[p]).alias(p) for p in USAGE))).withColumn("_ok", lok & fok & ~falls)
    total, ok = _valid(name)
    return df.withColumn(name, F.struct(*(F.col(f"{name}.{p}").alias(p) for p in parts), total.alias("total_tokens"), F.coalesce(F.col("_ok") & ok, F.lit(False)).alias("valid"))).drop("_ok")


def estimates(f: DataFrame) -> DataFrame:
    """(owner, turn_id, state, parts...) of each turn with counter snapshots from its start on, or ambiguous ones: what the last snapshot is above the turn's base.

    Snapshots of one instant are one and must agree, all bases must, and no later snapshot may be below an earlier one; else the state is ``invalid``.
    """
    counters = f.where("what = 'counter'")
    ambiguous = f.where("what = 'ambiguous'").select(*TURN).distinct().withColumn("ambiguous", F.lit(True))
    used = valid_delta(counters.where("coalesce(ns >= start_ns, true)"), "usage", "base", "d")
    agree = lambda c: [F.coalesce(F.min(f"{c}.{p}") == F.max(f"{c}.{p}"), F.lit(True)) for p in USAGE]
    every = lambda cs: F.expr("true") if not cs else cs[0] & every(cs[1:])
    at = used.groupBy(*TURN, "ns").agg(F.struct(*(F.max(f"d.{p}").alias(p) for p in USAGE)).alias("d"), (F.min("d.valid") & every(agree("d"))).alias("ok"), *(g(f"base.{p}").alias(f"{n}_{p}") for p in USAGE for n, g in (("lo", F.min), ("hi", F.max))))
    order = Window.partitionBy(*TURN).orderBy("ns")
    at = valid_delta(at.withColumn("before", F.lag("d").over(order)), "d", "before", "step")
    base_ok = every([F.coalesce(F.min(f"lo_{p}") == F.max(f"hi_{p}"), F.lit(True)) for p in USAGE])
    turn = at.groupBy(*TURN).agg(F.min(F.col("ok") & (F.col("before").isNull() | F.col("step.valid"))).alias("ok"), base_ok.alias("base_ok"), F.max_by("d", "ns").alias("d"))
    seen = counters.select(*TURN).distinct()
    out = seen.join(turn, [*TURN], "left").join(ambiguous, [*TURN], "left")
    state = F.when(F.col("ambiguous"), "invalid").when(F.col("ok").isNull(), "missing").when(F.col("ok") & F.col("base_ok"), "valid").otherwise("invalid")
    return out.select(*TURN, state.alias("state"), *(F.when(state == "valid", F.col(f"d.{p}")).alias(f"estimated_{p}") for p in USAGE))


def resources(f: DataFrame, turns: DataFrame) -> DataFrame:
    """``turns`` with what each used, by source.

    source is ``recorded`` if a request is valid, ``estimated`` if no usage is recorded at all and the counters are
    valid, else ``missing``; the two are never added. A sum over 64 bits is null (``overflow``), a part is null if a
    request lacks it. Where both are known they are held against each other: ``mismatch`` or, without valid counters, ``unverifiable``.
    """
    r = requests(f)
    sums = r.groupBy(*TURN).agg(
        F.count_if("valid").alias("valid_requests"), F.count_if(~F.col("valid")).alias("invalid_requests"), F.try_sum(F.when(F.col("valid"), F.col("total_tokens"))).alias("recorded_total_tokens"),
        *(F.when(F.count_if(F.col("valid") & F.col(p).isNull()) == 0, F.try_sum(F.when(F.col("valid"), F.col(p)))).alias(f"recorded_{p}") for p in PARTS),
    )
    out = turns.join(sums, [*TURN], "left").join(estimates(f), [*TURN], "left").join(anonymous_requests(f), [*TURN], "left").fillna(0, ["valid_requests", "invalid_requests", "anonymous"]).fillna("missing", ["state"])
    recorded, estimated = F.col("valid_requests") > 0, (F.col("usage_records") == 0) & (F.col("state") == "valid")
    overflow = recorded & F.col("recorded_total_tokens").isNull()
    different = F.col("recorded_total_tokens") != F.col("estimated_total_tokens")
    for p in PARTS:
        different = different | F.coalesce(F.col(f"recorded_{p}") != F.col(f"estimated_{p}"), F.lit(False))
    check = F.when(recorded, F.when((F.col("state") != "valid") | overflow, "unverifiable").when(different, "mismatch").otherwise("equal"))
    source = F.when(recorded, "recorded").when(estimated, "estimated").otherwise("missing")
    return out.withColumn("source", source).withColumn("overflow", F.coalesce(overflow, F.lit(False))).withColumn("check", check).withColumn("invalid_records", F.col("invalid_requests") + F.col("anonymous"))


def inclusion(turns: DataFrame, agents: DataFrame, since_ns: int | None = None, before_ns: int | None = None) -> DataFrame:
    """``turns`` of agents with ``role``, ``parent_id`` and the reason that keeps each out of the counts: the first of outside, conflict, before_creation, unattributed, ownership_conflict, terminal_conflict; else ``included``."""
    start, fork = F.col("start_ns"), F.col("forked")
    outside = start.isNull()
    if since_ns is not None:
        outside = outside | (start < since_ns)
    if before_ns is not None:
        outside = outside | (start > before_ns)
    reason = F.coalesce(
        F.when(outside, "outside"), F.when(F.col("attribute_conflict"), "conflict"), F.when(start < F.col("created_ns"), "before_creation"),
        F.when(fork & (~F.col("owned_seen") | ~F.col("owned") | F.col("vote_conflict")), "unattributed"), F.when(~fork & F.col("owned_seen") & F.col("vote_conflict"), "ownership_conflict"),
        F.when(F.col("terminal_conflict"), "terminal_conflict"), F.lit("included"),
    )
    own = agents.select("owner", "role", "parent_id", "forked", "attribute_conflict", "created_ns")
    return turns.where("side = 'agent'").join(own, "owner").withColumn("reason", reason)


def usage_rows(f: DataFrame, turns: DataFrame) -> DataFrame:
    """(owner, turn_id, role, model, source, parts...) of everything the ``turns`` (owner, turn_id, role, source, single_model, estimated_...) used: a row a valid request, or one for the estimate."""
    r = requests(f).where("valid").join(turns.select(*TURN, "role"), [*TURN]).select(*TURN, "role", "model", F.lit("recorded").alias("source"), *USAGE)
    e = turns.where("source = 'estimated'").select(*TURN, "role", F.col("single_model").alias("model"), "source", *(F.col(f"estimated_{p}").alias(p) for p in USAGE))
    return r.unionByName(e)


def root_sessions(agents: DataFrame, users: DataFrame) -> DataFrame:
    """(owner, root_session): the user session (id) above each agent. A walk that meets an unknown agent, one in conflict, or itself again reaches none.

    By doubling: each round an agent that has not arrived takes over how far its pointer has come. After as many
    steps as there are agents, whoever still walks is in a cycle or below one.
    """
    up = F.when(F.col("attribute_conflict") | (F.col("parent_id") == ""), None).otherwise(F.col("parent_id"))
    user = users.select(F.col("id").alias("ptr"), F.col("id").alias("root")).distinct()
    links = agents.select(F.col("owner").alias("id"), up.alias("ptr")).where("ptr is not null").join(user, "ptr", "left").select("id", "ptr", "root")
    step, walking = cut_counting(links, "root is null")
    steps, most = 1, walking
    while walking and steps <= 2 * most:
        there = step.select(F.col("id").alias("ptr"), F.col("ptr").alias("next"), F.col("root").alias("there"))
        on = step.where("root is null").join(there, "ptr").select("id", F.col("next").alias("ptr"), F.col("there").alias("root"))
        old = step
        step, walking = cut_counting(step.where("root is not null").unionByName(on), "root is null")
        free(old)
        steps *= 2
    return step.where("root is not null").select(F.col("id").alias("owner"), F.col("root").alias("root_session"))


def stand_in_roots(turns: DataFrame, roots: DataFrame, sessions: DataFrame) -> DataFrame:
    """``turns`` with the first turn id of the root session as root turn of agents' turns, for tables whose records name no root turn of another session."""
    first = roots.join(sessions.where("session is not null").groupBy(F.col("session").alias("root_session")).agg(F.min("turn_id").alias("first")), "root_session").select("owner", "first")
    return turns.join(first, "owner", "left").withColumn("root_turn", F.when(F.col("side") == "agent", F.coalesce("first", "root_turn")).otherwise(F.col("root_turn"))).drop("first")


def turn_sessions(turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """(turn_id, session): the session of each user turn; null where two sessions have the id. ``turns``: (file_path, turn_id), ``sessions``: (file_path, id)."""
    g = turns.join(sessions.select("file_path", F.col("id").alias("session")), "file_path").groupBy(F.coalesce("turn_id", F.lit("")).alias("turn_id"))
    return g.agg(F.when(F.count_distinct("session") == 1, F.min("session")).alias("session"))


def linked(turns: DataFrame, roots: DataFrame, sessions: DataFrame) -> DataFrame:
    """Included or excluded ``turns`` inside the window with ``link``: ``linked`` to their user turn, ``unlinked`` or ``excluded``."""
    rows = turns.where("reason <> 'outside'").join(roots, "owner", "left").join(sessions.select(F.col("turn_id").alias("root_turn"), "session"), "root_turn", "left")
    good = (F.col("reason") == "included") & ~F.col("foreign_usage")
    link = F.when(~good, "excluded").when((F.col("root_turn") != "") & (F.col("root_session") == F.col("session")), "linked").otherwise("unlinked")
    return rows.withColumn("link", link)


METRICS = ("recorded", "estimated", "seconds", "tool_calls")
COUNTS = ("mismatches", "unverifiable", "invalid")


def metrics(turns: DataFrame) -> DataFrame:
    """``turns`` of :func:`resources` with a struct (total, known, missing) a metric and the three counts, as the cohorts add them up."""
    lost = F.col("source") == "missing"
    missing = F.when(lost | (F.col("invalid_records") > 0) | F.col("overflow"), 1).otherwise(0)
    cell = lambda total, known, gone: F.struct(F.coalesce(total.cast("double"), F.lit(0.0)).alias("total"), known.cast("bigint").alias("known"), gone.cast("bigint").alias("missing"))
    is_ = lambda s: F.when((F.col("source") == s) & ~F.col("overflow"), 1).otherwise(0)
    return turns.select(
        "*", cell(F.when(~F.col("overflow"), F.col("recorded_total_tokens")), is_("recorded"), missing).alias("recorded"), cell(F.when(F.col("source") == "estimated", F.col("estimated_total_tokens")), is_("estimated"), missing).alias("estimated"),
        cell(F.col("duration_ms") / 1000, F.col("duration_ms").isNotNull(), F.col("duration_ms").isNull()).alias("seconds"), cell(F.col("tools"), F.lit(1), F.col("more_tools")).alias("tool_calls"),
        F.coalesce(F.col("check") == "mismatch", F.lit(False)).cast("bigint").alias("mismatches"), F.coalesce(F.col("check") == "unverifiable", F.lit(False)).cast("bigint").alias("unverifiable"), (F.col("invalid_records") + (F.col("state") == "invalid").cast("int")).alias("invalid"),
    )


def no_metrics() -> list[Column]:
    """The metrics of a task whose own turn cannot be told: each is missing once."""
    none = F.struct(F.lit(0.0).alias("total"), F.lit(0).cast("bigint").alias("known"), F.lit(1).cast("bigint").alias("missing"))
    return [*(none.alias(m) for m in METRICS), *(F.lit(0).cast("bigint").alias(c) for c in COUNTS)]


def summed(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with metrics added up by ``keys``; ``tasks`` of a metric counts the rows that know it."""
    cell = lambda m: F.struct(F.sum(f"{m}.total").alias("total"), F.sum(f"{m}.known").alias("known"), F.sum(f"{m}.missing").alias("missing"), F.count_if(F.col(f"{m}.known") > 0).alias("tasks")).alias(m)
    return rows.groupBy(*keys).agg(*(cell(m) for m in METRICS), *(F.sum(c).alias(c) for c in COUNTS))


def parent_metrics(tasks: DataFrame, turns: DataFrame) -> DataFrame:
    """(task, metrics): what the user turn of each of ``tasks`` (turn_id, session) used itself; missing where its facts are in conflict, of another thread or unowned. ``turns`` are those of user sessions with their :func:`metrics`."""
    ok = turns.where("not terminal_conflict and not vote_conflict and not foreign_usage and (not owned_seen or owned) and (not in_fork or owned_seen)")
    own = ok.where("side = 'user'").select(F.col("owner").alias("session"), "turn_id", *METRICS, *COUNTS)
    none = dict(zip((*METRICS, *COUNTS), no_metrics()))
    return tasks.join(own, ["session", "turn_id"], "left").select(F.col("turn_id").alias("task"), *(F.coalesce(F.col(c), none[c]).alias(c) for c in none))


def profiles(links: DataFrame, used: DataFrame) -> DataFrame:
    """(task, dimension, name, metrics): the roles and models that worked for each task, each once with all it used; ``unknown`` ones are left out.

    ``links`` are linked turns with their metrics, ``used`` their :func:`usage_rows`. A model has its own tokens; seconds and tools only if it is the turn's only one.
    """
    per = lambda dim, name, df: df.select(F.col("root_turn").alias("task"), F.lit(dim).alias("dimension"), name.alias("name"), *METRICS, *COUNTS)
    roles = per("role", F.col("role"), links)
    by_model = used.groupBy(*TURN, "model").agg(*(F.try_sum(F.when(F.col("source") == s, F.col("total_tokens"))).alias(f"{s}_sum") for s in ("recorded", "estimated")), *(F.count_if(F.col("source") == s).alias(f"{s}_n") for s in ("recorded", "estimated")))
    rows = links.join(by_model, [*TURN])
    known = lambda s: F.struct(F.coalesce(F.col(f"{s}_sum").cast("double"), F.lit(0.0)).alias("total"), ((F.col(f"{s}_n") > 0) & F.col(f"{s}_sum").isNotNull()).cast("bigint").alias("known"), F.col(f"{s}.missing").alias("missing"))
    gone = F.struct(F.lit(0.0).alias("total"), F.lit(0).cast("bigint").alias("known"), F.lit(1).cast("bigint").alias("missing"))
    only = F.col("model") == F.col("single_model")
    zero = F.lit(0).cast("bigint")
    models = rows.select("root_turn", "model", known("recorded").alias("recorded"), known("estimated").alias("estimated"), *(F.when(only, F.col(m)).otherwise(gone).alias(m) for m in ("seconds", "tool_calls")), *(zero.alias(c) for c in COUNTS))
    alone = links.where("single_model <> 'unknown'").join(by_model.select(*TURN, F.col("model").alias("single_model")), [*TURN, "single_model"], "left_anti")
    whole = roles.unionByName(per("model", F.col("model"), models)).unionByName(per("model", F.col("single_model"), alone))
    return summed(whole.where("name <> '' and name <> 'unknown'"), "task", "dimension", "name")

