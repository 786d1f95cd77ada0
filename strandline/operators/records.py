"""Envelope and payload decoding of agent-session records into one typed frame.

One row a record: file, order in the file, instant, record type and the payload fields that any operator
needs. Records whose payload is malformed or no object keep null fields and ``readable`` false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.timestamps import instant_ns

USAGE = ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens")
SPAWN = r"(^|[./:]|__)spawn_agent$"


def _kind(v: Column, path: str) -> Column:
    """The JSON type at ``path``: STRING, BIGINT (an integer of 64 bits without fraction or exponent), OBJECT<..., ARRAY<...; VOID for null and for nothing."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("VOID"))


def _all_of(v: Column, kinds: str, *paths: str) -> Column:
    """True if each path holds one of ``kinds``, null or nothing."""
    out = F.lit(True)
    for p in paths:
        out = out & _kind(v, f"$.{p}").rlike(f"^({kinds}|VOID)")
    return out


def integer(v: Column, path: str) -> Column:
    """The integer at ``path`` as bigint; null where another JSON type stands there or 64 bits do not hold it."""
    return F.when(_kind(v, path) == "BIGINT", F.try_variant_get(v, path, "bigint"))


def _sound_parts(v: Column, path: str) -> Column:
    """True unless the content at ``path`` is no array, or a part of it, its type or its text has another JSON type."""
    parts = F.try_variant_get(v, path, "array<variant>")
    is_a = lambda x, *names: F.coalesce(F.schema_of_variant(x), F.lit("VOID")).rlike(f"^({'|'.join(names)})")
    field = lambda x, name: F.try_variant_get(x, f"$.{name}", "variant")
    sound = F.forall(parts, lambda x: is_a(x, "VOID") | is_a(x, "OBJECT") & is_a(field(x, "type"), "STRING", "VOID") & is_a(field(x, "text"), "STRING", "VOID"))
    return _kind(v, path).rlike("^(ARRAY|VOID)") & F.coalesce(sound, F.lit(True))


def content_texts(v: Column, path: str, kind: str) -> Column:
    """The non-empty texts of the parts of one type in the content array at ``path``, in order."""
    parts = F.try_variant_get(v, path, "array<variant>")
    texts = F.transform(F.filter(parts, lambda x: F.try_variant_get(x, "$.type", "string") == kind), lambda x: F.try_variant_get(x, "$.text", "string"))
    return F.filter(texts, lambda t: t != "")


def usage_struct(v: Column, path: str) -> Column:
    """The five counters at ``path`` as a struct; all null if one of them is no integer."""
    ok = _kind(v, f"$.{path}").startswith("OBJECT") & _all_of(v, "BIGINT", *(f"{path}.{n}" for n in USAGE))
    return F.struct(*(F.when(ok, F.try_variant_get(v, f"$.{path}.{n}", "bigint")).alias(n) for n in USAGE))


META = "internal_chat_message_metadata_passthrough"


def decode(records: DataFrame) -> DataFrame:
    """``records``: (record_id, file_path, line_no, rec_ts, rec_type, payload). The payload is parsed once, into a variant.

    A reader that expects a field of one JSON type does not read a record in which it has another: ``turn_ok``,
    ``inter_ok`` and ``child_ok`` say whether the readers of turns, interactions and child turns take the record.
    """
    v = F.col("v")
    text = lambda path: F.try_variant_get("v", f"$.{path}", "string")
    rows = records.withColumn("v", F.try_parse_json(F.col("payload")))
    rows = rows.withColumn("readable", F.coalesce(F.col("v").isNotNull() & F.ltrim("payload").startswith("{"), F.lit(False))).withColumn("v", F.when(F.col("readable"), v))
    fields = {n: text(n) for n in ("turn_id", "root_turn_id", "model", "effort", "name", "tool_name", "call_id", "role", "message", "thread_id", "response_id", "last_agent_message")}
    event, context, response, usage = (F.col("rec_type") == x for x in ("event_msg", "turn_context", "response_item", "token_usage_record"))
    counter = "info.total_token_usage"
    turn_ok = F.when(event, _all_of(v, "STRING", "type", "turn_id") & _all_of(v, "BIGINT", "duration_ms", "time_to_first_token_ms", f"{counter}.total_tokens") & _all_of(v, "OBJECT", "info", counter)).when(context, _all_of(v, "STRING", "turn_id", "model", "effort")).when(response, _all_of(v, "STRING", "type", "name", "tool_name")).otherwise(False)
    kinds = _all_of(v, "ARRAY<STRING>|ARRAY<VOID>", f"{META}.content_item_kinds")
    inter_ok = F.when(event, _all_of(v, "STRING", "type", "turn_id", "message", "last_agent_message", "item.type") & _all_of(v, "OBJECT", "item") & _sound_parts(v, "$.item.content")).when(response, _all_of(v, "STRING", "type", "role", f"{META}.turn_id") & _all_of(v, "OBJECT", META) & kinds & _sound_parts(v, "$.content")).otherwise(False)
    child_ok = F.when(event, _all_of(v, "STRING", "type", "turn_id")).when(context, _all_of(v, "STRING", "turn_id", "model", "effort", "root_turn_id")).when(usage, _all_of(v, "STRING", "thread_id", "turn_id", "response_id", "root_turn_id")).when(response, _all_of(v, "STRING", "type", "call_id")).otherwise(F.col("rec_type") == "compacted")
    said = F.array_join(content_texts(v, "$.content", "input_text"), "")
    item_kinds = F.try_variant_get("v", f"$.{META}.content_item_kinds", "array<string>")
    out = rows.select(
        "file_path", "line_no", "record_id", "readable", "rec_ts", instant_ns(F.col("rec_ts")).alias("ns"), F.col("rec_type"), text("type").alias("kind"),
        *(c.alias(n) for n, c in fields.items()), *(integer(v, f"$.{n}").alias(n) for n in ("duration_ms", "time_to_first_token_ms")),
        (~_kind(v, "$.duration_ms").isin("BIGINT", "VOID")).alias("bad_duration"), usage_struct(v, "usage").alias("usage"), usage_struct(v, counter).alias("count"),
        text(counter).isNotNull().alias("has_count"), text("info").isNotNull().alias("has_info"),
        *(F.coalesce(c & F.col("readable"), F.lit(False)).alias(n) for n, c in (("turn_ok", turn_ok), ("inter_ok", inter_ok), ("child_ok", child_ok))),
        F.when(text("item.type") == "UserMessage", F.get(content_texts(v, "$.item.content", "text"), F.lit(0))).alias("completed_text"),
        F.when((text("role") == "user") & F.array_contains(item_kinds, "user.text") & (said != ""), said).alias("input_text"), text(f"{META}.turn_id").alias("input_turn_id"),
    )
    return out.select("*", *(F.col(f"usage.{n}").alias(n) for n in USAGE), F.col("count.total_tokens").alias("counter"))


def as_of(records: DataFrame, before_ns: int, strict: bool = False) -> DataFrame:
    """Records up to an instant. Those without a readable instant pass, unless ``strict``."""
    return records.where((F.lit(False) if strict else F.col("ns").isNull()) | (F.col("ns") <= before_ns))


def in_window(rows: DataFrame, since_ns: int, before_ns: int, column: str = "ns") -> DataFrame:
    """Rows that start inside a window, both ends included; rows without a readable instant are outside."""
    return rows.where(F.col(column).between(since_ns, before_ns))


def is_tool_call() -> Column:
    return (F.col("rec_type") == "response_item") & F.col("kind").isin("function_call", "custom_tool_call")


def is_spawn() -> Column:
    named = lambda c: F.coalesce(F.regexp_replace(c, r"(?U)^\s+|\s+$", "").rlike(SPAWN), F.lit(False))
    return named("name") | named("tool_name")


def marked_files(records: DataFrame, marker: str) -> DataFrame:
    """(file_path) of the files in which a user message, as event or as response item, contains ``marker``. Raw records go in; only those that hold the marker are parsed."""
    rows = records.where(F.col("payload").contains(marker)).withColumn("v", F.try_parse_json("payload")).where(F.ltrim("payload").startswith("{"))
    v, text = F.col("v"), lambda path: F.try_variant_get("v", f"$.{path}", "string")
    event = (F.col("rec_type") == "event_msg") & _all_of(v, "STRING", "type", "message") & (text("type") == "user_message") & text("message").contains(marker)
    texts = F.transform(F.try_variant_get("v", "$.content", "array<variant>"), lambda x: F.try_variant_get(x, "$.text", "string"))
    response = (F.col("rec_type") == "response_item") & _all_of(v, "STRING", "type", "role") & _sound_parts(v, "$.content") & (text("type") == "message") & (text("role") == "user") & F.exists(texts, lambda t: F.coalesce(t.contains(marker), F.lit(False)))
    return rows.where(F.coalesce(event, F.lit(False)) | F.coalesce(response, F.lit(False))).select("file_path").distinct()


def without_marked_files(records: DataFrame, marker: str) -> DataFrame:
    """Records of the files that :func:`marked_files` does not name."""
    return records.join(marked_files(records, marker), "file_path", "left_anti")


def _metas(records: DataFrame) -> DataFrame:
    """The first session_meta of each file as (file_path, started_at, v, sound). ``v`` is null for payloads that are no object; ``sound`` is false if a field of it has another JSON type, as then the reader gives up the file."""
    first = records.where("rec_type = 'session_meta'").groupBy("file_path").agg(F.min_by(F.struct("rec_ts", "payload"), F.struct("line_no", "record_id")).alias("m"))
    rows = first.select("file_path", F.col("m.rec_ts").alias("started_at"), F.when(F.ltrim("m.payload").startswith("{"), F.try_parse_json("m.payload")).alias("v"))
    return rows.withColumn("sound", F.col("v").isNotNull() & _all_of(F.col("v"), "STRING", "id", "originator", "thread_source", "forked_from_id"))


def first_meta(records: DataFrame) -> DataFrame:
    """The first session_meta of each file where it is readable: (file_path, id, originator, thread_source, forked_from_id, started_at). Raw records go in."""
    return _metas(records).where("sound").select("file_path", *(F.try_variant_get("v", f"$.{n}", "string").alias(n) for n in ("id", "originator", "thread_source", "forked_from_id")), "started_at")


def child_meta(records: DataFrame) -> DataFrame:
    """(file_path, id, parent_id, role, depth, has_depth, started_at, forked_from_id, originator) of the files of spawned agents. A spawn that names another id than the session's is none; empty texts stand for absent ones."""
    s, v = "source.subagent.thread_spawn", F.col("v")
    text = lambda path: F.coalesce(F.try_variant_get("v", f"$.{path}", "string"), F.lit(""))
    ok = _all_of(v, "STRING", f"{s}.id", f"{s}.parent_thread_id", f"{s}.agent_role") & _all_of(v, "BIGINT", f"{s}.depth") & _all_of(v, "OBJECT", "source", "source.subagent") & _kind(v, f"$.{s}").startswith("OBJECT")
    same = (text(f"{s}.id") == "") | (text("id") == "") | (text(f"{s}.id") == text("id"))
    rows = _metas(records).where("sound").where((text("thread_source") == "subagent") & ok & same)
    depth = integer(v, f"$.{s}.depth")
    return rows.select("file_path", text("id").alias("id"), text(f"{s}.parent_thread_id").alias("parent_id"), text(f"{s}.agent_role").alias("role"), F.coalesce(depth, F.lit(0)).alias("depth"), depth.isNotNull().alias("has_depth"), F.coalesce("started_at", F.lit("")).alias("started_at"), text("forked_from_id").alias("forked_from_id"), text("originator").alias("originator"))
