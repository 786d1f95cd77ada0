"""Rebuilding conversations from message rows by overlap assembly.

Rows arrive in export fragments: the rows of one session that arrived on one day. Messages are known by a hash of
session, role, text and instant, and the copies of a message are one. :func:`assemble` finds suffix-prefix matches:
where the last messages of a fragment are the first of another one, the two overlap, and a chain of overlaps
without a fork is merged into one contig. :func:`layout` lays the contigs of a session on its timeline. Contigs
whose spans meet, as of late rows, are merged by instant into one scaffold; scaffolds follow one another.
:func:`conversations` numbers the messages along the scaffolds and drops conversations with gaps.

Positions come from counts within an hour of a scaffold and prefix sums over scaffolds and hours, so that a session
with a third of all messages is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions.timestamps import instant_ns
from strandline.session import cut, cut_counting

#: Spellings of the four roles (fixed values).
ROLES = {
    "user": ["user", "human", "customer", "client", "end_user", "enduser"],
    "assistant": ["assistant", "agent", "model", "ai", "bot", "llm"],
    "system": ["system", "developer", "sys"],
    "tool": ["tool", "function", "tool_result", "tool_output", "function_call_output", "tool_call"],
}
BLANK = r"(?U)^[\s\p{Cf}\p{Cc}\p{Z}]*$"
HOUR_NS = 3_600_000_000_000
#: The fragment of rows without a day of arrival.
NO_DAY = "0001-01-01"


def clean_role(c: Column) -> Column:
    """user, assistant, system or tool; null where the spelling is none of them."""
    t = F.lower(F.regexp_replace(c, r"(?U)^[\s\p{Z}\p{Cf}:<|\[\]>]+|[\s\p{Z}\p{Cf}:<|\[\]>]+$", ""))
    out = F.when(t.isin(ROLES["user"]), "user")
    for role in ("assistant", "system", "tool"):
        out = out.when(t.isin(ROLES[role]), role)
    return out


def clean_messages(messages: DataFrame) -> DataFrame:
    """(session_id, message_id, turn_id, role, ns, fragment, h) without blank messages and rows without a session. ``h`` identifies equal messages of a session."""
    role, ns = clean_role(F.col("role")), instant_ns(F.col("msg_ts"))
    rows = messages.where(F.col("session_id").isNotNull() & F.col("message").isNotNull() & ~F.col("message").rlike(BLANK))
    rows = rows.select("session_id", "message_id", F.when(~F.col("turn_id").rlike(BLANK), F.trim("turn_id")).alias("turn_id"), role.alias("role"), ns.alias("ns"), F.coalesce(F.to_date("ingested_at"), F.lit(NO_DAY).cast("date")).alias("fragment"), "message")
    return rows.withColumn("h", F.unhex(F.sha2(F.concat_ws("\x00", F.coalesce("role", F.lit("?")), F.coalesce(F.col("ns").cast("string"), F.lit("?")), "message"), 256))).drop("message")


def merge_copies(rows: DataFrame) -> DataFrame:
    """(session_id, message_id, turn_id, role, ns, hour, fragments): one row a message, with the smallest id and turn of its copies and the fragments that hold it."""
    one = rows.groupBy("session_id", "h").agg(F.min("message_id").alias("message_id"), F.min("turn_id").alias("turn_id"), F.first("role").alias("role"), F.first("ns").alias("ns"), F.array_sort(F.collect_set("fragment")).alias("fragments"))
    return one.drop("h").withColumn("hour", F.floor(F.col("ns") / HOUR_NS))


def _ranked(held: DataFrame) -> DataFrame:
    """``held`` with the rank of each message in its fragment and the fragment's size, from counts within an hour and prefix sums over hours."""
    own = Window.partitionBy("session_id", "fragment")
    hours = held.groupBy("session_id", "fragment", "hour").agg(F.count("*").alias("n"))
    hours = hours.select("session_id", "fragment", "hour", F.coalesce(F.sum("n").over(own.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("n").over(own).alias("size"))
    inside = F.row_number().over(Window.partitionBy("session_id", "fragment", "hour").orderBy("ns", "message_id"))
    return held.withColumn("rank", inside).join(hours, ["session_id", "fragment", "hour"]).select("session_id", "fragment", "message_id", (F.col("base") + F.col("rank")).alias("rank"), "size")


def _overlaps(one: DataFrame) -> DataFrame:
    """(session_id, fragment, b, k): the last k messages of the fragment are the first k of fragment b. Of two equal fragments the earlier one comes first."""
    held = one.select("session_id", "message_id", "ns", "hour", F.size("fragments").alias("copies"), F.explode("fragments").alias("fragment"))
    shared = held.where("copies > 1").select("session_id", "message_id", "fragment")
    placed = cut(_ranked(held.join(shared.select("session_id", "fragment").distinct(), ["session_id", "fragment"], "left_semi")).join(shared, ["session_id", "message_id", "fragment"], "left_semi"))
    other = placed.select("session_id", "message_id", F.col("fragment").alias("b"), F.col("rank").alias("brank"), F.col("size").alias("bsize"))
    pairs = placed.join(other, ["session_id", "message_id"]).where("fragment <> b")
    runs = pairs.groupBy("session_id", "fragment", "b").agg(F.count("*").alias("k"), F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.max("size").alias("size"), F.min("brank").alias("blo"), F.max("brank").alias("bhi"), F.max("bsize").alias("bsize"))
    return runs.where("hi = size and blo = 1 and bhi = k and hi - lo + 1 = k and (fragment < b or k < size or k < bsize)").select("session_id", "fragment", "b", "k")


def assemble(one: DataFrame) -> DataFrame:
    """(session_id, fragment, contig, overlap) of the fragments that overlap others: the first fragment of the contig each is merged into.

    A fragment is linked to the follower with the longest overlap if it is the predecessor with the longest
    overlap of that. Of equal overlaps the shorter follower and predecessor count, which lie between, then
    the earlier one. Other followers must follow from this one, and other predecessors precede the
    predecessor; else the chain forks and the link does not count.
    ``overlap`` is the number of messages shared with the predecessor.
    """
    edges = cut(_overlaps(one))
    sizes = one.select("session_id", F.explode("fragments").alias("fragment")).join(edges.select("session_id", "fragment").unionByName(edges.select("session_id", F.col("b").alias("fragment"))).distinct(), ["session_id", "fragment"], "left_semi")
    sizes = cut(sizes.groupBy("session_id", "fragment").agg(F.count("*").alias("size")))
    sized = edges.join(sizes.withColumnRenamed("size", "asize"), ["session_id", "fragment"]).join(sizes.select("session_id", F.col("fragment").alias("b"), F.col("size").alias("bsize")), ["session_id", "b"])
    day = lambda c: F.datediff(F.col(c), F.lit(NO_DAY).cast("date"))
    nearest = sized.withColumn("next", F.first("b").over(Window.partitionBy("session_id", "fragment").orderBy(F.desc("k"), "bsize", day("b")))).withColumn("last", F.first("fragment").over(Window.partitionBy("session_id", "b").orderBy(F.desc("k"), "asize", F.desc(day("fragment")))))
    known = edges.select("session_id", F.col("fragment").alias("x"), F.col("b").alias("y"), F.lit(True).alias("known"))
    checked = nearest.join(known.withColumnsRenamed({"x": "next", "y": "b", "known": "follows"}), ["session_id", "next", "b"], "left").join(known.withColumnsRenamed({"x": "fragment", "y": "last", "known": "precedes"}), ["session_id", "fragment", "last"], "left")
    checked = checked.withColumn("one_out", F.min((F.col("b") == F.col("next")) | F.coalesce("follows", F.lit(False))).over(Window.partitionBy("session_id", "fragment")))
    checked = checked.withColumn("one_in", F.min((F.col("fragment") == F.col("last")) | F.coalesce("precedes", F.lit(False))).over(Window.partitionBy("session_id", "b")))
    links = checked.where("b = next and fragment = last and one_out and one_in").select("session_id", F.col("b").alias("fragment"), F.col("fragment").alias("ptr"), F.col("k").alias("overlap"))
    step, moved = cut_counting(sizes.join(links, ["session_id", "fragment"], "left").select("session_id", "fragment", F.coalesce("ptr", "fragment").alias("ptr"), F.coalesce("overlap", F.lit(0)).alias("overlap")), "ptr <> fragment")
    while moved:
        there = step.select("session_id", F.col("fragment").alias("ptr"), F.col("ptr").alias("next"))
        more, moved = cut_counting(step.join(there, ["session_id", "ptr"]).select("session_id", "fragment", F.col("next").alias("ptr"), "overlap", (F.col("next") != F.col("ptr")).alias("moved")), "moved")
        step = more.drop("moved")
    return step.withColumnRenamed("ptr", "contig")


def _readable(one: DataFrame) -> DataFrame:
    return one.where("ns is not null and role is not null")


def _placed(one: DataFrame) -> DataFrame:
    """(session_id, fragment, lo, hi, contig, overlap): all fragments with their first and last instants and their contigs; one that overlaps none is a contig by itself."""
    spans = one.select("session_id", "ns", F.explode("fragments").alias("fragment")).groupBy("session_id", "fragment").agg(F.min("ns").alias("lo"), F.max("ns").alias("hi"))
    return spans.join(assemble(one), ["session_id", "fragment"], "left").select("session_id", "fragment", "lo", "hi", F.coalesce("contig", "fragment").alias("contig"), F.coalesce("overlap", F.lit(0)).alias("overlap"))


def contigs(rows: DataFrame) -> DataFrame:
    """(session_id, fragment, contig, overlap): the fragments of each session and the first fragment of the contig each is merged into."""
    return _placed(_readable(cut(merge_copies(rows)))).select("session_id", "fragment", "contig", "overlap")


def layout(one: DataFrame) -> DataFrame:
    """(session_id, fragment, contig, scaffold): where the contig of each fragment lies. Scaffolds are numbered along the timeline of the session; contigs whose spans meet share one, so all copies of a message are in one."""
    placed = cut(_placed(one))
    spans = placed.groupBy("session_id", "contig").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    along = Window.partitionBy("session_id").orderBy("lo", "contig")
    spans = spans.withColumn("apart", F.coalesce((F.col("lo") > F.max("hi").over(along.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(0)))
    spans = spans.select("session_id", "contig", F.sum("apart").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("scaffold"))
    return cut(placed.join(spans, ["session_id", "contig"]).select("session_id", "fragment", "contig", "scaffold"))


def conversations(messages: DataFrame) -> DataFrame:
    """(session_id, pos, message_id, role, turn_id, fragments, contig): the messages of the conversations that have no gap, in the order of their contigs, merged by instant where these meet.

    Equal instants are ordered by message_id. A conversation is dropped if it has no user or assistant message,
    does not begin with the user among these, has a user message without a reply before the next one or the
    end, has an assistant message whose turn_id no user message has, or a message without readable instant or
    role. A null or blank turn_id names no turn. Empty input gives no rows.
    """
    rows = clean_messages(messages)
    one = cut(merge_copies(rows))
    asked = one.where("role = 'user' and turn_id is not null").select("session_id", "turn_id").distinct()
    strange = one.where("role = 'assistant' and turn_id is not null").select("session_id", "turn_id").distinct().join(asked, ["session_id", "turn_id"], "left_anti").select("session_id").distinct()
    unread = one.where("ns is null or role is null").select("session_id").distinct()
    inside = Window.partitionBy("session_id", "scaffold", "hour").orderBy("ns", "message_id")
    laid = _readable(one).withColumn("fragment", F.element_at("fragments", 1)).join(layout(_readable(one)), ["session_id", "fragment"])
    numbered = laid.withColumn("rank", F.row_number().over(inside))
    spoken = numbered.where("role in ('user', 'assistant')").withColumn("next", F.lead("role").over(inside))
    speech = spoken.groupBy("session_id", "scaffold", "hour").agg(F.min_by("role", "rank").alias("first"), F.max_by("role", "rank").alias("last"), F.max((F.col("role") == "user") & (F.col("next") == "user")).alias("twice"))
    hours = numbered.groupBy("session_id", "scaffold", "hour").agg(F.count("*").alias("n")).join(speech, ["session_id", "scaffold", "hour"], "left")
    whole = Window.partitionBy("session_id")
    earlier = whole.orderBy("scaffold", "hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("prev", F.last("last", ignorenulls=True).over(earlier))
    gap = F.coalesce(F.col("twice"), F.lit(False)) | F.coalesce((F.col("prev") == "user") & (F.col("first") == "user"), F.lit(False)) | F.coalesce(F.col("prev").isNull() & (F.col("first") == "assistant"), F.lit(False))
    verdict = hours.withColumn("gap", F.max(gap).over(whole)).withColumn("end", F.max(F.when(F.col("last").isNotNull(), F.struct("scaffold", "hour", "last"))).over(whole))
    kept = verdict.where(~F.col("gap") & (F.col("end.last") == "assistant")).join(strange.unionByName(unread).distinct(), "session_id", "left_anti").select("session_id", "scaffold", "hour", "base")
    return numbered.join(kept, ["session_id", "scaffold", "hour"]).select("session_id", (F.col("base") + F.col("rank")).cast("int").alias("pos"), "message_id", "role", "turn_id", "fragments", "contig")
