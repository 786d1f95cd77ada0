"""Cohort statistics over labelled turns.

An observation is (turn_id, task_type, steering, tokens, seconds, tools, model, effort, uses); means clamp
negative tokens to 0. Comparisons need LEAST observations on each side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.operators.children import COUNTS, METRICS

LEAST = 10


def _stats() -> list[Column]:
    mean = lambda c: F.round(F.avg(c), 6)
    return [F.count("*").alias("samples"), F.count_if("steering").alias("steering_n"), F.round(F.count_if("steering") / F.count("*"), 6).alias("steering_rate"), mean(F.greatest("tokens", F.lit(0))).alias("mean_tokens"), mean("seconds").alias("mean_seconds"), mean("tools").alias("mean_tools")]


def observations(turns: DataFrame, labels: DataFrame, agent_turns: DataFrame | None = None) -> DataFrame:
    """Complete turns with an id and a follow-up label (inner) and a task type (``unknown`` if none); of repeated turn ids the first counts.

    A turn uses agents if it spawns one, or if ``agent_turns`` (task, ...) links working turns to it.
    """
    first = Window.partitionBy("turn_id").orderBy("file_path", "turn_seq")
    one = turns.where("status = 'complete' and turn_id <> ''").withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")
    own = one.join(labels.groupBy("turn_id").agg(F.max("task_type").alias("task_type"), F.max("followup_label").alias("followup_label")), "turn_id")
    own = own.where("followup_label is not null")
    if agent_turns is not None:
        own = own.join(agent_turns.select(F.col("task").alias("turn_id"), F.lit(True).alias("worked")).distinct(), "turn_id", "left").withColumn("uses_subagents", F.col("uses_subagents") | F.coalesce("worked", F.lit(False)))
    kind = F.coalesce(F.nullif("task_type", F.lit("")), F.lit("unknown"))
    return own.select("turn_id", kind.alias("task_type"), (F.col("followup_label") == "steering").alias("steering"), "tokens", (F.col("duration_ms") / 1000).alias("seconds"), F.col("tool_calls").alias("tools"), "model", "effort", F.col("uses_subagents").alias("uses"))


def overall(obs: DataFrame) -> DataFrame:
    return obs.agg(*_stats())


def by_type(obs: DataFrame) -> DataFrame:
    return obs.groupBy("task_type").agg(*_stats()).orderBy(F.desc("steering_rate"), "task_type")


def model_comparisons(obs: DataFrame, least: int = LEAST) -> DataFrame:
    """Groups of (type, model, effort) that are large enough, for types that have two of them."""
    g = obs.groupBy("task_type", "model", "effort").agg(*_stats()).where(F.col("samples") >= least)
    return g.withColumn("k", F.count("*").over(Window.partitionBy("task_type"))).where("k >= 2").drop("k").orderBy("task_type", "model", "effort")


def with_and_without(obs: DataFrame, *keys: str, least: int = LEAST) -> DataFrame:
    """Both sides of agent use, overall or by ``keys``, where both are large enough."""
    g = obs.groupBy(*keys, "uses").agg(*_stats())
    w = Window.partitionBy(*keys)
    return g.withColumn("k", F.count("*").over(w)).withColumn("low", F.min("samples").over(w)).where((F.col("k") == 2) & (F.col("low") >= least)).drop("k", "low").orderBy(*keys, "uses")


def with_evidence(obs: DataFrame, parents: DataFrame, agents: DataFrame) -> DataFrame:
    """``obs`` with the metrics of the turn itself (``parent``) and of the agents that worked for it (``agents``); both come by task with the columns of :func:`children.metrics`."""
    names = (*METRICS, *COUNTS)
    side = lambda df, n: df.select(F.col("task").alias("turn_id"), F.struct(*names).alias(n))
    return obs.join(side(parents, "parent"), "turn_id", "left").join(side(agents, "agents"), "turn_id", "left")


def _resources() -> list[Column]:
    """Sums of the metrics of both sides: total, known and missing turns, and the tasks that know the metric."""
    out = []
    for s in ("parent", "agents"):
        for m in METRICS:
            at = f"{s}.{m}"
            total = lambda c: F.coalesce(F.sum(f"{at}.{c}"), F.lit(0))  # noqa: B023, E731
            out += [F.round(total("total"), 3).alias(f"{s}_{m}"), F.count_if(F.col(f"{at}.known") > 0).alias(f"{s}_{m}_tasks"), total("known").alias(f"{s}_{m}_known"), total("missing").alias(f"{s}_{m}_missing")]
        out += [F.coalesce(F.sum(f"{s}.{c}"), F.lit(0)).alias(f"{s}_{c}") for c in COUNTS]
    return out


def _both_sides(rows: DataFrame, *keys: str) -> DataFrame:
    skeleton = rows.select(*keys).distinct().withColumn("uses", F.explode(F.array(F.lit(False), F.lit(True))))
    g = rows.groupBy(*keys, "uses").agg(F.count("*").alias("samples"), F.count_if("steering").alias("steering_n"), *_resources())
    return skeleton.join(g, [*keys, "uses"], "left").fillna(0)


def cohorts(obs: DataFrame) -> DataFrame:
    """Each observation with evidence in the cohort of all types ('') and of its own, by agent use; empty sides come out with 0 samples."""
    both = obs.withColumn("cohort", F.explode(F.array(F.lit(""), F.col("task_type"))))
    return _both_sides(both, "cohort").orderBy("cohort", F.desc("uses"))


def routing_cohorts(obs: DataFrame) -> DataFrame:
    """(type, "model / effort") by agent use, without unknown models or efforts; both sides are there."""
    known = obs.where("model <> 'unknown' and effort <> 'unknown'").withColumn("route", F.concat_ws(" / ", "model", "effort"))
    return _both_sides(known, "task_type", "route")


def profile_cohorts(obs: DataFrame, profiles: DataFrame) -> DataFrame:
    """(type, dimension, name): the observations a role or model worked for, each once, with what it used for them. ``profiles``: (task, dimension, name, metrics)."""
    rows = obs.drop("agents").join(profiles.select(F.col("task").alias("turn_id"), "dimension", "name", F.struct(*METRICS, *COUNTS).alias("agents")), "turn_id")
    return rows.groupBy("task_type", "dimension", "name").agg(F.count("*").alias("samples"), F.count_if("steering").alias("steering_n"), *_resources())


def as_cohorts(groups: DataFrame, routes: DataFrame, profiles: DataFrame) -> DataFrame:
    """The three kinds of cohorts as (task_type, dimension, name, uses, samples)."""
    a = groups.select(F.col("cohort").alias("task_type"), F.lit("").alias("dimension"), F.lit("").alias("name"), "uses", "samples")
    b = routes.select("task_type", F.lit("routing").alias("dimension"), F.col("route").alias("name"), "uses", "samples")
    return a.unionByName(b).unionByName(profiles.select("task_type", "dimension", "name", F.lit(True).alias("uses"), "samples"))


def coverage_mean(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """Mean over the tasks whose value is known; known and missing are counted. Null without any."""
    return rows.groupBy(*keys).agg(F.count(value).alias("known"), F.count_if(F.col(value).isNull()).alias("missing"), F.coalesce(F.sum(value), F.lit(0)).alias("total"), F.round(F.sum(value) / F.count(value), 6).alias("mean"))


def cost(of: str = "") -> Column:
    """One number for tokens, seconds and tool calls."""
    c = lambda n: F.col(of + n)
    return c("mean_tokens") + 100 * c("mean_seconds") + 1000 * c("mean_tools")


def routing_hypothesis(obs: DataFrame, least: int = LEAST) -> DataFrame:
    """The first pair of efforts of one type and model, in the order of type, model and both efforts, of which the cheaper one is at most as dear in every mean, cheaper in one, and steers no more."""
    g = obs.groupBy("task_type", "model", "effort").agg(*_stats()).where(F.col("samples") >= least)
    on = (F.col("a.task_type") == F.col("b.task_type")) & (F.col("a.model") == F.col("b.model")) & (F.col("a.effort") < F.col("b.effort"))
    pairs = g.alias("a").join(g.alias("b"), on)
    right = cost("b.") < cost("a.")
    low, high = (F.when(right if k else ~right, F.struct("b.*")).otherwise(F.struct("a.*")) for k in (True, False))
    pairs = pairs.select("a.task_type", "a.model", F.col("a.effort").alias("e1"), F.col("b.effort").alias("e2"), low.alias("low"), high.alias("high"))
    means = ("mean_tokens", "mean_seconds", "mean_tools")
    le = F.col("low.steering_rate") <= F.col("high.steering_rate")
    lt = F.lit(False)
    for m in means:
        le, lt = le & (F.col(f"low.{m}") <= F.col(f"high.{m}")), lt | (F.col(f"low.{m}") < F.col(f"high.{m}"))
    first = pairs.where(le & lt).orderBy("task_type", "model", "e1", "e2").limit(1)
    return first.select("task_type", "model", F.col("low.effort").alias("better"), F.col("high.effort").alias("worse"), F.round(cost("low."), 4).alias("better_cost"), F.round(cost("high."), 4).alias("worse_cost"))


def comparable(cohorts_df: DataFrame, least: int = LEAST) -> DataFrame:
    """The cohorts of :func:`as_cohorts` that are large enough, of a known type, and have a large enough peer of the same type and dimension with another name or on the other side; a route's peer is the same route."""
    big = cohorts_df.where(F.col("samples") >= least)
    same = F.when(F.col("dimension") == "routing", F.col("name")).otherwise("")
    keyed = big.withColumn("route", same)
    peers = keyed.groupBy("task_type", "dimension", "route").agg(F.count_distinct("name", "uses").alias("peers"))
    return keyed.where("task_type <> 'unknown'").join(peers.where("peers > 1"), ["task_type", "dimension", "route"]).select(*cohorts_df.columns)


def insights(obs: DataFrame, tops: DataFrame, least: int = LEAST) -> DataFrame:
    """(priority, kind, label, samples, rate): what a report says first. ``tops``: (field, label) of the most frequent labels.

    strength and weakness are the known types that steer least and most; high names the validation, else the
    reason; medium the prompt issue, else the agents' rule; low the skill and the routing hypothesis, where there are such.
    """
    types = obs.groupBy("task_type").agg(*_stats()).where((F.col("samples") >= least) & ~F.col("task_type").isin("", "unknown", "other"))
    order = F.struct("steering_rate", "task_type")
    down = F.struct((-F.col("steering_rate")).alias("r"), "task_type")
    row = lambda p, k, x: types.agg(F.min_by(F.struct("task_type", "samples", "steering_rate"), x).alias("t")).where("t is not null").select(F.lit(p).alias("priority"), F.lit(k).alias("kind"), F.col("t.task_type").alias("label"), F.col("t.samples").alias("samples"), F.col("t.steering_rate").alias("rate"))
    named = tops.groupBy().agg(*(F.max(F.when(F.col("field") == f, F.col("label"))).alias(f) for f in ("validation_type", "steering_reason", "prompt_issue", "agents_rule", "skill_candidate")))
    pick = lambda p, *fs: F.struct(F.lit(p).alias("priority"), F.coalesce(*(F.when(F.col(f).isNotNull(), F.lit(f)) for f in fs)).alias("kind"), F.coalesce(*(F.col(f) for f in fs)).alias("label"))
    some = named.select(F.explode(F.array(pick("weakness", "steering_reason"), pick("high", "validation_type", "steering_reason"), pick("medium", "prompt_issue", "agents_rule"), pick("low", "skill_candidate"))).alias("x")).where("x.label is not null").select("x.*", F.lit(None).cast("bigint").alias("samples"), F.lit(None).cast("double").alias("rate"))
    route = routing_hypothesis(obs, least).select(F.lit("low").alias("priority"), F.lit("routing").alias("kind"), F.concat_ws(" / ", "model", "better").alias("label"), F.lit(None).cast("bigint").alias("samples"), F.lit(None).cast("double").alias("rate"))
    return row("strength", "task_type", order).unionByName(row("weakness", "task_type", down)).unionByName(some).unionByName(route)


def extremes(obs: DataFrame, least: int = LEAST) -> DataFrame:
    """The known types with the lowest and the highest steering rate; ties by name. Needs two types and unequal rates."""
    g = obs.where(~F.col("task_type").isin("", "unknown", "other")).groupBy("task_type").agg(*_stats()).where(F.col("samples") >= least)
    one = g.agg(F.count("*").alias("k"), F.min(F.struct("steering_rate", "task_type")).alias("lo"), F.max("steering_rate").alias("top"), F.min(F.struct((-F.col("steering_rate")).alias("r"), "task_type")).alias("hi"))
    return one.where((F.col("k") >= 2) & (F.col("lo.steering_rate") < F.col("top"))).select(F.col("lo.task_type").alias("lowest"), F.col("lo.steering_rate").alias("lowest_rate"), F.col("hi.task_type").alias("highest"), F.col("top").alias("highest_rate"))


def label_shares(rows: DataFrame, label: str, drop: tuple[str, ...] = (), least: int = 1) -> DataFrame:
    """(label, n, pct): counts with their share of all rows, most first; ``drop`` and rare labels go after the share is taken."""
    total = Window.partitionBy()
    g = rows.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n")).withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(total), 6))
    return g.where(~F.col("label").isin(*drop) & (F.col("n") >= least) if drop else F.col("n") >= least).orderBy(F.desc("n"), "label")


def mechanism_shares(rows: DataFrame, mechanisms: str = "prevention_mechanisms") -> DataFrame:
    """(mechanism, n, pct): each case counts once for each of its mechanisms, so shares of the cases may add up to more than 100; empty lists are ``not_preventable``."""
    cases = rows.where(F.col(mechanisms).isNotNull())
    each = cases.select(F.explode(F.when(F.size(mechanisms) == 0, F.array(F.lit("not_preventable"))).otherwise(F.array_distinct(mechanisms))).alias("mechanism")).groupBy("mechanism").agg(F.count("*").alias("n"))
    return each.join(F.broadcast(cases.agg(F.count("*").alias("cases")))).select("mechanism", "n", F.round(F.col("n") * 100.0 / F.col("cases"), 6).alias("pct"))  # one row on the right


def top_label(rows: DataFrame, label: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """The most frequent label, ties by name."""
    return label_shares(rows, label, drop).select("label", "n").limit(1)
