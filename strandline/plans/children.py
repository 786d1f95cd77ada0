"""Queries of the working turns of agents: their facts, what they used, and the user turns they worked for.

The records of the tables name no root turn of another session, so the queries on user turns take an agent's turns
to work for the first turn of its root session.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import children as C
from strandline.operators import effectiveness as E
from strandline.operators import records as R
from strandline.operators import turns as T
from strandline.operators import usage as U
from strandline.plans.reference import BEFORE, SINCE, stand_in_labels
from strandline.session import cut
from strandline.sources.tables import table

MARKER = "token tally"
Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    Q[f.__name__] = f
    return f


class World:
    """What several steps of one query read, each built at most once; the facts and the turns are written to the shared folder."""

    def __init__(self, raw: DataFrame, since_ns: int | None = None, before_ns: int | None = None, stand_in: bool = False) -> None:
        self.raw, self.since, self.before, self.stand_in = raw, since_ns, before_ns, stand_in
        self.records = R.decode(raw) if before_ns is None else R.as_of(R.decode(raw), before_ns)
        self.files = R.child_meta(self.raw)
        self.agents = C.children(self.files)
        self._kept: dict[str, DataFrame] = {}

    def keep(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._kept:
            self._kept[name] = cut(make())
        return self._kept[name]

    @property
    def owners(self) -> DataFrame:
        return self.files.where("id <> ''").select("file_path", F.col("id").alias("owner"), F.lit("agent").alias("side"), (F.col("forked_from_id") != "").alias("forked"))

    @property
    def facts(self) -> DataFrame:
        return self.keep("facts", lambda: C.timed(C.facts(self.records, self.owners)))

    @property
    def turns(self) -> DataFrame:
        return self.keep("turns", lambda: C.inclusion(C.resources(self.facts, C.child_turns(self.facts)), self.agents, self.since, self.before))

    @property
    def counted(self) -> DataFrame:
        return self.turns.where("reason = 'included'")

    # ---- user sessions and the evidence of their turns ----------------------------------------------------------

    @property
    def decoded(self) -> DataFrame:
        """The decoded records, written once: the steps below read them four times."""
        return self.keep("records", lambda: self.records)

    @property
    def users(self) -> DataFrame:
        """The files of user sessions: those with an interaction that starts at a readable instant, without a marked message."""
        def make() -> DataFrame:
            own = R.first_meta(self.raw).where("thread_source = 'user'").select("file_path", F.coalesce("id", F.lit("")).alias("id"), (F.coalesce("forked_from_id", F.lit("")) != "").alias("forked"))
            some = T.interactions(self.decoded).where("start_ns is not null").select("file_path").distinct()
            return own.join(R.marked_files(self.raw, MARKER), "file_path", "left_anti").join(some, "file_path", "left_semi")

        return self.keep("users", make)

    @property
    def user_turns(self) -> DataFrame:
        return self.keep("user_turns", lambda: T.turns(self.decoded.join(self.users.select("file_path"), "file_path", "left_semi")).where("start_ns is not null"))

    @property
    def sessions(self) -> DataFrame:
        return C.turn_sessions(self.user_turns, self.users)

    @property
    def all_turns(self) -> DataFrame:
        """The turns of agents and of user sessions: responses are claimed across both."""
        def make() -> DataFrame:
            owners = self.owners.unionByName(self.users.where("id <> ''").select("file_path", F.col("id").alias("owner"), F.lit("user").alias("side"), "forked"))
            f = self.keep("all_facts", lambda: C.timed(C.facts(self.decoded, owners)))
            return C.metrics(C.resources(f, C.child_turns(f)))

        return self.keep("all_turns", make)

    @property
    def links(self) -> DataFrame:
        def make() -> DataFrame:
            roots = cut(C.root_sessions(self.agents, self.users))
            turns = C.stand_in_roots(self.all_turns, roots, self.sessions) if self.stand_in else self.all_turns
            return C.linked(C.inclusion(turns, self.agents, self.since, self.before), roots, self.sessions)

        return self.keep("links", make)

    @property
    def linked(self) -> DataFrame:
        return self.links.where("link = 'linked'")

    @property
    def profiles(self) -> DataFrame:
        own = self.linked
        return C.profiles(own, C.usage_rows(self._kept["all_facts"], own))

    @property
    def observations(self) -> DataFrame:
        def make() -> DataFrame:
            obs = E.observations(self.user_turns, stand_in_labels(self.user_turns), self.linked.select(F.col("root_turn").alias("task")))
            agents = C.summed(self.linked, "root_turn").withColumnRenamed("root_turn", "task")
            return E.with_evidence(obs, C.parent_metrics(self.sessions, self.all_turns), agents)

        return self.keep("observations", make)


def _world(spark: SparkSession, d: str) -> World:
    return World(table(spark, d, "rollout_records"), stand_in=True)


def _total(rows: DataFrame, *keys: str) -> DataFrame:
    return U.usage_totals(rows, *keys, "source")


@query
def q9_child_turns(spark, d):
    w = _world(spark, d)
    return C.child_turns(w.facts).select("owner", "turn_id", "start_ns", "end_ns", "status", "terminal_conflict", "ambiguous", "counters", "usage_records", F.size("settings").alias("settings"))


@query
def q10_ownership(spark, d):
    w = _world(spark, d)
    return C.child_turns(w.facts).select("owner", "turn_id", "in_fork", "owned_seen", "owned", "vote_conflict")


@query
def a21_children(spark, d):
    a = _world(spark, d).agents.where(f"not creation_conflict and created_ns between {SINCE} and {BEFORE}")
    return a.agg(F.count("*").alias("created"), F.count_if(F.col("has_depth") & (F.col("depth") > 1)).alias("nested"))


@query
def a22_working(spark, d):
    return _world(spark, d).counted.groupBy("status").agg(F.count("*").alias("n"))


@query
def a22_roles(spark, d):
    w = _world(spark, d)
    created = w.agents.where("not creation_conflict and created_ns is not null").select("role", F.lit(1).alias("created"), F.lit(0).alias("working"))
    both = created.unionByName(w.counted.select("role", F.lit(0).alias("created"), F.lit(1).alias("working")))
    return both.groupBy("role").agg(F.sum("created").alias("created"), F.sum("working").alias("working")).orderBy(F.desc(F.expr("created + working")), "role")


@query
def a23_settings(spark, d):
    s = _world(spark, d).counted.select(F.explode(F.when(F.size("settings") == 0, F.array(F.struct(F.lit("unknown").alias("model"), F.lit("unknown").alias("effort")))).otherwise(F.col("settings"))).alias("s"))
    return T.histogram(s.select("s.*"), "model", "effort")


@query
def a24_by_role(spark, d):
    w = _world(spark, d)
    return _total(C.usage_rows(w.facts, w.counted), "role")


@query
def a24_by_model(spark, d):
    w = _world(spark, d)
    return _total(C.usage_rows(w.facts, w.counted), "model")


@query
def a25_requests(spark, d):
    r = C.requests(_world(spark, d).facts)
    return r.select("owner", "turn_id", "response_id", *(F.when(F.col("valid"), F.col(p)).alias(p) for p in R.USAGE), "valid")


@query
def a26_sources(spark, d):
    return _world(spark, d).counted.select("owner", "turn_id", "source", "valid_requests", "invalid_records", "recorded_total_tokens", F.when(F.col("source") == "estimated", F.col("estimated_total_tokens")).alias("estimated_total_tokens"))


@query
def a27_estimates(spark, d):
    w = _world(spark, d)
    return C.estimates(w.facts).select("owner", "turn_id", "state", *(f"estimated_{p}" for p in R.USAGE))


@query
def a28_checks(spark, d):
    return _world(spark, d).counted.groupBy("source", F.coalesce("check", F.lit("")).alias("check"), "state").agg(F.count("*").alias("n"))


@query
def a29_durations(spark, d):
    return _world(spark, d).counted.agg(F.try_sum("duration_ms").alias("duration_ms"), F.count("duration_ms").alias("known"), F.count_if(F.col("duration_ms").isNull()).alias("missing"), F.count_if("invalid_duration").alias("invalid"))


@query
def a30_anonymous(spark, d):
    return _world(spark, d).turns.select("owner", "turn_id", "usage_records", F.col("anonymous").alias("requests"))


@query
def a31_tools(spark, d):
    return _world(spark, d).turns.select("owner", "turn_id", "tools", F.col("more_tools").alias("lower_bound"))


@query
def a32_single_model(spark, d):
    return _world(spark, d).turns.select("owner", "turn_id", F.col("single_model").alias("model"))


@query
def j8_model_at(spark, d):
    return C.requests(_world(spark, d).facts).where("valid").select("owner", "turn_id", "response_id", "model")


@query
def j12_response_owners(spark, d):
    return C.response_owners(_world(spark, d).facts.where("what = 'usage'"))


@query
def a39_coverage(spark, d):
    w = _world(spark, d)
    a = w.agents.agg(*(F.count_if(F.expr(e)).alias(n) for n, e in (("missing_parents", "parent_id = ''"), ("missing_depth", "not has_depth"), ("disputed_agents", "attribute_conflict"), ("no_instant", "created_ns is null"))))
    t = w.turns.agg(*(F.count_if(F.col("reason") == r).alias(r) for r in ("unattributed", "before_creation", "ownership_conflict", "terminal_conflict")), F.coalesce(F.sum("early_ends"), F.lit(0)).alias("terminal_mismatches"))
    m = w.records.join(w.owners.select("file_path"), "file_path", "left_semi").agg(F.count_if(C.malformed()).alias("malformed"))
    ids = w.files.agg(F.count_if(F.col("id") == "").alias("missing_ids"))
    return ids.join(F.broadcast(a)).join(F.broadcast(t)).join(F.broadcast(m))  # one row each


@query
def a40_copies(spark, d):
    return _world(spark, d).agents.select("owner", "files", "role", "has_depth", "forked", "creation_conflict", "role_conflict", "depth_conflict", "fork_conflict", "parent_conflict", "attribute_conflict")


@query
def a41_merged(spark, d):
    return _world(spark, d).facts.groupBy("owner", "turn_id", "what").agg(F.count("*").alias("n"), F.count_distinct("file_path").alias("files"), F.min("ns").alias("first_ns"), F.max("ns").alias("last_ns"))


@query
def a42_terminals(spark, d):
    return _world(spark, d).turns.select("owner", "turn_id", "end_ns", F.when(F.col("terminal_conflict"), None).otherwise(F.col("status")).alias("status"), "terminal_conflict", "early_ends")


@query
def a43_reasons(spark, d):
    return _world(spark, d).turns.groupBy("reason").agg(F.count("*").alias("n"))


@query
def a44_foreign(spark, d):
    return _world(spark, d).turns.groupBy("reason", "foreign_usage").agg(F.count("*").alias("n"))


@query
def a47_deltas(spark, d):
    w = _world(spark, d)
    rows = C.valid_delta(w.facts.where("what = 'counter'"), "usage", "base", "d")
    return rows.select("owner", "turn_id", "ns", *(F.when(F.col("d.valid"), F.col(f"d.{p}")).alias(p) for p in R.USAGE), F.col("d.valid").alias("valid")).distinct()


@query
def j9_roots(spark, d):
    w = _world(spark, d)
    return C.root_sessions(w.agents, w.users)


@query
def j10_links(spark, d):
    return _world(spark, d).links.select("owner", "turn_id", "root_turn", "root_session", "link")


@query
def j11_turn_sessions(spark, d):
    return _world(spark, d).sessions


def _flat(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *(F.round(f"{m}.total", 3).alias(m) for m in C.METRICS), *(F.col(f"{m}.{c}").alias(f"{m}_{c}") for m in C.METRICS for c in ("known", "missing")), *C.COUNTS)


@query
def a45_agents(spark, d):
    w = _world(spark, d)
    return _flat(C.summed(w.linked, "root_turn"), "root_turn")


@query
def a45_parents(spark, d):
    w = _world(spark, d)
    return _flat(C.parent_metrics(w.sessions, w.all_turns), "task")


@query
def a45_linkage(spark, d):
    return _world(spark, d).links.groupBy("link").agg(F.count("*").alias("n"))


@query
def j13_profiles(spark, d):
    w = _world(spark, d)
    w.linked
    return _flat(w.profiles, "task", "dimension", "name")


@query
def a17_cohorts(spark, d):
    return E.cohorts(_world(spark, d).observations)


@query
def a18_routing(spark, d):
    return E.routing_cohorts(_world(spark, d).observations)


@query
def a19_profiles(spark, d):
    w = _world(spark, d)
    return E.profile_cohorts(w.observations, w.profiles)


@query
def r3_comparable(spark, d):
    w = _world(spark, d)
    return E.comparable(E.as_cohorts(E.cohorts(w.observations), E.routing_cohorts(w.observations), E.profile_cohorts(w.observations, w.profiles)))


QUERIES = Q
