"""Deterministic folds over the log: current facts, latest states, tool statistics, grants, checkpoints.

Each takes current records, one row a seq, and is a grouped aggregate or an anti-join, so partial states of tasks merge by
the engine's own partial aggregation. `agents` limits a fold to some agents; an id that is given twice counts once.
Records with a null payload count as records without fields.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.functions.jsonx import has_field, outcome_is_error, outcome_text, raw, strict_number, strict_uint


def scoped(events: DataFrame, agents: Iterable[str] | None = None) -> DataFrame:
    """Records of these agents; all if none are named."""
    return events if agents is None else events.where(F.col("agent_id").isin(sorted(set(agents))))


def of_kind(events: DataFrame, kind: str) -> DataFrame:
    return events.where(F.col("kind_tag") == kind)


def _long(field: str) -> Column:
    return raw("payload", f"$.{field}").try_cast("bigint")


def current_facts(events: DataFrame, agents: Iterable[str] | None = None) -> DataFrame:
    """(agent_id, stream_id, seq, payload, valid): a fact is invalid once a later MemoryInvalidate of its own agent names it."""
    e = scoped(events, agents)
    facts = of_kind(e, "Fact").select("agent_id", "stream_id", "seq", "payload")
    gone = of_kind(e, "MemoryInvalidate").select(F.col("agent_id").alias("_a"), _long("target_seq").alias("_t"), F.col("seq").alias("_s"))
    # only the latest call for a target can matter, so a target named again and again stays one row
    gone = gone.where("_t is not null").groupBy("_a", "_t").agg(F.max("_s").alias("_s"))
    on = (facts["agent_id"] == gone["_a"]) & (facts["seq"] == gone["_t"])
    return facts.join(gone, on, "left").select("agent_id", "stream_id", "seq", "payload", F.coalesce(F.col("_s") <= F.col("seq"), F.lit(True)).alias("valid"))


def task_state(events: DataFrame, agents: Iterable[str] | None = None) -> DataFrame:
    """(agent_id, stream_id, seq, state): the payload of the last StateTransition of each agent and stream."""
    e = of_kind(scoped(events, agents), "StateTransition")
    top = e.groupBy("agent_id", "stream_id").agg(F.max_by(F.struct("seq", "payload"), "seq").alias("s"))
    return top.select("agent_id", "stream_id", "s.seq", F.col("s.payload").alias("state"))


def tool_ledger(events: DataFrame, agents: Iterable[str] | None = None, by: Iterable[str] = ()) -> DataFrame:
    """Statistics of each tool: invocations, errors, summed latency and cost, last outcome and last seq.

    An outcome counts only where the field is there; the last outcome is that of the greatest seq that has one.
    """
    e = of_kind(scoped(events, agents), "ToolCall")
    rows = e.select(*by, raw("payload", "$.tool").alias("tool"), "seq", has_field("payload", "outcome").alias("has"), outcome_is_error("payload").alias("err"), outcome_text("payload").alias("out"), strict_uint("payload", "latency_ms").alias("lat"), strict_number("payload", "cost").alias("cost"))
    return (
        rows.where("tool is not null")
        .groupBy(*by, "tool")
        .agg(
            F.count(F.lit(1)).alias("invocations"),
            F.count_if(F.col("has") & F.col("err")).alias("errors"),
            F.coalesce(F.sum("lat"), F.lit(0)).alias("total_latency_ms"),
            F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("total_cost"),
            F.max_by(F.when(F.col("has"), F.col("out")), F.when(F.col("has"), F.col("seq"))).alias("last_outcome"),
            F.max("seq").alias("last_seq"),
        )
    )


def consent_grants(events: DataFrame) -> DataFrame:
    """Grants that no later revocation names: (grant_seq, grantor, grantee, action, resource, expires)."""
    g = of_kind(events, "ConsentGranted").select(
        F.col("seq").alias("grant_seq"), raw("payload", "$.from").alias("grantor"), raw("payload", "$.to").alias("grantee"), raw("payload", "$.action").alias("action"), raw("payload", "$.resource").alias("resource"), _long("expires").alias("expires")
    )
    r = of_kind(events, "ConsentRevoked").select(_long("grant_seq").alias("_g"), F.col("seq").alias("_s")).where("_g is not null").groupBy("_g").agg(F.max("_s").alias("_s"))
    return g.join(r, (g["grant_seq"] == r["_g"]) & (r["_s"] > g["grant_seq"]), "left_anti")


def checkpoint(events: DataFrame) -> DataFrame:
    """(last_seq, checkpoint): the greatest seq, and the least over agents of their greatest seq."""
    return events.groupBy("agent_id").agg(F.max("seq").alias("s")).agg(F.coalesce(F.max("s"), F.lit(0)).alias("last_seq"), F.coalesce(F.min("s"), F.lit(0)).alias("checkpoint"))


class Projection(ABC):
    """A fold of one's own: name it and map records to its state table; `keys` are the columns that identify a row of it.

    To keep it up to date, each batch's partial state is kept, and the states of all batches are merged when it is read. Unless a
    fold knows a smaller one, its partial state is the records of its `kinds`, and merging is folding.
    """

    name: str
    keys: tuple[str, ...] = ()
    kinds: tuple[str, ...] | None = None

    @abstractmethod
    def frame(self, events: DataFrame) -> DataFrame: ...

    def partial(self, events: DataFrame) -> DataFrame:
        """The state of one batch."""
        return events if self.kinds is None else events.where(F.col("kind_tag").isin(*self.kinds))

    def merge(self, partials: DataFrame) -> DataFrame:
        """The projection from the states of all batches."""
        return self.frame(partials)


class Named(Projection):
    def __init__(self, name: str, keys: tuple[str, ...], kinds: tuple[str, ...], fold, last: tuple[str, ...] = ()):
        self.name, self.keys, self.kinds, self._fold, self._last = name, keys, kinds, fold, last

    def frame(self, events: DataFrame) -> DataFrame:
        return self._fold(events)

    def partial(self, events: DataFrame) -> DataFrame:
        rows = super().partial(events)
        if not self._last:
            return rows
        # only the last record of each key can matter
        top = rows.groupBy(*self._last).agg(F.max_by(F.struct(*rows.columns), "seq").alias("_r"))
        return top.select("_r.*")


#: The folds that every store keeps.
REGISTRY: dict[str, Projection] = {
    p.name: p
    for p in (
        Named("current_facts", ("agent_id", "stream_id", "seq"), ("Fact", "MemoryInvalidate"), current_facts),
        Named("task_state", ("agent_id", "stream_id"), ("StateTransition",), task_state, ("agent_id", "stream_id")),
        Named("tool_ledger", ("tool",), ("ToolCall",), tool_ledger),
        Named("consent_graph", ("grant_seq",), ("ConsentGranted", "ConsentRevoked"), consent_grants),
    )
}
