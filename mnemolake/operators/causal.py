"""Causal threads of streams: decisions and calls linked by causation, anomalies, anchors, root causes; for all streams at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.functions.jsonx import outcome_message, outcome_tag, raw, strict_string

LOOP_LEAST, DRIFT_LEAST = 3, 5


def thread_nodes(events: DataFrame) -> DataFrame:
    """(stream_id, seq, agent_id, node, text, phase, outcome, message, caused_by, correlation).

    node is decision (a StateTransition with a text description), call (a ToolCall) or intent; other records are no nodes.
    """
    k = F.col("kind_tag")
    text = F.when(k == "StateTransition", strict_string("payload", "description")).when(k == "ToolCall", F.coalesce(raw("payload", "$.tool"), F.lit(""))).when(k == "IntentLogged", raw("payload", "$.intent"))
    node = F.when((k == "StateTransition") & text.isNotNull(), "decision").when(k == "ToolCall", "call").when(k == "IntentLogged", "intent")
    e = events.where(k.isin("StateTransition", "ToolCall", "IntentLogged"))
    return e.select(
        "stream_id",
        "seq",
        "agent_id",
        node.alias("node"),
        text.alias("text"),
        F.when(k == "StateTransition", strict_string("payload", "phase")).alias("phase"),
        F.when(k == "ToolCall", outcome_tag("payload")).alias("outcome"),
        F.when((k == "ToolCall") & (outcome_tag("payload") == "Err"), outcome_message("payload")).alias("message"),
        F.col("causation").alias("caused_by"),
        "correlation",
    ).where("node is not null")


def causal_links(nodes: DataFrame) -> DataFrame:
    """(stream_id, seq, caused): the decisions and calls that each decision or call caused in its stream, in order.

    A parent whose children are most of the stream still gets the list: it is the result. Pairs alone are causal_pairs.
    """
    n = nodes.where("node <> 'intent'")
    kids = n.where("caused_by is not null").groupBy("stream_id", F.col("caused_by").alias("seq")).agg(F.array_sort(F.collect_list("seq")).alias("caused"))
    return n.select("stream_id", "seq").join(kids, ["stream_id", "seq"], "left").select("stream_id", "seq", F.coalesce("caused", F.array().cast("array<bigint>")).alias("caused"))


def error_loops(nodes: DataFrame, least: int = LOOP_LEAST) -> DataFrame:
    """(stream_id, tool, message, repetitions): the same error of a tool at least so often in a stream; timeouts are no errors."""
    return nodes.where("node = 'call' and outcome = 'Err'").groupBy("stream_id", F.col("text").alias("tool"), "message").agg(F.count(F.lit(1)).alias("repetitions")).where(F.col("repetitions") >= least)


def objective_drift(nodes: DataFrame, least: int = DRIFT_LEAST) -> DataFrame:
    """(stream_id, intent_seq, repetitions): at least so many decisions with another correlation than the stream's first intent; null is another."""
    first = nodes.where("node = 'intent'").groupBy("stream_id").agg(F.min("seq").alias("intent_seq"), F.min_by(F.struct("correlation"), "seq").alias("c"))
    d = nodes.where("node = 'decision'").join(first, "stream_id").where(~F.col("correlation").eqNullSafe(F.col("c.correlation")))
    return d.groupBy("stream_id", "intent_seq").agg(F.count(F.lit(1)).alias("repetitions")).where(F.col("repetitions") >= least)


def process_quality(nodes: DataFrame) -> DataFrame:
    """(stream_id, process_quality): 1 less 0.2 for each repetition of a loop, at most 5, and 0.05 for each drifted decision, at most 10; never below 0."""
    loops = error_loops(nodes).select("stream_id", (F.least("repetitions", F.lit(5)) * 0.2).alias("p"))
    drift = objective_drift(nodes).select("stream_id", (F.least("repetitions", F.lit(10)) * 0.05).alias("p"))
    p = loops.unionByName(drift).groupBy("stream_id").agg(F.sum("p").alias("p"))
    s = nodes.select("stream_id").distinct().join(p, "stream_id", "left")
    return s.select("stream_id", F.round(F.greatest(F.lit(0.0), 1 - F.coalesce("p", F.lit(0.0))), 6).alias("process_quality"))


def first_decisions(nodes: DataFrame) -> DataFrame:
    """(stream_id, seq, decision): the nearest decision at or above each failed call, following causation within its stream.

    Chains of any length: forests of links that end at decisions, as in the hierarchy operator; calls on rings have none.
    """
    from mnemolake.operators.hierarchy import hierarchy

    n = nodes.where("node <> 'intent'")
    parent = n.select(F.col("stream_id").alias("_s"), F.col("seq").alias("_q"))
    # a decision ends the walk, and so does a cause outside the stream
    links = n.join(parent, (n["stream_id"] == parent["_s"]) & (n["caused_by"] == parent["_q"]), "left")
    links = links.select("seq", F.when(F.col("node") == "call", F.col("_q")).alias("up"))
    h = hierarchy(links, "seq", "up").where("ring is null")
    fails = n.where("node = 'call' and outcome = 'Err'").select("stream_id", "seq")
    ends = n.where("node = 'decision'").select(F.col("seq").alias("root"))
    return fails.join(h, fails["seq"] == h["node"]).join(ends, "root").select("stream_id", "seq", F.col("root").alias("decision"))


def root_causes(nodes: DataFrame) -> DataFrame:
    """(stream_id, root_seq, failures): the decision that most failed calls of a stream lead back to; ties to the earlier."""
    c = first_decisions(nodes).groupBy("stream_id", "decision").agg(F.count(F.lit(1)).alias("failures"))
    best = c.groupBy("stream_id").agg(F.max(F.struct(F.col("failures"), (-F.col("decision")).alias("d"))).alias("b"))
    return best.select("stream_id", (-F.col("b.d")).alias("root_seq"), F.col("b.failures").alias("failures"))


def phase_summary(nodes: DataFrame) -> DataFrame:
    """(stream_id, phase, decisions, first_seq, first_text) of each phase of a stream."""
    d = nodes.where("node = 'decision'")
    return d.groupBy("stream_id", "phase").agg(F.count(F.lit(1)).alias("decisions"), F.min("seq").alias("first_seq"), F.min_by("text", "seq").alias("first_text"))
