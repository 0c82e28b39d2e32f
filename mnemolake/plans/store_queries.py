"""Queries of the store's surface: scans, given filters, kept projections, the index through its versions, contexts of all streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemolake.functions import embed, handoff
from mnemolake.functions.jsonx import raw, strict_uint
from mnemolake.operators import context, projections, retrieval
from mnemolake.operators.predicates import EventPattern, filters_in, has_filters, in_namespace, value_matches
from mnemolake.plans import core_queries as core
from mnemolake.plans.core_queries import _C, _DRIFT, _E, _FT, _J, _LAT, _LOOPS, _N, _OKV, _X, AGENTS, DIM, STREAM
from mnemolake.session import scratch_path
from mnemolake.sources.index import SemanticIndex
from mnemolake.sources.tables import current_events, table
from mnemolake.sources.versioned import VersionedTable
from mnemolake.streaming.projections import rebuild


def ann_recall_reached(spark, d):
    """Whether the approximate search finds 0.95 or more of what the exact one does; without queries there is nothing to miss."""
    return core.recall_at_k(spark, d).select(F.coalesce(F.col("recall") >= 0.95, F.lit(True)).alias("reached"))


def log_all_agents_scan(spark, d):
    e = current_events(core._log(spark, d).where(F.col("stream_id") == STREAM))
    return e.select("seq", "agent_id", "kind_tag").orderBy("seq")


def pattern_parsed(spark, d):
    p = EventPattern.parse({"agent": AGENTS[0], "kind": "ToolCall", "stream": STREAM, "predicate": {"type": "always"}})
    return core._events(spark, d).where(p.column()).select("seq")


def value_filter_range(spark, d):
    """Calls whose latency is a number in a range; a text that looks like one isn't."""
    calls = current_events(core._log(spark, d).where("kind_tag = 'ToolCall'"))
    return calls.where(value_matches("payload", {"latency_ms": {"$gte": 100, "$lt": 200}, "outcome": {"$ne": "Timeout"}})).select("seq")


def value_filter_unknown(spark, d):
    """A condition that isn't known is met by nothing."""
    return core._events(spark, d).where(value_matches("payload", {"tool": {"$like": "x"}})).select("seq")


def namespace_match(spark, d):
    levels = F.split("id", "[:]")
    return core._current_documents(spark, d).where(in_namespace(levels, ["thr", "*"]) & in_namespace(levels, ["thr", "*"], suffix=True)).select("id")


def filters_given(spark, d):
    """One filter given as a mapping with field and value, and another as a mapping by field."""
    wanted = [*filters_in({"field": "kind", "value": "note"}), *filters_in({"lang": "en"})]
    return core._docs(spark, d).where(has_filters(wanted)).select("id")


def embedding_texts(spark, d):
    return core._docs(spark, d).select("id", embed.embedding_text_column().alias("text"))


def handoff_keys(spark, d):
    e = core._events(spark, d).select("agent_id", "stream_id").distinct()
    return e.select("agent_id", "stream_id", handoff.key_column("agent_id", "stream_id").alias("key"))


def task_state_of(spark, d):
    """The state that a projection of one agent and stream gives."""
    return projections.task_state(core._events(spark, d), [AGENTS[0]]).where(F.col("stream_id") == STREAM)


def collection_get(spark, d):
    c = core._current_documents(spark, d)
    return c.where((F.col("collection") == "threads") & (F.col("id") == "thr:10")).select("collection", "id", "version", "doc")


def projection_rebuilt(spark, d):
    """Task states after their kept table was dropped and filled from the whole log as one version, twice."""
    log, p = core._events(spark, d), projections.REGISTRY["task_state"]
    target = VersionedTable(spark, scratch_path(spark, "rebuilt"), p.frame(log).schema)
    rebuild(log, p, target)
    rebuild(log, p, target)
    return target.read()


def projection_merged(spark, d):
    """Grants from the partial states of parts of the log, kept apart."""
    p = projections.REGISTRY["consent_graph"]
    log = core._events(spark, d)
    parts = [p.partial(log.where(F.pmod(F.xxhash64("agent_id"), F.lit(3)) == i)) for i in range(3)]
    return p.merge(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def _loaded(spark, d) -> SemanticIndex:
    """The index as delivered: every row in order of time, loaded as one batch in which the last of an id wins, twice."""
    index = SemanticIndex(spark, scratch_path(spark, "index"), DIM, "test")
    rows = table(spark, d, "index_docs").withColumn("vector", F.when(retrieval.valid_vector("vector", DIM), F.col("vector")))
    index.upsert_frame(rows, ["indexed_at"])
    index.upsert_frame(rows, ["indexed_at"])
    return index


def _indexed(index: SemanticIndex):
    return index.frame().select("id", "name", F.col("vector").isNotNull().alias("has_vector"))


def index_upserted(spark, d):
    return _indexed(_loaded(spark, d))


def index_deleted(spark, d):
    index = _loaded(spark, d)
    index.delete_by_filter("kind", "note")
    return _indexed(index)


def index_compacted(spark, d):
    index = _loaded(spark, d)
    index.delete_by_filter("kind", "note")
    index.compact()
    return _indexed(index)


def index_moved_rows(spark, d):
    """What a compaction shows as changed: nothing."""
    index = _loaded(spark, d)
    v = index.table.version()
    index.compact()
    return index.table.diff(v).select("id", "change")


def context_windows(spark, d):
    """Contexts of all streams at once in the phase `plan`, within 400 tokens."""
    return context.context_windows(core._nodes(spark, d), "plan", 400).select("stream_id", "type", "text", "seq", "used")


def current_objective(spark, d):
    return context.current_objective(core._nodes(spark, d), "The")


def output_quality(spark, d):
    """Of each agent's and stream's latest state: whether its text speaks of success or failure."""
    return projections.task_state(core._events(spark, d)).select("agent_id", "stream_id", context.quality_column("state").alias("quality"))


def tool_percentiles_recent(spark, d):
    """Percentiles of each tool's last 500 latencies, by seq."""
    c = core._events(spark, d).where("kind_tag = 'ToolCall'").select(raw("payload", "$.tool").alias("tool"), "seq", strict_uint("payload", "latency_ms").alias("l")).where("l is not null and tool is not null")
    c = c.withColumn("r", F.row_number().over(Window.partitionBy("tool").orderBy(F.desc("seq")))).where("r <= 500")
    p = lambda q: F.expr(f"percentile_disc({q}) within group (order by l)").cast("bigint")
    return c.groupBy("tool").agg(p(0.5).alias("p50"), p(0.99).alias("p99"), F.count(F.lit(1)).alias("calls"))


_VEC = _OKV("d")
_NOTE = f"list_contains({_FT}, 'kind' || chr(31) || 'note')"
_NUM = "json_type(payload, '$.latency_ms') in ('UBIGINT', 'BIGINT', 'DOUBLE')"
_VALUE = "json_extract_string(payload, '$.latency_ms')::double"
_SQ = "chr(39)"

ORACLES = {
    "ann_recall_reached": "select true reached",
    "log_all_agents_scan": f"with {_E} select seq, agent_id, kind_tag from cur where stream_id = '{STREAM}'",
    "pattern_parsed": f"with {_E} select seq from cur where agent_id = '{AGENTS[0]}' and kind_tag = 'ToolCall' and stream_id = '{STREAM}'",
    "value_filter_range": f"""with {_E} select seq from cur where kind_tag = 'ToolCall' and case when {_NUM} then {_VALUE} >= 100 and {_VALUE} < 200 else false end
      and not coalesce(json_type(payload, '$.outcome') = 'VARCHAR' and {_J('outcome')} = 'Timeout', false)""",
    "value_filter_unknown": "select seq from event_log where false",
    "namespace_match": f"with {_C} select id from cd where id like 'thr:%' and len(string_split(id, ':')) = 2",
    "filters_given": f"with {_X} select id from docs where {_NOTE} and list_contains({_FT}, 'lang' || chr(31) || 'en')",
    "embedding_texts": f"""with {_X} select id, array_to_string(list_filter(list_transform([name, tags, body], lambda x: regexp_replace(coalesce(x, ''), '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), chr(10)) as text from docs""",
    "handoff_keys": f"""with {_E} select distinct agent_id, stream_id, case when length(agent_id) > 0 and length(stream_id) > 0
      then replace(url_encode(agent_id), '*', '%2A') || ':' || replace(url_encode(stream_id), '*', '%2A') end as key from cur""",
    "task_state_of": f"with {_E} select agent_id, stream_id, max(seq) seq, arg_max(struct_pack(p := payload), seq).p state from cur where kind_tag = 'StateTransition' and agent_id = '{AGENTS[0]}' and stream_id = '{STREAM}' group by 1, 2",
    "collection_get": f"with {_C} select collection, id, version, doc from cd where collection = 'threads' and id = 'thr:10'",
    "projection_rebuilt": core.ORACLES["task_state_latest"],
    "projection_merged": core.ORACLES["consent_active_grants"],
    "index_upserted": f"with {_X} select id, name, {_VEC} has_vector from docs d",
    "index_deleted": f"with {_X} select id, name, {_VEC} has_vector from docs d where not {_NOTE}",
    "index_compacted": f"with {_X} select id, name, {_VEC} has_vector from docs d where not {_NOTE}",
    "index_moved_rows": "select id, '+' change from index_docs where false",
    "context_windows": f"""with {_E}, {_N}, {_LOOPS}, {_DRIFT}, de as (select *, coalesce(phase, 'plan') ph from n where node = 'decision'),
      past as (select stream_id, ph, count(*) c, min(seq) seq, arg_min(text, seq) text from de where ph <> 'plan' group by 1, 2),
      items as (
        select stream_id, 0 sect, tool k1, message k2, 0::bigint k3, 'anomaly' as type, 'Error loop: tool Some("' || replace(replace(tool, '\\', '\\\\'), '"', '\\"') || '") failed ' || repetitions || ' times' as text, null::bigint seq, 10 o from loops
        union all select stream_id, 1, '', '', 0, 'anomaly', 'Objective drift: ' || repetitions || ' decisions diverged from intent ' || {_SQ} || 'unknown intent' || {_SQ}, null, 10 from drift
        union all select stream_id, 2, ph, '', seq, 'decision', text, seq, 20 from de where ph = 'plan'
        union all select stream_id, 2, ph, '', seq, 'decision', text, seq, 20 from past
        union all select stream_id, 2, ph, '', 9223372036854775807, 'phaseSummary', 'Phase ' || ph || ' completed with ' || c || ' decisions', null, 10 from past),
      u as (select *, sum(greatest(1, (strlen(text) + o) // 4)) over (partition by stream_id order by sect, k1, k2, k3 rows unbounded preceding)::bigint used from items)
      select stream_id, type, text, seq, used from u where used <= 400""",
    "current_objective": f"with {_E}, {_N} select stream_id, max(seq) seq from n where node = 'decision' and contains(lower(text), 'the') group by 1",
    "output_quality": f"""with {_E}, s as (select agent_id, stream_id, coalesce(lower(arg_max(struct_pack(p := payload), seq).p), '') t from cur where kind_tag = 'StateTransition' group by 1, 2)
      select agent_id, stream_id, case when regexp_matches(t, 'success|done|ok') then 1.0 when regexp_matches(t, 'error|fail') then 0.0 else 0.5 end::double quality from s""",
    "tool_percentiles_recent": f"""with {_E}, c as (select {_J('tool')} tool, seq, {_LAT} l from cur where kind_tag = 'ToolCall'), r as (select *, row_number() over (partition by tool order by seq desc) rn from c where l is not null and tool is not null)
      select tool, quantile_disc(l, 0.5)::bigint p50, quantile_disc(l, 0.99)::bigint p99, count(*) calls from r where rn <= 500 group by 1""",
}

_FUNCTIONS = (
    ann_recall_reached, log_all_agents_scan, pattern_parsed, value_filter_range, value_filter_unknown, namespace_match, filters_given, embedding_texts, handoff_keys, task_state_of, collection_get,
    projection_rebuilt, projection_merged, index_upserted, index_deleted, index_compacted, index_moved_rows, context_windows, current_objective, output_quality, tool_percentiles_recent,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}
