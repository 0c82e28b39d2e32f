"""Queries of the engine's own operators: log, folds, predicates, documents, retrieval, causal threads, contexts, consent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.functions.analyzer import analyze, stemmed_terms, stop_words
from mnemolake.operators import ann, causal, consent, context, documents, projections, retrieval
from mnemolake.operators.predicates import Contains, Eq, EventPattern, filter_tokens, has_filters
from mnemolake.session import materialize
from mnemolake.sources.tables import current_docs, current_events, table

DIM = 32
AGENTS = ("orchestrator:root", "indexer:bulk", "planner:lead", "QA-2")
STREAM = "tkt-1001"


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "event_log")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return current_events(_log(spark, d))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return current_docs(table(spark, d, "index_docs"))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return materialize(causal.thread_nodes(_events(spark, d)), "nodes")


def log_stream_scan(spark, d):
    e = current_events(_log(spark, d).where((F.col("agent_id") == AGENTS[0]) & (F.col("stream_id") == STREAM)))
    return e.select("seq", "kind_tag", "ts_ms", "causation", "correlation").orderBy("seq")


def log_multi_agent_scan(spark, d):
    e = current_events(_log(spark, d).where(F.col("agent_id").isin(*AGENTS) & (F.col("stream_id") == STREAM)))
    return e.select("agent_id", "seq", "kind_tag", "ts_ms").orderBy("seq")


def log_point_read(spark, d):
    return current_events(_log(spark, d).where("seq = 17")).select("seq", "agent_id", "stream_id", "kind_tag", "payload")


def log_last_seq(spark, d):
    return projections.checkpoint(_log(spark, d))


def facts_current(spark, d):
    return projections.current_facts(_events(spark, d)).where("valid").select("agent_id", "stream_id", "seq")


def facts_invalidated(spark, d):
    return projections.current_facts(_events(spark, d)).where("not valid").select("agent_id", "stream_id", "seq")


def task_state_latest(spark, d):
    return projections.task_state(_events(spark, d))


def tool_ledger(spark, d):
    return projections.tool_ledger(_events(spark, d))


def tool_stats_scoped(spark, d):
    return projections.tool_ledger(_events(spark, d), [*AGENTS, AGENTS[0]])


def tool_ledger_by_agent(spark, d):
    return projections.tool_ledger(_events(spark, d), by=["agent_id"]).select("agent_id", "tool", "invocations", "errors", "last_seq")


def pattern_eq(spark, d):
    p = EventPattern(kind="StateTransition", predicate=Eq("/phase", "plan"))
    return _events(spark, d).where(p.column()).select("seq", "agent_id", "stream_id")


def pattern_contains(spark, d):
    p = EventPattern(kind="IntentLogged", predicate=Contains("intent", "order"))
    return _events(spark, d).where(p.column()).select("seq", "agent_id", "stream_id")


def kind_histogram(spark, d):
    return _events(spark, d).groupBy("agent_id", "kind_tag").agg(F.count(F.lit(1)).alias("events"), F.min("ts_ms").alias("first_ts"), F.max("ts_ms").alias("last_ts"))


def _current_documents(spark, d):
    return documents.current_documents(table(spark, d, "collection_docs"))


def collection_scan_page(spark, d):
    return documents.scan(_current_documents(spark, d), "threads", prefix="thr:", start="thr:1", limit=25, offset=5, reverse=True).select("id", "version")


def collection_count(spark, d):
    return documents.count(_current_documents(spark, d))


def collection_find_by(spark, d):
    return documents.find_by(_current_documents(spark, d), "threads", "thread_id", "th-10").select("id", "version")


def unique_violations(spark, d):
    return documents.unique_violations(_current_documents(spark, d), "thread_id")


def namespace_list(spark, d):
    levels = F.split(F.col("id"), "[:\\-]")
    return _current_documents(spark, d).select(F.concat_ws("/", F.col("collection"), F.slice(levels, 1, 1)).alias("namespace")).groupBy("namespace").agg(F.count(F.lit(1)).alias("documents"))


def doc_filter_and(spark, d):
    return _docs(spark, d).where(has_filters([("kind", "note"), ("lang", "en")])).select("id")


def filter_token_counts(spark, d):
    return _docs(spark, d).select("id", F.explode(F.array_distinct(filter_tokens())).alias("t")).groupBy(F.replace("t", F.lit("\u001f"), F.lit("=")).alias("token")).agg(F.count(F.lit(1)).alias("documents"))


def batch_dedup_last_wins(spark, d):
    return _docs(spark, d).select("id", "name", F.size(F.coalesce("filters", F.array())).alias("n_filters"))


def _queries(spark, d):
    return table(spark, d, "hybrid_queries")


def vector_topk(spark, d):
    q = _queries(spark, d).withColumn("filters", F.lit(None).cast("array<struct<field:string,value:string>>"))
    return retrieval.top(retrieval.cosine(_docs(spark, d), q, DIM), q, F.col("k")).select("query_id", "id", "score", "rank")


def vector_topk_filtered(spark, d):
    q = _queries(spark, d)
    return retrieval.top(retrieval.cosine(_docs(spark, d), q, DIM), q, F.col("k")).select("query_id", "id", "score", "rank")


def bm25_topk(spark, d):
    q = _queries(spark, d)
    return retrieval.top(retrieval.bm25(_docs(spark, d), q, {"body": 1.0}), q, F.col("k")).select("query_id", "id", "score", "rank")


def bm25_boosted_fields(spark, d):
    q = _queries(spark, d)
    return retrieval.top(retrieval.bm25(_docs(spark, d), q), q, F.col("k")).select("query_id", "id", "score", "rank")


def hybrid_rrf(spark, d):
    return retrieval.hybrid(_docs(spark, d), _queries(spark, d), DIM).select("query_id", "id", "score", "rank")


def hybrid_stemmed(spark, d):
    stops = stop_words()
    return retrieval.hybrid(_docs(spark, d), _queries(spark, d), DIM, terms=stemmed_terms(stops), analyze=lambda w: analyze(w, stops))


def bm25_operators(spark, d):
    """Every query's first two words as a phrase, its third required, its last excluded where it has four or more, the others as they are."""
    w = F.filter(F.split("query_text", r"[^\p{L}\p{N}]+"), lambda x: x != "")
    sign = F.transform(w, lambda x, i: F.when(i == 2, F.concat(F.lit("+"), x)).when((i >= 3) & (i == F.size(w) - 1), F.concat(F.lit("-"), x)).otherwise(x))
    phrase = F.concat(F.lit('"'), F.array_join(F.slice(w, 1, 2), " "), F.lit('" '))
    q = _queries(spark, d).withColumn("query_text", F.when(F.size(w) > 0, F.concat(phrase, F.array_join(F.slice(sign, 3, 2**31 - 4), " "))))
    return retrieval.top(retrieval.bm25_parsed(_docs(spark, d), q), q, F.col("k")).select("query_id", "id", "score", "rank")


def ann_topk(spark, d):
    """The queries' vectors among inverted lists, without filters."""
    index, book = ann.build(_docs(spark, d), DIM)
    # a share of the cells, so that recall doesn't fall as they grow in number
    return ann.search(index, book, _queries(spark, d), DIM, nprobe=max(8, len(book) // 12))


def vector_stats(spark, d):
    docs = _docs(spark, d)
    return docs.agg(F.count(F.lit(1)).alias("documents"), F.count_if(retrieval.valid_vector("vector", DIM)).alias("vectors"), F.count_if(F.col("vector").isNotNull() & ~retrieval.valid_vector("vector", DIM)).alias("refused"))


def causal_thread(spark, d):
    return causal.thread_nodes(_events(spark, d)).select("stream_id", "seq", "node", "text", "phase", "outcome", "caused_by")


def causal_links(spark, d):
    return causal.causal_links(_nodes(spark, d)).select("stream_id", "seq", F.concat_ws(",", F.col("caused").cast("array<string>")).alias("caused"))


def error_loops(spark, d):
    return causal.error_loops(_nodes(spark, d))


def objective_drift(spark, d):
    return causal.objective_drift(_nodes(spark, d))


def phase_summary(spark, d):
    return causal.phase_summary(_nodes(spark, d))


def harness_process_quality(spark, d):
    return causal.process_quality(_nodes(spark, d))


def root_cause(spark, d):
    return causal.root_causes(_nodes(spark, d))


def causal_anchors(spark, d):
    return causal.first_decisions(_nodes(spark, d))


def context_budget_prefix(spark, d):
    n = causal.thread_nodes(_events(spark, d)).where("node = 'decision'").withColumn("cost", context.token_cost("text", 20))
    return context.budget_prefix(n, ["stream_id"], ["seq"], "cost", 200).select("stream_id", "seq", "cost", "used")


def timeline_lines(spark, d):
    n = causal.thread_nodes(_events(spark, d)).where("node = 'decision'")
    return n.select("stream_id", "seq", context.one_line(F.col("text"), 24).alias("line"), F.size(context.overlap_words("text")).alias("words"))


def token_estimate(spark, d):
    return _docs(spark, d).select("id", context.token_cost(F.coalesce("body", F.lit("")), 20).alias("tokens"))


def consent_active_grants(spark, d):
    return projections.consent_grants(_events(spark, d))


def consent_authorized(spark, d):
    return consent.authorized(projections.consent_grants(_events(spark, d)), 1_746_000_000_000)


def latency_percentiles(spark, d):
    from mnemolake.functions.jsonx import raw, strict_uint

    c = _events(spark, d).where("kind_tag = 'ToolCall'").select(raw("payload", "$.tool").alias("tool"), strict_uint("payload", "latency_ms").alias("l")).where("l is not null and tool is not null")
    p = lambda q: F.expr(f"percentile_disc({q}) within group (order by l)").cast("bigint")
    return c.groupBy("tool").agg(p(0.5).alias("p50"), p(0.99).alias("p99"), F.count(F.lit(1)).alias("calls"))


def rate_windows(spark, d):
    """Records of each agent in the hour up to each record, by clock."""
    e = context.trailing_counts(_events(spark, d).select("agent_id", "seq", "ts_ms"), "agent_id", "ts_ms", 3_600_000)
    return e.select("agent_id", "seq", F.col("in_span").alias("in_hour"))


def idle_sessions(spark, d):
    e = _events(spark, d).select("stream_id", F.timestamp_millis("ts_ms").alias("ts"))
    s = e.groupBy("stream_id", F.session_window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return s.select("stream_id", F.unix_millis("w.start").alias("start_ms"), "events")


def recall_at_k(spark, d):
    """How many of each query's best documents, by exact search without filters, the approximate search finds."""
    return retrieval.recall_at_k(ann_topk(spark, d), vector_topk(spark, d))


_E = "cur as (select * exclude (rn) from (select *, row_number() over (partition by seq order by arrived_at desc) rn from event_log) where rn = 1)"
_X = "docs as (select * exclude (rn) from (select *, row_number() over (partition by id order by indexed_at desc) rn from index_docs) where rn = 1)"
_C = "cd as (select * exclude (rn) from (select *, row_number() over (partition by collection, id order by version desc, updated_at desc, doc desc) rn from collection_docs) where rn = 1)"
_A = ", ".join(f"'{a}'" for a in AGENTS)
_J = lambda f: f"json_extract_string(payload, '$.{f}')"
_ISERR = "coalesce(json_type(payload, '$.outcome') = 'OBJECT' and list_contains(json_keys(payload, '$.outcome'), 'Err'), false)"
_TAG = f"case when json_type(payload, '$.outcome') = 'VARCHAR' and {_J('outcome')} = 'Timeout' then 'Timeout' when {_ISERR} then 'Err' else 'Ok' end"
_MSG = "case when json_type(payload, '$.outcome.Err') = 'VARCHAR' then json_extract_string(payload, '$.outcome.Err') else '' end"
_HAS = "coalesce(list_contains(json_keys(payload), 'outcome'), false)"
_LAT = "case when json_type(payload, '$.latency_ms') in ('UBIGINT', 'BIGINT') and json_extract_string(payload, '$.latency_ms')::bigint >= 0 then json_extract_string(payload, '$.latency_ms')::bigint end"
_COST = "case when json_type(payload, '$.cost') in ('UBIGINT', 'BIGINT', 'DOUBLE') then json_extract_string(payload, '$.cost')::double end"


def _ledger_sql(where: str = "true", by: str = "") -> str:
    return f"""with {_E}, r as (select {by + ',' if by else ''} {_J('tool')} tool, seq, {_HAS} has, {_TAG} tag, {_MSG} msg, {_LAT} lat, {_COST} cost from cur where kind_tag = 'ToolCall' and {where})
      select {by + ',' if by else ''} tool, count(*) invocations, count(*) filter (has and tag <> 'Ok') errors{'' if by else ''', coalesce(sum(lat), 0)::bigint total_latency_ms, round(coalesce(sum(cost), 0), 6) total_cost,
        arg_max(case when has then case when tag = 'Err' then 'Err: ' || msg else tag end end, case when has then seq end) last_outcome'''}, max(seq) last_seq from r where tool is not null group by {by + ',' if by else ''} tool"""


_GONE = f"gone as (select agent_id a, try_cast({_J('target_seq')} as bigint) t, max(seq) s from cur where kind_tag = 'MemoryInvalidate' group by 1, 2)"
_N = f"""nodes as (select stream_id, seq, agent_id, causation caused_by, correlation,
      case kind_tag when 'StateTransition' then case when json_type(payload, '$.description') = 'VARCHAR' then 'decision' end when 'ToolCall' then 'call' else 'intent' end node,
      case kind_tag when 'StateTransition' then {_J('description')} when 'ToolCall' then coalesce({_J('tool')}, '') else {_J('intent')} end as text,
      case when kind_tag = 'StateTransition' and json_type(payload, '$.phase') = 'VARCHAR' then {_J('phase')} end phase,
      case when kind_tag = 'ToolCall' then {_TAG} end outcome, case when kind_tag = 'ToolCall' and {_ISERR} then {_MSG} end message
      from cur where kind_tag in ('StateTransition', 'ToolCall', 'IntentLogged')),
    n as (select * from nodes where node is not null)"""
_LOOPS = "loops as (select stream_id, text tool, message, count(*) repetitions from n where node = 'call' and outcome = 'Err' group by all having count(*) >= 3)"
_DRIFT = """intents as (select stream_id, min(seq) intent_seq, arg_min(struct_pack(c := correlation), seq).c c from n where node = 'intent' group by 1),
    drift as (select n.stream_id, intent_seq, count(*) repetitions from n join intents using (stream_id) where node = 'decision' and correlation is distinct from c group by all having count(*) >= 5)"""
_WALK = """w(stream_id, seq, pos, k) as (select stream_id, seq, seq, 0 from n where node = 'call' and outcome = 'Err'
      union all select w.stream_id, w.seq, p.caused_by, w.k + 1 from w join n p on p.stream_id = w.stream_id and p.seq = w.pos and p.node = 'call' where p.caused_by is not null and w.k < 2000),
    f as (select w.stream_id, w.seq, w.pos decision from w join n on n.stream_id = w.stream_id and n.seq = w.pos and n.node = 'decision')"""
_FT = "list_distinct(list_filter(list_transform(coalesce(filters, []), lambda x: x.field || chr(31) || x.value), lambda x: x is not null))"
_OKV = lambda a: f"{a}.vector is not null and len({a}.vector) = 32 and not list_contains(list_transform({a}.vector, lambda x: coalesce(isfinite(x), false)), false) and list_contains(list_transform({a}.vector, lambda x: x <> 0), true)"


def _cos_sql(filtered: bool, limit: str = "k", name: str = "ranked") -> str:
    have = f"and len(list_filter(q.want, lambda t: not list_contains(d.have, t))) = 0" if filtered else ""
    return f"""dv as (select id, vector::double[] v, {_FT} have from docs d where {_OKV('d')}),
      qv as (select query_id, k, vector::double[] v, {_FT} want from hybrid_queries q where {_OKV('q')}),
      vs as (select q.query_id, d.id, q.k, round(least(1, greatest(-1, list_cosine_similarity(q.v, d.v))), 6) score from qv q join dv d on true {have}),
      {name} as (select * from (select *, row_number() over (partition by query_id order by score desc, id) rank from vs) where rank <= {limit})"""


def _bm25_sql(boosts: dict[str, float], limit: str = "k", name: str = "tranked") -> str:
    words = lambda c: f"regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}]+')"
    fields = " union all ".join(f"select id, '{f}' field, {b}::double boost, {words(f)} w from docs" for f, b in boosts.items())
    return f"""fl as ({fields}),
      ml as (select field, avg(len(w)) mean from fl group by field),
      po as (select id, field, boost, term, count(*) tf, any_value(l) l from (select id, field, boost, unnest(w) term, len(w) l from fl) group by all),
      qt as (select distinct query_id, {_FT} want, unnest({words('query_text')}) term from hybrid_queries where length(trim(query_text)) > 0),
      dfs as (select term, field, count(*) df from po group by all),
      sc as (select q.query_id, po.id, q.want, sum(ln(1 + ((select count(*) from docs) - df + 0.5) / (df + 0.5)) * boost * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))) s
        from qt q join po using (term) join dfs using (term, field) join ml using (field) group by all),
      ts as (select sc.query_id, sc.id, round(s, 6) score, k from sc join (select id, {_FT} have from docs) d using (id) join hybrid_queries h on h.query_id = sc.query_id where len(list_filter(want, lambda t: not list_contains(have, t))) = 0),
      {name} as (select * from (select *, row_number() over (partition by query_id order by score desc, id) rank from ts) where rank <= {limit})"""


_TOKEN = lambda f: f"case json_type(doc, '$.{f}') when 'VARCHAR' then 's:' || json_extract_string(doc, '$.{f}') when 'BOOLEAN' then 'b:' || json_extract_string(doc, '$.{f}') when 'UBIGINT' then 'n:' || json_extract_string(doc, '$.{f}') when 'BIGINT' then 'n:' || json_extract_string(doc, '$.{f}') when 'DOUBLE' then 'n:' || json_extract_string(doc, '$.{f}') end"

ORACLES = {
    "log_stream_scan": f"with {_E} select seq, kind_tag, ts_ms, causation, correlation from cur where agent_id = '{AGENTS[0]}' and stream_id = '{STREAM}'",
    "log_multi_agent_scan": f"with {_E} select agent_id, seq, kind_tag, ts_ms from cur where agent_id in ({_A}) and stream_id = '{STREAM}'",
    "log_point_read": f"with {_E} select seq, agent_id, stream_id, kind_tag, payload from cur where seq = 17",
    "log_last_seq": "select max(s) last_seq, min(s) checkpoint from (select max(seq) s from event_log group by agent_id)",
    "facts_current": f"with {_E}, {_GONE} select agent_id, stream_id, seq from cur left join gone on a = agent_id and t = seq where kind_tag = 'Fact' and (s is null or s <= seq)",
    "facts_invalidated": f"with {_E}, {_GONE} select agent_id, stream_id, seq from cur join gone on a = agent_id and t = seq where kind_tag = 'Fact' and s > seq",
    "task_state_latest": f"with {_E} select agent_id, stream_id, max(seq) seq, arg_max(struct_pack(p := payload), seq).p state from cur where kind_tag = 'StateTransition' group by 1, 2",
    "tool_ledger": _ledger_sql(),
    "tool_stats_scoped": _ledger_sql(f"agent_id in ({_A})"),
    "tool_ledger_by_agent": _ledger_sql(by="agent_id"),
    "pattern_eq": f"with {_E} select seq, agent_id, stream_id from cur where kind_tag = 'StateTransition' and json_type(payload, '$.phase') = 'VARCHAR' and {_J('phase')} = 'plan'",
    "pattern_contains": f"with {_E} select seq, agent_id, stream_id from cur where kind_tag = 'IntentLogged' and json_type(payload, '$.intent') = 'VARCHAR' and contains({_J('intent')}, 'order')",
    "kind_histogram": f"with {_E} select agent_id, kind_tag, count(*) events, min(ts_ms) first_ts, max(ts_ms) last_ts from cur group by 1, 2",
    "collection_scan_page": f"with {_C} select id, version from cd where collection = 'threads' and id like 'thr:%' and id >= 'thr:1' order by id desc limit 25 offset 5",
    "collection_count": f"with {_C} select collection, count(*) documents from cd group by 1",
    "collection_find_by": f"with {_C} select id, version from cd where collection = 'threads' and json_type(doc, '$.thread_id') = 'VARCHAR' and json_extract_string(doc, '$.thread_id') = 'th-10'",
    "unique_violations": f"with {_C} select collection, {_TOKEN('thread_id')} token, count(*) documents from cd where {_TOKEN('thread_id')} is not null group by 1, 2 having count(*) > 1",
    "namespace_list": f"with {_C} select collection || '/' || regexp_split_to_array(id, '[:\\-]')[1] namespace, count(*) documents from cd group by 1",
    "doc_filter_and": f"with {_X} select id from docs where list_contains({_FT}, 'kind' || chr(31) || 'note') and list_contains({_FT}, 'lang' || chr(31) || 'en')",
    "filter_token_counts": f"with {_X}, t as (select id, unnest({_FT}) t from docs) select replace(t, chr(31), '=') token, count(*) documents from t group by 1",
    "batch_dedup_last_wins": f"with {_X} select id, name, len(coalesce(filters, []))::integer n_filters from docs",
    "vector_topk": f"with {_X}, {_cos_sql(False)} select query_id, id, score, rank::integer rank from ranked",
    "vector_topk_filtered": f"with {_X}, {_cos_sql(True)} select query_id, id, score, rank::integer rank from ranked",
    "bm25_topk": f"with {_X}, {_bm25_sql({'body': 1.0})} select query_id, id, score, rank::integer rank from tranked",
    "bm25_boosted_fields": f"with {_X}, {_bm25_sql(retrieval.BOOSTS)} select query_id, id, score, rank::integer rank from tranked",
    "hybrid_rrf": f"""with {_X}, {_bm25_sql(retrieval.BOOSTS, 'greatest(5 * k, 50)')}, {_cos_sql(True, 'greatest(5 * k, 50)')},
      kinds as (select query_id, k, coalesce(length(trim(query_text)) > 0, false) t, coalesce({_OKV('q')}, false) v from hybrid_queries q where k > 0),
      f as (select query_id, id, sum(1.0::double / (60 + rank)) rrf, min(rank) best, max(case when src = 't' then score end) t_score, max(case when src = 'v' then score end) v_score
        from (select query_id, id, score, rank, 't' src from tranked union all select query_id, id, score, rank, 'v' from ranked) group by 1, 2),
      s as (select query_id, id, k, best, round(case when t and v then rrf else coalesce(t_score, v_score) end, 6) score from f join kinds using (query_id))
      select query_id, id, score, rank::integer rank from (select *, row_number() over (partition by query_id order by score desc, best, id) rank from s) where rank <= k""",
    "vector_stats": f"with {_X} select count(*) documents, count(*) filter ({_OKV('d')}) vectors, count(*) filter (vector is not null and not ({_OKV('d')})) refused from docs d",
    "causal_thread": f"with {_E}, {_N} select stream_id, seq, node, text, phase, outcome, caused_by from n",
    "causal_links": f"""with {_E}, {_N}, kids as (select stream_id, caused_by seq, string_agg(seq::varchar, ',' order by seq) c from n where node <> 'intent' and caused_by is not null group by 1, 2)
      select n.stream_id, n.seq, coalesce(c, '') caused from n left join kids using (stream_id, seq) where node <> 'intent'""",
    "error_loops": f"with {_E}, {_N}, {_LOOPS} select * from loops",
    "objective_drift": f"with {_E}, {_N}, {_DRIFT} select * from drift",
    "phase_summary": f"with {_E}, {_N} select stream_id, phase, count(*) decisions, min(seq) first_seq, arg_min(text, seq) first_text from n where node = 'decision' group by 1, 2",
    "harness_process_quality": f"""with {_E}, {_N}, {_LOOPS}, {_DRIFT}, p as (select stream_id, sum(p) p from (select stream_id, least(repetitions, 5) * 0.2::double p from loops union all select stream_id, least(repetitions, 10) * 0.05::double from drift) group by 1)
      select s.stream_id, round(greatest(0, 1 - coalesce(p, 0)), 6) process_quality from (select distinct stream_id from n) s left join p using (stream_id)""",
    "causal_anchors": f"with recursive {_E}, {_N}, {_WALK} select stream_id, seq, decision from f",
    "root_cause": f"""with recursive {_E}, {_N}, {_WALK}, c as (select stream_id, decision, count(*) failures from f group by 1, 2)
      select stream_id, decision root_seq, failures from (select *, row_number() over (partition by stream_id order by failures desc, decision) rn from c) where rn = 1""",
    "context_budget_prefix": f"""with {_E}, {_N}, c as (select stream_id, seq, greatest(1, (strlen(text) + 20) // 4)::bigint cost from n where node = 'decision'),
      u as (select *, sum(cost) over (partition by stream_id order by seq)::bigint used from c) select * from u where used <= 200""",
    "timeline_lines": f"""with {_E}, {_N}, t as (select stream_id, seq, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) o from n where node = 'decision')
      select stream_id, seq, case when length(o) <= 24 then o else left(o, 23) || '…' end line, len(list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 2)))::integer words from t""",
    "token_estimate": f"with {_X} select id, greatest(1, (strlen(coalesce(body, '')) + 20) // 4)::bigint tokens from docs",
    "consent_active_grants": f"""with {_E}, r as (select try_cast({_J('grant_seq')} as bigint) g, max(seq) s from cur where kind_tag = 'ConsentRevoked' group by 1)
      select seq grant_seq, {_J('from')} grantor, {_J('to')} grantee, {_J('action')} action, {_J('resource')} resource, try_cast({_J('expires')} as bigint) expires from cur left join r on g = seq where kind_tag = 'ConsentGranted' and (s is null or s <= seq)""",
    "latency_percentiles": f"with {_E}, c as (select {_J('tool')} tool, {_LAT} l from cur where kind_tag = 'ToolCall') select tool, quantile_disc(l, 0.5)::bigint p50, quantile_disc(l, 0.99)::bigint p99, count(*) calls from c where l is not null and tool is not null group by 1",
    "rate_windows": f"with {_E} select agent_id, seq, count(*) over (partition by agent_id order by ts_ms range between 3600000 preceding and current row) in_hour from cur",
    "idle_sessions": f"""with {_E}, g as (select stream_id, ts_ms, case when ts_ms - lag(ts_ms) over (partition by stream_id order by ts_ms) < 86400000 then 0 else 1 end brk from cur),
      s as (select *, sum(brk) over (partition by stream_id order by ts_ms rows unbounded preceding) k from g) select stream_id, min(ts_ms) start_ms, count(*) events from s group by stream_id, k""",
}
ORACLES["consent_authorized"] = f"""with recursive {_E}, g as (select seq grant_seq, {_J('from')} grantor, {_J('to')} grantee, {_J('action')} action, {_J('resource')} resource, try_cast({_J('expires')} as bigint) expires
        from cur left join (select try_cast({_J('grant_seq')} as bigint) g, max(seq) s from cur where kind_tag = 'ConsentRevoked' group by 1) r on g = seq where kind_tag = 'ConsentGranted' and (s is null or s <= seq)),
      live as (select * from g where expires is null or expires > 1746000000000),
      h(grant_seq, grantee, action, resource) as (
        select l.grant_seq, l.grantee, l.action, l.resource from live l where not exists (select 1 from g where g.grantee = l.grantor and g.action = l.action and g.resource = l.resource)
        union select l.grant_seq, l.grantee, l.action, l.resource from live l join h on h.grantee = l.grantor and h.action = l.action and h.resource = l.resource)
      select grantee, action, resource, min(grant_seq) grant_seq from h group by 1, 2, 3"""

_FUNCTIONS = (
    log_stream_scan, log_multi_agent_scan, log_point_read, log_last_seq, facts_current, facts_invalidated, task_state_latest, tool_ledger, tool_stats_scoped, tool_ledger_by_agent,
    pattern_eq, pattern_contains, kind_histogram, collection_scan_page, collection_count, collection_find_by, unique_violations, namespace_list, doc_filter_and, filter_token_counts,
    batch_dedup_last_wins, vector_topk, vector_topk_filtered, bm25_topk, bm25_boosted_fields, hybrid_rrf, hybrid_stemmed, bm25_operators, ann_topk, vector_stats, causal_thread, causal_links, error_loops,
    objective_drift, phase_summary, harness_process_quality, root_cause, causal_anchors, context_budget_prefix, timeline_lines, token_estimate, consent_active_grants, consent_authorized,
    latency_percentiles, rate_windows, idle_sessions, recall_at_k,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}
