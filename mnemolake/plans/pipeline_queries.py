"""Queries of the general data-processing problems: hot keys, hierarchies, changed records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.operators.hierarchy import all_descendants, descendants, hierarchy, paths
from mnemolake.operators.incremental import record_deltas
from mnemolake.operators.skew import heavy_keys, key_profile
from mnemolake.sources.tables import current_events, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_keys(table(spark, sf_dir, "event_log"), ["agent_id", "stream_id"], 0.02).select("field_name", "key_text")


def p1_agent_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_profile(current_events(table(spark, sf_dir, "event_log")), "agent_id")


def p1_stream_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_profile(current_events(table(spark, sf_dir, "event_log")), "stream_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hierarchy(table(spark, sf_dir, "event_log"), "seq", "causation")
    return h.where("depth >= 10 or depth = -1").select(F.col("node").alias("seq"), F.col("root").alias("root_seq"), "depth")


def p6_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paths(table(spark, sf_dir, "event_log"), "seq", "causation")
    return p.select(F.col("node").alias("seq"), F.concat_ws("/", F.col("path").cast("array<string>")).alias("path"))


def p6_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = descendants(paths(table(spark, sf_dir, "event_log"), "seq", "causation"))
    return d.select(F.col("ancestor").alias("seq"), F.col("node").alias("descendant_seq"), "distance")


def p6_all_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p6_descendants, with what is on rings or hangs below them, which the SQL of that query leaves out."""
    d = all_descendants(table(spark, sf_dir, "event_log"), "seq", "causation")
    return d.select(F.col("ancestor").alias("seq"), F.col("node").alias("descendant_seq"), "distance")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_deltas(table(spark, sf_dir, "event_log"), table(spark, sf_dir, "projection_runs")).select("projection", "seq")


_CURRENT = "cur as (select * exclude (rn) from (select *, row_number() over (partition by seq order by arrived_at desc) rn from event_log) where rn = 1)"
_ERR = "json_type(payload, '$.outcome') = 'OBJECT' and list_contains(json_keys(payload, '$.outcome'), 'Err')"


def _profile_sql(field: str) -> str:
    return f"""with {_CURRENT},
    r as (select {field} key_text, seq, kind_tag, payload,
      kind_tag = 'ToolCall' and coalesce(json_extract_string(payload, '$.outcome') = 'Timeout' or ({_ERR}), false) err,
      case when kind_tag = 'ToolCall' and json_type(payload, '$.latency_ms') in ('UBIGINT', 'BIGINT') then try_cast(json_extract_string(payload, '$.latency_ms') as bigint) end lat0 from cur),
    q as (select *, case when lat0 >= 0 then lat0 end lat from r),
    m as (select *, sum(lat) over (partition by key_text) s, count(lat) over (partition by key_text) c from q)
    select key_text, count(*) events, max(seq) last_seq, arg_max(case when kind_tag = 'StateTransition' then struct_pack(p := payload) end, case when kind_tag = 'StateTransition' then seq end).p latest_state,
      count(*) filter (kind_tag = 'ToolCall') tool_calls, count(*) filter (err) tool_errors, coalesce(sum(lat), 0)::bigint latency_ms, count(*) filter (lat * c > 2 * s) slow_calls from m group by key_text"""


_NODES = "n as (select seq, max(causation) causation from event_log where seq is not null group by seq)"
_TREE = f"""recursive {_NODES},
    t(seq, root_seq, depth, path) as (
      select n.seq, n.seq, 0::bigint, n.seq::varchar from n left join n p on p.seq = n.causation where p.seq is null
      union all
      select c.seq, t.root_seq, t.depth + 1, t.path || '/' || c.seq::varchar from t join n c on c.causation = t.seq)"""

QUERIES = {f.__name__: f for f in (p1_found, p1_agent_profile, p1_stream_profile, p6_found, p6_paths, p6_descendants, p6_all_descendants, p7_found)}

ORACLES = {
    "p1_found": """select 'agent_id' field_name, agent_id key_text from event_log where agent_id is not null group by 2 having count(*) >= 0.02 * (select count(*) from event_log)
        union all select 'stream_id', stream_id from event_log where stream_id is not null group by 2 having count(*) >= 0.02 * (select count(*) from event_log)""",
    "p1_agent_profile": _profile_sql("agent_id"),
    "p1_stream_profile": _profile_sql("stream_id"),
    "p6_found": f"""with {_TREE},
        u as (select n.seq, n.causation from n where n.seq not in (select seq from t)),
        w(seq, pos, k) as (select seq, seq, 0 from u union all select w.seq, u.causation, w.k + 1 from w join u on u.seq = w.pos where w.k < 2 * (select count(*) from u)),
        r as (select seq, min(pos) root_seq from w where k >= (select count(*) from u) group by seq)
        select seq, root_seq, depth from t where depth >= 10 union all select seq, root_seq, -1 from r""",
    "p6_paths": f"with {_TREE} select seq, path from t",
    "p6_descendants": f"""with recursive {_NODES}, a(seq, descendant_seq, distance) as (
        select causation, seq, 1::bigint from n where causation in (select seq from n) union all
        select p.causation, a.descendant_seq, a.distance + 1 from a join n p on p.seq = a.seq where p.causation in (select seq from n) and a.distance < 5000),
        t(seq) as (select n.seq from n left join n p on p.seq = n.causation where p.seq is null union all select c.seq from t join n c on c.causation = t.seq)
        select seq, descendant_seq, distance from a where descendant_seq in (select seq from t)""",
    "p7_found": """with m as (select projection, max(read_until) filter (status = 'ok') mark from projection_runs where projection is not null group by 1),
        e as (select *, row_number() over (partition by seq order by arrived_at desc) rn from event_log),
        now as (select * from e where rn = 1),
        o as (select m.projection, e.*, row_number() over (partition by m.projection, e.seq order by e.arrived_at desc) r2 from e join m on e.arrived_at <= m.mark where e.seq in (select seq from event_log group by 1 having count(*) > 1)),
        old as (select * from o where r2 = 1),
        one as (select m.projection, e.seq from e join m on m.mark is null or e.arrived_at > m.mark where e.seq in (select seq from event_log group by 1 having count(*) = 1)),
        canon as (select x.projection, x.seq, x.payload from old x)
        select projection, seq from one
        union all
        select m.projection, now.seq from now join m on true left join old on old.projection = m.projection and old.seq = now.seq
          where now.seq in (select seq from event_log group by 1 having count(*) > 1)
            and (old.seq is null or old.correlation is distinct from now.correlation
              or (select list_sort(list((fullkey, type, atom))) from (select fullkey, type, case when type in ('OBJECT', 'ARRAY') then null else value::varchar end atom from json_tree(old.payload)))
                 is distinct from
                 (select list_sort(list((fullkey, type, atom))) from (select fullkey, type, case when type in ('OBJECT', 'ARRAY') then null else value::varchar end atom from json_tree(now.payload))))""",
}
