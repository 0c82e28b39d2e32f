"""The SQL that queries of this package are compared with."""

_DOCS = "docs as (select * exclude (rn) from (select *, row_number() over (partition by id order by indexed_at desc) rn from index_docs) where rn = 1)"

_CALLS = """cur as (select * exclude (rn) from (select *, row_number() over (partition by seq order by arrived_at desc) rn from event_log where kind_tag = 'ToolCall') where rn = 1),
    raw as (select seq, agent_id, stream_id, ts_ms, json_extract_string(payload, '$.tool') tool, json_type(payload, '$.outcome') ot, json_extract_string(payload, '$.outcome') os,
        json_type(payload, '$.outcome.Err') et, json_extract_string(payload, '$.outcome.Err') es from cur),
    keyed as (select seq, agent_id, stream_id, ts_ms, coalesce(regexp_replace(regexp_replace(lower(trim(tool)), '[\\s._\\-/:]+', '.', 'g'), '^\\.+|\\.+$', '', 'g'), 'seq ' || seq) tool,
        case when ot = 'VARCHAR' and os = 'Timeout' then 'Timeout' when ot = 'OBJECT' and et is not null then 'Err: ' || case when et = 'VARCHAR' then es else '' end else 'Ok' end o from raw),
    m1 as (select *, regexp_replace(lower(substr(o, 6)), '\\s+', ' ', 'g') m from keyed),
    m2 as (select *, regexp_replace(m, '''[^'']*''|"[^"]*"|`[^`]*`', '#', 'g') a from m1),
    m3 as (select *, regexp_replace(regexp_replace(regexp_replace(a, '=\\s*[^\\s,;)\\]}]+', '=#', 'g'), '(?:[a-z]:)?(?:/[\\w.\\-]+)+/?', '#', 'g'), '\\b[0-9a-f]{4,}(?:-[0-9a-f]{2,})+\\b', '#', 'g') b from m2),
    m4 as (select seq, agent_id, stream_id, ts_ms, tool, case when o like 'Err: %' then 'Err: ' || regexp_replace(trim(regexp_replace(b, '[\\w.+\\-:]*\\d[\\w.+\\-:%]*', '#', 'g')), '^[\\s.!?…]+|[\\s.!?…]+$', '', 'g') else o end outcome from m3),
    marked as (select *, case when tool is distinct from lag(tool) over w or outcome is distinct from lag(outcome) over w then 1 else 0 end brk from m4 window w as (partition by agent_id, stream_id order by seq)),
    grp as (select *, sum(brk) over (partition by agent_id, stream_id order by seq) g from marked)"""

_NEAREST = """v as (select id, vector::double[] v from docs where len(vector) = 32 and not list_contains(list_transform(vector, lambda x: coalesce(isfinite(x), false)), false) and list_contains(list_transform(vector, lambda x: x <> 0), true)),
        s as (select a.id, b.id near_id, round(list_cosine_similarity(a.v, b.v), 6) sim from v a join v b on a.id <> b.id),
        r as (select * from (select *, row_number() over (partition by id order by sim desc, near_id) rn from s) where rn <= 5)"""

ORACLES = {
    "p2_found": f"""with {_DOCS},
        big as (select id, body from docs where length(body) > 1000),
        lines as (select id, unnest(list_zip(string_split(body, chr(10)), range(1, len(string_split(body, chr(10))) + 1))) l, len(string_split(body, chr(10))) n from big),
        l2 as (select id, l[1] line, l[2] no, n, trim(l[1], ' ' || chr(9) || chr(13)) = '' blank from lines),
        l3 as (select *, case when not blank and coalesce(lag(blank) over w, true) then 1 else 0 end starts, coalesce(lead(blank) over w, true) ends from l2 window w as (partition by id order by no)),
        l4 as (select *, sum(starts) over (partition by id order by no) para from l3 where true),
        paras as (select id, para, sum(length(line)) + count(*) - 1 - sum(case when ends and no < n and line like '%' || chr(13) then 1 else 0 end) size from l4 where not blank group by id, para)
        select id, 0::integer para_no from big union all select id, para::integer from paras where size > 1000""",
    "p3_found": f"""with {_DOCS}, {_NEAREST} select distinct least(id, near_id) id_a, greatest(id, near_id) id_b from r""",
    "p3_neighbours": f"with {_DOCS}, {_NEAREST} select id, near_id, sim, rn::integer rank from r",
    "p4_found": f"with {_CALLS} select min(seq) first_seq, max(seq) last_seq from grp group by agent_id, stream_id, g having count(*) >= 3",
    "p4_runs": f"""with {_CALLS} select agent_id, stream_id, case when tool not like 'seq %' then tool end tool, arg_max(outcome, seq) outcome, min(seq) first_seq, max(seq) last_seq, count(*) n,
        max(coalesce(ts_ms, 0)) - min(coalesce(ts_ms, 0)) duration_ms from (select agent_id, stream_id, seq, tool, outcome, ts_ms, g from grp) group by agent_id, stream_id, g, tool""",
}
