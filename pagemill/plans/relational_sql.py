"""SQL that checks the relational queries."""

from pagemill.plans import sqltext as S
from pagemill.plans.relational_queries import RULES

_RULES = ", ".join(f"('{p}', {str(a).lower()})" for p, a in RULES)
_EDGES = """(select 'n' || c_nationkey as src, 'c' || c_custkey as dst from customer union all select 'c' || o_custkey, 'o' || o_orderkey from orders
    union all select distinct 'o' || l_orderkey, 'p' || l_partkey from lineitem)"""

SQL = {
    "p1_criteria_search": r"""select doc_id, source, n_chars from documents where lang = 'en' and n_chars >= 200 and n_chars <= 3000
        and (source ilike '%\%\%\%%' escape '\' or text ilike '%\%\%\%%' escape '\')""",
    "p5_null_safe_lists": """select toxic is null as unlabelled, count(*) as n from documents left join labels using (doc_id)
        where toxic is null or toxic not in (1) group by 1""",
    "p7_status_ranges": "select o_orderkey, o_orderstatus from orders where o_totalprice between 50000 and 100000 and o_orderpriority like '1-%'",
    "p19_scopes": """select scope, count(*) as n, max(o_orderkey) as last_key from (
        select 'all' as scope, o_orderkey from orders union all select 'open', o_orderkey from orders where o_orderstatus = 'O'
        union all select 'finished', o_orderkey from orders where o_orderstatus = 'F' union all select 'large', o_orderkey from orders where o_totalprice >= 200000) group by 1""",
    "p20_export_gate": """select case when toxic = 1 then 'excluded' when quality is null then 'flagged' when quality = 1 then 'included' else 'excluded' end as decision,
        count(*) as n, count(*) filter (where quality = 1 and toxic = 1) as shut_by from documents left join labels using (doc_id) group by 1""",
    "p22_constraints": """select failed, count(*) as n from (select 'url_format' as failed from pages where not regexp_matches(url, '^https?://')
        union all select 'empty' from pages where length(trim(html)) = 0 union all select 'fragment' from pages where contains(url, '#')) group by 1""",
    "p25_robots_longest_match": f"""select page_id, path, coalesce((select allow from (values {_RULES}) r(p, allow) where starts_with(path, p)
        order by length(p) desc, allow desc limit 1), true) as allowed from (select page_id, {S.PATH} as path from pages)""",
    "j1_feed_join": """select o_orderkey, c_name, n_name from (select * from orders order by o_orderdate desc, o_orderkey desc limit 200)
        join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey""",
    "j2_best_child": """select o_orderkey as l_orderkey, best_line, top_lines from orders left join (
        select l_orderkey, min(l_linenumber) filter (where rn = 1) as best_line, string_agg(cast(l_linenumber as varchar), ',' order by rn) as top_lines
        from (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber) as rn from lineitem)
        where rn <= 5 group by 1) on o_orderkey = l_orderkey""",
    "j5_having_pending": """select c_custkey, c_name, count(*) as open_orders from orders join customer on o_custkey = c_custkey
        where o_orderstatus = 'O' group by 1, 2 having count(*) > 5""",
    "j11_override_precedence": """select doc_id, case when quality is not null then case when quality = 1 then 'FOUND' else 'NOT_FOUND' end
        when mostly then 'SHARED' else 'NEEDS_REVIEW' end as status,
        case when quality is not null then 'label' when mostly is not null then 'source' else 'default' end as decided_by
        from documents left join labels using (doc_id)
        left join (select source, avg(quality) >= 0.8 as mostly from documents join labels using (doc_id) group by 1) using (source)""",
    "j13_prefix_join": f"""select s.domain, s.branch, string_agg(distinct p.path, chr(10) order by p.path) as children
        from (select distinct {S.REGISTRABLE} as domain, coalesce({S.SEGMENTS}[1], '') as branch from pages) s
        join (select {S.REGISTRABLE} as domain, {S.PATH} as path from pages) p on s.domain = p.domain
        and (p.path = '/' || s.branch or starts_with(p.path, '/' || s.branch || '/')) group by 1, 2""",
    "j17_name_match": """with a as (select s_suppkey as id, 'n' || s_nationkey as word, 'n' || s_nationkey || case s_suppkey % 3 when 0 then '' when 1 then ' r' || n_regionkey else ' r9' end as name
        from supplier join nation on s_nationkey = n_nationkey),
        b as (select c_custkey as id, 'n' || c_nationkey as word, 'n' || c_nationkey || ' r' || n_regionkey as name from customer join nation on c_nationkey = n_nationkey),
        x as (select word, name, count(*) as n from a group by 1, 2), y as (select word, name, count(*) as n from b group by 1, 2),
        p as (select x.name as xn, y.name as yn, x.n as xc, y.n as yc from x join y on x.word = y.word and (x.name = x.word or x.name = y.name)),
        f as (select 'supplier' as side, xn as name, string_agg(yn, '; ' order by yn) as matches, sum(yc) as links from p group by 2
        union all select 'customer', yn, string_agg(xn, '; ' order by xn), sum(xc) from p group by 2),
        r as (select 'supplier' as side, id, name from a union all select 'customer', id, name from b)
        select r.side, r.id, r.name, coalesce(f.matches, '') as matches, coalesce(f.links, 0)::bigint as links from r left join f on r.side = f.side and r.name = f.name""",
    "j19_frontier_anti": f"""with p as (select page_id, url, {S.CANONICAL} as canonical from pages),
        done as (select url as alias from p where page_id % 3 = 0 union select canonical from p where page_id % 3 = 0)
        select page_id, canonical from p where not exists (select 1 from done where alias in (p.url, p.canonical))""",
    "a2_status_counts": """select o_orderpriority, o_orderstatus, count(*) as n, cast(sum(count(*)) over (partition by o_orderpriority) as bigint) as of_priority
        from orders group by 1, 2""",
    "a3_recount": """select c_custkey, (select count(*) from orders where o_custkey = c_custkey) as orders,
        (select count(*) from orders where o_custkey = c_custkey and o_orderstatus = 'F') as finished,
        (select count(distinct l_partkey) from orders join lineitem on l_orderkey = o_orderkey where o_custkey = c_custkey) as parts from customer""",
    "a6_filter_aggs": """select min(ts) as first_ts, max(ts) as last_ts, count(*) filter (where event_type = 'error') as errors,
        round(avg(value) filter (where event_type = 'purchase'), 6) as avg_purchase,
        round((select avg(c) from (select count(*) as c from events group by user_id)), 6) as avg_events from events""",
    "a8_weighted_remaining": """select c_mktsegment, queued, low, round(queued + low * 0.35, 2)::double as remaining from (
        select c_mktsegment, count(*) filter (where o_orderstatus = 'O') as queued,
        count(*) filter (where o_orderstatus = 'P' and o_totalprice < 100000) as low from orders join customer on o_custkey = c_custkey group by 1)""",
    "a9_trailing_rates": """select event_type, n, round(n / 10.0::double, 4) as per_day, round(n / sum(n) over ()::double, 6) as share from (
        select event_type, count(*) as n from events where ts > (select max(ts) - interval 10 days from events) group by 1)""",
    "a12_summary_rollup": """select coalesce(n_name, 'TOTAL') as n_name, count(*) as orders, count(*) filter (where o_orderstatus = 'F') as finished,
        count(*) filter (where o_totalprice > 200000) as large from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
        group by rollup (n_name)""",
    "a13_coverage_status": """select source, total, labelled, good, case when labelled = 0 then 'NO_DATA' when labelled = total then 'COMPLETE' else 'INCOMPLETE' end as state,
        total >= 30 and good / total < 0.35 as low from (select source, count(*) as total, count(quality) as labelled,
        count(*) filter (where quality = 1) as good from documents left join labels using (doc_id) group by 1)""",
    "a15_distinct_keys": f"select {S.SCHEME} as scheme, count(*) as pages, count(distinct {S.HOST}) as hosts, count(distinct {S.REGISTRABLE}) as domains from pages group by 1",
    "a22_funnel": """select n_name, count(distinct c_custkey) as customers, count(distinct o_custkey) as buyers, count(distinct o_orderkey) as orders, count(l_orderkey) as lines
        from customer join nation on c_nationkey = n_nationkey left join orders on o_custkey = c_custkey left join lineitem on l_orderkey = o_orderkey group by 1""",
    "a26_dataset_hash": """with rows as (select sha256(concat_ws(chr(31), cast(n_nationkey as varchar), n_name, cast(n_regionkey as varchar))) as h from nation),
        parts as (select substr(h, 1, 2) as p, sha256(string_agg(h, chr(10) order by h)) as h from rows group by 1)
        select sha256(string_agg(h, chr(10) order by p)) as dataset_hash from parts""",
    "t1_keyset_page": """select o_orderkey, o_orderdate, rn - 50 as place, (select count(*) from orders) > 100 as has_more from (
        select o_orderkey, o_orderdate, row_number() over (order by o_orderdate desc, o_orderkey desc) as rn from orders) where rn between 51 and 100""",
    "t4_tiers": """select o_orderkey, case when o_totalprice >= 250000 then 0 when o_totalprice >= 100000 then 1 else 2 end as tier from orders order by 2, 1 limit 100""",
    "u1_union_levels": """select level, name, n_name from (select 'customer' as level, c_name as name, c_nationkey as nation from customer
        union all select 'supplier', s_name, s_nationkey from supplier) join nation on nation = n_nationkey""",
    "u2_vocabulary": """select distinct lower(trim(w)) as word from (select unnest(string_split(p_type, ' ')) as w from part
        union all select unnest(string_split(p_name, ' ')) from part) where trim(w) <> ''""",
    "u3_except_keys": """select o_custkey from (select o_custkey from orders where o_orderkey % 2 = 0 except select o_custkey from orders where o_orderkey % 2 = 1)
        order by 1 limit 100""",
    "w3_running_index": """select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 as chunk_index,
        coalesce(bool_or(role = 'user') over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), false) as user_before,
        row_number() over (partition by conv_id order by turn desc) = 1 as is_last from conversations""",
    "w5_miss_counter": """with d as (select user_id, cast(ts as date) as day, bool_or(event_type = 'purchase') as hit from events group by 1, 2),
        r as (select *, count(*) filter (where hit) over (partition by user_id order by day) as island from d)
        select user_id, day, count(*) filter (where not hit) over (partition by user_id, island order by day) as misses from r""",
    "w6_rate_delta": """select bucket, n, n - lag(n) over (partition by bucket // 86400 order by bucket) as change from (
        select cast(floor(epoch(ts) / 1800) * 1800 as bigint) as bucket, count(*) as n from events group by 1)""",
    "k12_upsert": """with n as (select c_custkey * 2 as k, c_name || '*' as name from customer where c_custkey % 10 = 0)
        select coalesce(c_custkey, k) as c_custkey, coalesce(c_name, name) as c_name, case when k is not null then 'NEW' else c_mktsegment end as c_mktsegment
        from customer full join n on c_custkey = k""",
    "x4_reachability": f"""with recursive e as {_EDGES}, r as (select 'n' || n_nationkey as node, 0 as depth from nation where n_regionkey = 0
        union select dst, depth + 1 from r join e on src = node where depth < 3)
        select depth, substr(node, 1, 1) as kind, count(*) as nodes from (select node, min(depth) as depth from r group by 1) group by 1, 2""",
}
