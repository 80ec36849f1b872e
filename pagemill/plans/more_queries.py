"""Further queries: sequences, comparisons, upkeep, ordered rules, formats, dates, decision tables and running gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import text as X
from pagemill.functions import urls
from pagemill.operators import relational as R
from pagemill.plans import sqltext as S


def _t(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def w1_append_sequence(spark, sf_dir):
    """Suppliers of each nation appended after its customers' highest key."""
    top = _t(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.max("c_custkey").alias("top"))
    s = _t(spark, sf_dir, "supplier").join(F.broadcast(top), "s_nationkey", "left")
    place = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    return s.select("s_suppkey", (F.coalesce("top", F.lit(-1)) + place).alias("sort_order"))


def a17_attribution(spark, sf_dir):
    """Per domain the share of its pages on secure and on plain hosts."""
    u = F.col("url")
    rows = _t(spark, sf_dir, "pages").select(urls.registrable_domain(urls.host(u)).alias("domain"), (urls.scheme(u) == "https").alias("secure"), urls.host(u).rlike(r"^(www|m)\.").alias("front"))
    return rows.groupBy("domain").agg(F.round(F.avg(F.col("secure").cast("double")) * 100, 4).alias("secure_pct"), F.round(F.avg(F.col("front").cast("double")) * 100, 4).alias("front_pct"))


def a18_cube(spark, sf_dir):
    """Orders by status and priority, each alone, and in all."""
    rows = _t(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return rows.select(F.coalesce("o_orderstatus", F.lit("ALL")).alias("status"), F.coalesce("o_orderpriority", F.lit("ALL")).alias("priority"), "n")


def a21_compare(spark, sf_dir):
    """Two halves of the month compared, the change guarded against nothing to compare with."""
    early = F.dayofmonth("ts") <= 15
    rows = _t(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(early).alias("before"), F.count_if(~early).alias("after"), F.round(F.max("value"), 6).alias("top"))
    return rows.withColumn("change_pct", F.round((F.col("after") - F.col("before")) * 100 / F.nullif(F.col("before"), F.lit(0)), 4))


def a24_last_run(spark, sf_dir):
    """Counts by type of the last day only."""
    e = _t(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    last = e.agg(F.max("day").alias("day"))
    return e.join(F.broadcast(last), "day").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


def j12_named_lookup(spark, sf_dir):
    """Customers by the normal form of their nation's name, whether or not it is known."""
    norm = lambda c: F.lower(F.regexp_replace(F.trim(c), "[^A-Za-z0-9]+", "_"))
    n = _t(spark, sf_dir, "nation").select(norm("n_name").alias("key"), F.col("n_nationkey").alias("k"), "n_regionkey")
    c = _t(spark, sf_dir, "customer").join(F.broadcast(n.select("k", "key")), F.col("c_nationkey") == F.col("k"), "left").select("c_custkey", F.when(F.col("c_custkey") % 9 != 0, F.col("key")).alias("key"))
    return c.join(F.broadcast(n.select("key", "n_regionkey")), "key", "left").select("c_custkey", "n_regionkey")


def k17_align_feed(spark, sf_dir):
    """Large orders are promoted, the feed's others of the status demoted, the rest stays."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    exported = o.filter("o_totalprice > 150000").select("o_orderkey", F.lit(True).alias("exported"))
    rows = o.join(exported, "o_orderkey", "left")
    state = F.when(F.col("exported"), "VALIDATED").when(F.col("o_orderstatus") == "F", "DEMOTED").otherwise(F.col("o_orderstatus"))
    return rows.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def j21_skip_stopped(spark, sf_dir):
    """Customers that aren't stopped but have an order."""
    c, o = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders")
    stopped = c.filter("c_mktsegment = 'MACHINERY'").select("c_custkey")
    return R.missing_from(c, stopped, ["c_custkey"]).join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


def j24_host_probe(spark, sf_dir):
    """Each host with its number of pages and its first page as the probe."""
    u = F.col("url")
    rows = _t(spark, sf_dir, "pages").groupBy(urls.host(u).alias("host")).agg(F.count("*").alias("n"), F.min("page_id").alias("probe"))
    p = _t(spark, sf_dir, "pages").select(F.col("page_id").alias("probe"), F.length("html").cast("long").alias("size"))
    return rows.join(p, "probe").select("host", "n", "probe", "size")


def j26_fallback_rows(spark, sf_dir):
    """Of a customer's orders the urgent ones, or all where it has none."""
    o = _t(spark, sf_dir, "orders").withColumn("urgent", F.col("o_orderpriority").like("1-%"))
    kept = o.withColumn("n", F.count_if("urgent").over(Window.partitionBy("o_custkey"))).filter(F.col("urgent") | (F.col("n") == 0))
    return kept.groupBy("o_custkey").agg(F.count("*").alias("orders"))


def k16_cascade(spark, sf_dir):
    """Customers of one segment go with their orders; suppliers lose the link to a nation that goes."""
    c, o, s = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "supplier")
    gone = c.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    left = R.missing_from(o, gone, ["o_custkey"]).agg(F.lit("orders").alias("kind"), F.count("*").alias("n"))
    free = s.select(F.when(F.col("s_nationkey") >= 5, F.col("s_nationkey")).alias("k")).agg(F.lit("suppliers").alias("kind"), F.count("k").alias("n"))
    return left.unionByName(free)


def p8_pattern_filter(spark, sf_dir):
    """A pattern on the first address there is, in lower case."""
    address = F.lower(F.coalesce(F.when(F.col("page_id") % 2 == 0, F.upper("url")), F.col("url")))
    return _t(spark, sf_dir, "pages").filter(address.rlike("/(en|fr)/[0-9]*[05]([^0-9]|$)")).select("page_id")


def p18_fallback_status(spark, sf_dir):
    """An order works by its price where there is one in range, else by its status."""
    o = _t(spark, sf_dir, "orders")
    code = F.when(F.col("o_orderkey") % 3 != 0, (F.col("o_orderkey") % 5 + 1) * 100)
    works = F.when(code.isNotNull(), code.between(200, 399)).otherwise(F.col("o_orderstatus").isin("F", "P"))
    return o.groupBy(works.alias("works")).agg(F.count("*").alias("n"))


def g21_json_span(spark, sf_dir):
    """The braces within fenced answers, read with a schema; what isn't a record gives nothing."""
    raw = F.concat(F.lit("Here you are:\n```json\n"), F.when(F.col("event_id") % 4 != 0, F.to_json(F.struct("event_id", "event_type"))).otherwise(F.lit("{broken")), F.lit("\n```"))
    span = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    rec = F.from_json(span, "event_id long, event_type string")
    return _t(spark, sf_dir, "events").select("event_id", rec["event_type"].alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


def g23_formats(spark, sf_dir):
    """Safe names, quoted cells and sizes for people."""
    p = _t(spark, sf_dir, "part")
    safe = F.substring(F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]+", "_"), 1, 60)
    cell = F.concat(F.lit('"'), F.regexp_replace("p_type", '"', '""'), F.lit('"'))
    size = F.when(F.col("p_size") < 10, F.concat(F.col("p_size").cast("string"), F.lit(" B"))).otherwise(F.concat(F.floor(F.col("p_size") / 10).cast("string"), F.lit(" dB")))
    return p.select("p_partkey", safe.alias("safe"), cell.alias("cell"), size.alias("size"))


def d1_dates(spark, sf_dir):
    """Age of an order against the newest one, its label and stamp."""
    o = _t(spark, sf_dir, "orders")
    newest = o.agg(F.max("o_orderdate").alias("newest"))
    days = F.datediff("newest", "o_orderdate")
    label = F.when(days == 0, "today").when(days < 30, F.concat(days.cast("string"), F.lit("d"))).when(days < 365, F.concat(F.floor(days / 30).cast("string"), F.lit("mo"))).otherwise(F.concat(F.floor(days / 365).cast("string"), F.lit("y")))
    return o.join(F.broadcast(newest), F.lit(True)).select("o_orderkey", days.cast("long").alias("days"), label.alias("age"), F.date_format("o_orderdate", "yyyyMMdd").alias("stamp"))


def d4_arrays(spark, sf_dir):
    """Distinct, filtered, sorted and cut arrays of a conversation's roles and lengths."""
    t = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.length("text").alias("n")))).alias("a"))
    return t.select(
        "conv_id", F.array_join(F.array_sort(F.array_distinct(F.transform("a", lambda x: x["role"]))), ",").alias("roles"),
        F.size(F.filter("a", lambda x: x["n"] > 100)).cast("long").alias("long_turns"), F.array_join(F.slice(F.transform("a", lambda x: x["turn"].cast("string")), 1, 4), ",").alias("first_four"),
        F.exists("a", lambda x: x["role"] == "system").alias("has_system"), F.forall("a", lambda x: x["n"] > 0).alias("all_said"),
    )


def c21_decision_table(spark, sf_dir):
    """What to do with an order by a table of status and size."""
    table = spark.createDataFrame([("F", "small", "skip"), ("F", "large", "check"), ("O", "small", "wait"), ("O", "large", "fetch"), ("P", "large", "fetch")], "o_orderstatus string, size string, action string")
    o = _t(spark, sf_dir, "orders").withColumn("size", F.when(F.col("o_totalprice") > 150000, "large").otherwise("small"))
    rows = o.join(F.broadcast(table), ["o_orderstatus", "size"], "left")
    return rows.groupBy(F.coalesce("action", F.lit("none")).alias("action")).agg(F.count("*").alias("n"))


def x8_branch_gate(spark, sf_dir):
    """A customer's branch is dead after three orders without a finished one; orders that the gate turns away."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    o = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.count("*").over(w).alias("visits"), F.coalesce(F.max(F.col("o_orderstatus") == "F").over(w), F.lit(False)).alias("yielded"))
    return o.filter((F.col("visits") >= 3) & ~F.col("yielded")).select("o_orderkey", "visits")


def x15_first_success(spark, sf_dir):
    """The event at which a user has seen both a purchase and an error, and how many came after."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    both = F.max(F.col("event_type") == "purchase").over(w) & F.max(F.col("event_type") == "error").over(w)
    rows = _t(spark, sf_dir, "events").select("user_id", "event_id", "ts", both.alias("done"))
    return rows.filter("done").groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("at_event"), (F.count("*") - 1).alias("after"))


def x20_stalls(spark, sf_dir):
    """Silences of more than three hours of a user within its day."""
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    gap = F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lag("ts").over(w).cast("timestamp"))
    rows = _t(spark, sf_dir, "events").select("user_id", gap.alias("gap")).filter("gap > 10800")
    return rows.groupBy("user_id").agg(F.count("*").alias("stalls"), F.max("gap").alias("longest"))


def x1_dead_letters(spark, sf_dir):
    """Jobs once by id, their failures, and whether they are retried or put away."""
    jobs = _t(spark, sf_dir, "events").select((F.col("event_id") % 500).alias("job"), (F.col("event_type") == "error").alias("failed"), "event_id")
    rows = jobs.groupBy("job").agg(F.count_if("failed").alias("failures"), F.max_by("failed", "event_id").alias("last_failed"))
    state = F.when(~F.col("last_failed"), "done").when(F.col("failures") < 3, "retry").otherwise("dead")
    return rows.groupBy(state.alias("state")).agg(F.count("*").alias("jobs"))


def u6_token_sets(spark, sf_dir):
    """Parts whose names have the same words, in any order, are one class, named by its first part."""
    words = F.array_join(F.array_sort(F.array_distinct(F.split(F.concat_ws(" ", F.when(F.col("p_partkey") % 2 == 0, F.concat_ws(" ", "p_type", "p_name")).otherwise(F.concat_ws(" ", "p_name", "p_type"))), " "))), " ")
    p = _t(spark, sf_dir, "part").select("p_partkey", words.alias("words"))
    classes = p.groupBy("words").agg(F.min("p_partkey").alias("first_part"), F.count("*").alias("n"))
    return p.join(classes, "words").select("p_partkey", "first_part", "n")


QUERIES = {
    f.__name__: f
    for f in (
        w1_append_sequence, a17_attribution, a18_cube, a21_compare, a24_last_run, j12_named_lookup, j21_skip_stopped, j24_host_probe, j26_fallback_rows,
        k16_cascade, k17_align_feed, p8_pattern_filter, p18_fallback_status, g21_json_span, g23_formats,
        d1_dates, d4_arrays, c21_decision_table, x8_branch_gate, x15_first_success, x20_stalls, x1_dead_letters, u6_token_sets,
    )
}

_NORM = "lower(regexp_replace(trim(n_name), '[^A-Za-z]+', '_', 'g'))"
SQL = {
    "w1_append_sequence": """select s_suppkey, coalesce((select max(c_custkey) from customer where c_nationkey = s_nationkey), -1)
        + row_number() over (partition by s_nationkey order by s_suppkey) as sort_order from supplier""",
    "a17_attribution": f"""select {S.REGISTRABLE} as domain, round(avg(({S.SCHEME} = 'https')::int::double) * 100, 4) as secure_pct,
        round(avg(regexp_matches({S.HOST}, '^(www|m)\\.')::int::double) * 100, 4) as front_pct from pages group by 1""",
    "a18_cube": """select coalesce(o_orderstatus, 'ALL') as status, coalesce(o_orderpriority, 'ALL') as priority, count(*) as n from orders group by cube (o_orderstatus, o_orderpriority)""",
    "a21_compare": """select event_type, before, after, top, round((after - before) * 100 / nullif(before, 0)::double, 4) as change_pct from (select event_type,
        count(*) filter (where day(ts) <= 15) as before, count(*) filter (where day(ts) > 15) as after, round(max(value), 6) as top from events group by 1)""",
    "a24_last_run": "select event_type, count(*) as n, count(distinct user_id) as users from events where cast(ts as date) = (select max(cast(ts as date)) from events) group by 1",
    "j12_named_lookup": f"""with n as (select {_NORM} as key, n_nationkey, n_regionkey from nation)
        select c_custkey, case when c_custkey % 9 <> 0 then n_regionkey end as n_regionkey from customer left join n on c_nationkey = n_nationkey""",
    "j21_skip_stopped": "select c_custkey from customer where c_mktsegment <> 'MACHINERY' and exists (select 1 from orders where o_custkey = c_custkey)",
    "j24_host_probe": f"""select host, n, probe, length(html) as size from (select {S.HOST} as host, count(*) as n, min(page_id) as probe from pages group by 1)
        join pages on page_id = probe""",
    "j26_fallback_rows": """select o_custkey, case when count(*) filter (where o_orderpriority like '1-%') > 0 then count(*) filter (where o_orderpriority like '1-%')
        else count(*) end as orders from orders group by 1""",
    "k16_cascade": """select 'orders' as kind, count(*) as n from orders where o_custkey not in (select c_custkey from customer where c_mktsegment = 'BUILDING')
        union all select 'suppliers', count(*) from supplier where s_nationkey >= 5""",
    "k17_align_feed": "select case when o_totalprice > 150000 then 'VALIDATED' when o_orderstatus = 'F' then 'DEMOTED' else o_orderstatus end as state, count(*) as n from orders group by 1",
    "p8_pattern_filter": "select page_id from pages where regexp_matches(lower(url), '/(en|fr)/[0-9]*[05]([^0-9]|$)')",
    "p18_fallback_status": """select case when o_orderkey % 3 <> 0 then (o_orderkey % 5 + 1) * 100 between 200 and 399 else o_orderstatus in ('F', 'P') end as works,
        count(*) as n from orders group by 1""",
    "g21_json_span": "select case when event_id % 4 <> 0 then event_type end as kind, count(*) as n from events group by 1",
    "g23_formats": """select p_partkey, substr(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), 1, 60) as safe, '"' || replace(p_type, '"', '""') || '"' as cell,
        case when p_size < 10 then p_size || ' B' else (p_size // 10) || ' dB' end as size from part""",
    "d1_dates": """select o_orderkey, days, case when days = 0 then 'today' when days < 30 then days || 'd' when days < 365 then (days // 30) || 'mo' else (days // 365) || 'y' end as age,
        strftime(o_orderdate, '%Y%m%d') as stamp from (select *, date_diff('day', cast(o_orderdate as date), (select max(cast(o_orderdate as date)) from orders)) as days from orders)""",
    "d4_arrays": """select conv_id, string_agg(distinct role, ',' order by role) as roles, count(*) filter (where length(text) > 100) as long_turns,
        array_to_string(list_slice(list(cast(turn as varchar) order by turn, role, length(text)), 1, 4), ',') as first_four, bool_or(role = 'system') as has_system,
        bool_and(length(text) > 0) as all_said from conversations group by 1""",
    "c21_decision_table": """select case o_orderstatus when 'F' then case when o_totalprice > 150000 then 'check' else 'skip' end when 'O' then case when o_totalprice > 150000 then 'fetch'
        else 'wait' end when 'P' then case when o_totalprice > 150000 then 'fetch' else 'none' end else 'none' end as action, count(*) as n from orders group by 1""",
    "x8_branch_gate": """select o_orderkey, visits from (select o_orderkey, count(*) over w as visits, coalesce(bool_or(o_orderstatus = 'F') over w, false) as yielded from orders
        window w as (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and 1 preceding)) where visits >= 3 and not yielded""",
    "x15_first_success": """select user_id, arg_min(event_id, (ts, event_id)) as at_event, count(*) - 1 as after from (select user_id, event_id, ts,
        bool_or(event_type = 'purchase') over w and bool_or(event_type = 'error') over w as done from events
        window w as (partition by user_id order by ts, event_id)) where done group by 1""",
    "x20_stalls": """select user_id, count(*) as stalls, max(gap) as longest from (select user_id, cast(floor(epoch(ts)) - floor(epoch(lag(ts) over (partition by user_id, cast(ts as date)
        order by ts, event_id))) as bigint) as gap from events) where gap > 10800 group by 1""",
    "x1_dead_letters": """select case when not last_failed then 'done' when failures < 3 then 'retry' else 'dead' end as state, count(*) as jobs from (select event_id % 500 as job,
        count(*) filter (where event_type = 'error') as failures, arg_max(event_type = 'error', event_id) as last_failed from events group by 1) group by 1""",
    "u6_token_sets": """select p_partkey, min(p_partkey) over w as first_part, count(*) over w as n from (select p_partkey, list_sort(list_distinct(string_split(p_name || ' ' || p_type, ' '))) as words from part)
        window w as (partition by words)""",
}
