"""Queries of the export's main path and of the sources and sinks round it."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import classify as C
from pagemill.functions import text as X
from pagemill.functions import urls
from pagemill.plans import sqltext as S
from pagemill.plans.source_queries import _place
from pagemill.sources import seeds, sheets, sinks, versions


def _t(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Host URLs are plain, so the gate is tried on them with these endings.
TAILS = (
    "/courses/bachelor-of-arts", "/international/courses/bachelor-of-arts/2024", "/courses", "/entry-requirements", "/research/labs", "/research-degree/admissions",
    "/courses/arts/degree-requirements", "/courses/arts/entry-requirements", "/admissions/home-students/apply", "/news/courses/new", "/how-to-apply", "/about", "/programs/law-llb", "/degrees/",
)
LINKS = f"""(select page_id, org, tail, 'https://' || org || tail as link, case when page_id % 13 = 0 then 'SCHOLARSHIP' else 'UNKNOWN' end as kind,
    case when page_id % 17 = 0 then 'For domestic students' end as title, case when page_id % 7 = 0 then 'SCHOLARSHIP' else 'ELIGIBILITY' end as context, page_id % 5 as score from (
    select page_id, {S.HOST} as org, ([{S.quoted(TAILS)}])[1 + page_id % {len(TAILS)}] as tail from pages))"""


def _links(spark, sf_dir) -> DataFrame:
    i = F.col("page_id")
    tail = F.element_at(F.array(*map(F.lit, TAILS)), (i % len(TAILS) + 1).cast("int"))
    return _t(spark, sf_dir, "pages").select(
        "page_id", urls.host(F.col("url")).alias("org"), F.concat(F.lit("https://"), urls.host(F.col("url")), tail).alias("link"),
        F.when(i % 13 == 0, "SCHOLARSHIP").otherwise("UNKNOWN").alias("kind"), F.when(i % 17 == 0, "For domestic students").alias("title"),
        F.when(i % 7 == 0, "SCHOLARSHIP").otherwise("ELIGIBILITY").alias("context"), (i % 5).alias("score"),
    )


def p14_row_gate(spark, sf_dir):
    """The level at which each link enters the export, or none."""
    return _links(spark, sf_dir).select("page_id", C.export_level(F.col("link"), F.col("kind"), F.col("title")).alias("level"))


def j8_gather(spark, sf_dir):
    """One pass over all organisations' links: gated, one row a course (the best link) or page, with its country."""
    rows = _links(spark, sf_dir).filter("context != 'SCHOLARSHIP'").withColumn("level", C.export_level(F.col("link"), F.col("kind"), F.col("title"))).filter("level is not null")
    rows = rows.withColumn("key", F.when(F.col("level") == "course", urls.feed_key(F.col("link"))).otherwise(F.lower("link")))
    best = rows.groupBy("org", "level", "key").agg(F.max_by("link", F.struct("score", -F.col("page_id"))).alias("link"), F.count("*").alias("links"))
    zones = spark.createDataFrame([("com", "generic"), ("net", "generic"), ("org", "organisation")], "zone string, country string")
    return best.withColumn("zone", F.element_at(F.split("org", r"\."), -1)).join(F.broadcast(zones), "zone", "left").select("org", "level", "key", "link", "links", "country")


def f16_feed_keys(spark, sf_dir):
    """F16: the key of each link in the feed."""
    return _links(spark, sf_dir).select("page_id", urls.feed_key(F.col("link")).alias("key"))


def f19_typed_addresses(spark, sf_dir):
    """origin and clean form of addresses as typed."""
    i, bare = F.col("page_id"), F.regexp_replace("url", "^https?://", "")
    typed = F.when(i % 4 == 0, F.concat(F.lit("  "), bare)).when(i % 4 == 1, F.concat(F.upper(F.substring_index("url", "/", 3)), F.lit("/"))).when(i % 4 == 2, F.col("url")).otherwise(F.lit(" "))
    return _t(spark, sf_dir, "pages").select("page_id", urls.origin_of(typed).alias("origin"), urls.normal_url(typed).alias("normal"))


def f20_official_scores(spark, sf_dir):
    """scores of hosts under several kinds of names."""
    i = F.col("page_id")
    zone = F.element_at(F.array(*map(F.lit, (".edu/", ".ac.uk/", ".edu.au/about/us", ".university.org", ".org/x"))), (i % 5 + 1).cast("int"))
    return _t(spark, sf_dir, "pages").select("page_id", urls.official_score(F.concat(F.lit("https://"), F.substring_index(urls.host(F.col("url")), ".", 1), zone)).alias("score"))


ANCHORS = ("Next", " 12 ", "Load  more", "About us", "the next of all the long anchors", "")


def c6_pagination(spark, sf_dir):
    """Links to further pages, by address or by words."""
    anchor = F.element_at(F.array(*map(F.lit, ANCHORS)), (F.col("page_id") % len(ANCHORS) + 1).cast("int"))
    return _t(spark, sf_dir, "pages").select("page_id", urls.is_pagination(F.col("url"), anchor).alias("paging"))


MARKS = ('<select name="x_length">', '<div class="Course-Finder">', "<a>View All</a>", "<p>plain</p>")


def d17_finders(spark, sf_dir):
    """Pages whose list scripts fill."""
    mark = F.element_at(F.array(*map(F.lit, MARKS)), (F.col("page_id") % len(MARKS) + 1).cast("int"))
    return _t(spark, sf_dir, "pages").select("page_id", C.is_finder(F.concat("html", mark)).alias("finder"))


# Where catalogues stand on a site, and the names under which they have hosts of their own.
PATHS = (
    "/courses", "/courses/", "/course-search", "/courses/search", "/study/courses", "/programmes", "/programs", "/degrees", "/find-a-course", "/find-a-programme", "/course-finder",
    "/programme-finder", "/degree-finder", "/study", "/study-options", "/undergraduate", "/postgraduate", "/course-index", "/a-z", "/courses/a-z",
)
CORE = ("/courses", "/course-search", "/programmes", "/programs", "/degrees", "/study", "/course-finder")
HOSTS = ("", "study.", "courses.", "handbook.", "programmes.", "catalogue.", "catalog.")
MOST = 80


def s20_candidates(spark, sf_dir):
    """The first 80 addresses where a host's catalogue may stand, in order and once."""
    host = urls.host(F.col("url"))
    bases = _t(spark, sf_dir, "pages").select(host.alias("host"), F.concat(F.lit("https://"), host).alias("base")).distinct()
    own = F.transform(F.array(*map(F.lit, PATHS)), lambda p: F.concat("base", p))
    others = F.filter(F.transform(F.array(*map(F.lit, HOSTS)), lambda s: F.concat(F.lit("https://"), s, urls.registrable_domain(F.col("host")))), lambda o: o != F.col("base"))
    core = F.flatten(F.transform(others, lambda o: F.transform(F.array(*map(F.lit, CORE)), lambda p: F.concat(o, p))))
    every = F.slice(F.array_distinct(F.concat(own, core)), 1, MOST)
    return bases.select("base", F.posexplode(every).alias("place", "candidate"))


SAMPLE = (
    "concat(case doc_id % 5 when 0 then 'A-levels: AAB*. ' when 1 then 'A level grades BBB. ' when 2 then 'Bachelor of Arts & Letters. ' when 3 then 'LLB (Hons). ' else 'Minimum IELTS 6.5. ' end, coalesce(text, ''))"
)


def g10_course_signals(spark, sf_dir):
    """A-level grades, course and criteria signals and the course named, over whole texts behind a sample line."""
    t, heading = F.col("line"), F.when(F.col("doc_id") % 10 == 7, F.lit(" Degree in Physics "))
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.expr(SAMPLE).alias("line"))
    return rows.select("doc_id", X.a_levels(t).alias("levels"), t.rlike(X.COURSE_NAME).alias("course"), X.has_any(t, X.CRITERIA).alias("criteria"), X.course_hint(t, heading).alias("hint"))


ERRORS = (
    "connect ECONNREFUSED 127.0.0.1:5432", "Can't reach database server", "Unique constraint failed P2002", "P2025", "foreign key violated", "PrismaClient blew up", "ioredis gone",
    "getaddrinfo ENOTFOUND x.org", "ECONNREFUSED", "socket hang up", "Navigation Timeout exceeded", "fetch failed", "self-signed certificate", "page.goto: Target closed",
    "ERR_TOO_MANY_REDIRECTS", "HTTP 429", "404 Not Found", "503 Service Unavailable", "EADDRINUSE", "ENOENT", "odd",
)


def g25_messages(spark, sf_dir):
    """Kinds of errors in a log."""
    message = F.element_at(F.array(*map(F.lit, ERRORS)), (F.col("event_id") % len(ERRORS) + 1).cast("int"))
    return _t(spark, sf_dir, "events").groupBy(C.message_class(message).alias("kind")).agg(F.count("*").alias("n"))


def k2_workbook(spark, sf_dir):
    """A workbook of a summary and rows with bands, written, read by sheet and filtered on its address column."""
    n = _t(spark, sf_dir, "nation")
    rows = n.select("n_name", F.when(F.col("n_nationkey") % 3 != 0, F.concat(F.lit("https://x.org/"), F.lower("n_name"))).otherwise(F.lit("none")).alias("url"), sheets.band(F.col("n_nationkey") / 25).alias("band"))
    path = f"{_place(spark)}/report.xlsx"
    sinks.write_bytes(spark, path, sinks.workbook({"Summary": rows.groupBy("band").agg(F.count("*").alias("n")), "Valid URLs": rows}))
    cells = sheets.read_xlsx(spark, path, "Valid URLs").select("cells")
    return cells.select(*[F.get("cells", i).alias(c) for i, c in enumerate(("n_name", "url", "band"))]).filter(F.col("url").rlike("(?i)^https?://"))


def k9_coverage_export(spark, sf_dir):
    """K8 K9: a stamped export of suppliers, read again."""
    path = _place(spark)
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.lit("2026-01-02 03:04:05").cast("timestamp").alias("at"))
    sinks.write_coverage(s.drop("at"), path, F.lit("2026-01-02 03:04:05").cast("timestamp"))
    return spark.read.option("header", True).option("escape", '"').schema("s_suppkey long, s_name string, last_checked string").csv(path)


def k10_split_sink(spark, sf_dir):
    """Orders split into confirmed and to review, and what each file holds."""
    path = _place(spark)
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")).alias("status"))
    sinks.write_split(o, path, F.col("status") == "F")
    read = lambda part: spark.read.option("header", True).schema("o_orderkey long, status string").csv(f"{path}/{part}").withColumn("part", F.lit(part))
    return read("verified").unionByName(read("review")).groupBy("part", "status").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("least"))


def k11_state_and_audit(spark, sf_dir):
    """State replaced as a whole and read again, JSON state that is broken or absent is empty, and the run's audit."""
    path = _place(spark)
    r, n = _t(spark, sf_dir, "region"), _t(spark, sf_dir, "nation")
    sinks.write_state(n, f"{path}/state")
    sinks.write_state(r.select(F.col("r_regionkey").alias("k"), "r_name"), f"{path}/state")
    r.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("v")).write.json(f"{path}/json")
    sinks.write_bytes(spark, f"{path}/broken", b"{not json")
    state = {"state": versions.read_version(spark, f"{path}/state"), "json": seeds.read_state(spark, f"{path}/json", "k long, v string")}
    state |= {"broken": seeds.read_state(spark, f"{path}/broken", "k long, v string"), "absent": seeds.read_state(spark, f"{path}/nothing", "k long, v string")}
    with contextlib.suppress(versions.StateConflict):  # a writer that started from the first version loses
        versions.write_version(n, f"{path}/state", based_on=1)
    state["kept"] = versions.read_version(spark, f"{path}/state", 1)
    return sinks.audit(state)


def k19_restore(spark, sf_dir):
    """A snapshot in JSON; what is there stays, the rest comes back."""
    path = _place(spark)
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_name")
    c.write.json(path)
    snapshot = spark.read.schema("c_custkey long, c_name string").json(path)
    present = c.filter("c_custkey % 3 = 0").withColumn("c_name", F.lit("kept"))
    return sinks.restore(snapshot.union(snapshot.filter("c_custkey < 50")), present, "c_custkey")


def k21_blobs(spark, sf_dir):
    """Pages kept under their host and the hash of their address; sections as JSON, or the plain text."""
    path = _place(spark)
    p = _t(spark, sf_dir, "pages")
    sections = F.when(F.col("page_id") % 3 != 0, F.to_json(F.array(F.struct(F.lit("h").alias("heading"), F.substring("url", 1, 20).alias("body"))))).when(F.col("page_id") % 2 == 0, F.lit("[broken"))
    p.select(urls.host(F.col("url")).alias("host"), urls.url_hash(F.col("url")).alias("hash"), "page_id", sections.alias("sections"), F.lit("flat").alias("flat")).write.partitionBy("host").parquet(path)
    back = spark.read.parquet(path)
    body = F.coalesce(F.from_json("sections", "array<struct<heading:string,body:string>>")[0]["body"], F.col("flat"))
    return back.select("page_id", F.substring("hash", 1, 12).alias("hash"), body.alias("body"))


def p4_log_filter(spark, sf_dir):
    """A user's log of chosen kinds since a day, newest first, and one entry by its key."""
    e = _t(spark, sf_dir, "events")
    log = e.filter((F.col("user_id") % 20 == 3) & F.col("event_type").isin("error", "purchase", "click") & (F.col("ts") >= F.lit("2024-01-02").cast("timestamp")))
    page = log.orderBy(F.desc("ts"), F.desc("event_id")).limit(100)
    return page.unionByName(e.filter("event_id = 7").limit(1)).select("event_id", "user_id", "event_type")


def j6_average_of_joined(spark, sf_dir):
    """Orders of finished customers with a price, counted by customer, then averaged by segment."""
    o = _t(spark, sf_dir, "orders").filter("o_totalprice > 50000 and o_orderstatus is not null").select("o_custkey")
    c = _t(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select("c_custkey", "c_mktsegment")
    counts = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", "c_custkey").agg(F.count("*").alias("n"))
    return counts.groupBy("c_mktsegment").agg(F.round(F.avg("n"), 6).alias("average"), F.count("*").alias("customers"))


def a27_vocabulary_hash(spark, sf_dir):
    """Words of a part's type merged with words of users, and the short hash of the lists."""
    own = _t(spark, sf_dir, "part").select(F.concat(F.lit("brand"), F.substring("p_brand", -2, 1)).alias("list"), F.explode(F.split("p_type", " ")).alias("word"))
    users = _t(spark, sf_dir, "nation").select(F.concat(F.lit("brand"), (F.col("n_regionkey") + 1).cast("string")).alias("list"), F.concat(F.lit(" "), F.lower("n_name")).alias("word"))
    words = own.unionByName(users).select("list", F.lower(F.trim("word")).alias("word")).filter("word != ''").distinct()
    lists = words.groupBy("list").agg(F.concat("list", F.lit(":"), F.array_join(F.sort_array(F.collect_list("word")), "|")).alias("line"), F.count("*").alias("n"))
    whole = lists.agg(F.substring(F.sha2(F.array_join(F.sort_array(F.collect_list("line")), "\n"), 256), 1, 12).alias("hash"))  # a row a list
    return lists.select("list", "n").join(F.broadcast(whole), F.lit(True))


LOG = "case when event_id % 3 = 0 then 'done ' || (event_id % 50) || ' / ' || 40 when event_id % 3 = 1 then 'file v1/2 read ' else 'part ' || (event_id % 7) || '/7' end"


def w7_progress(spark, sf_dir):
    """The last usable mark in each user's log, in per cent, and the seconds left at the rate so far (a mark a second)."""
    lines = _t(spark, sf_dir, "events").select("user_id", "event_id", F.expr(LOG).alias("line"))
    marks = seeds.progress(lines, "user_id", "event_id", "line")
    left = F.when(F.col("done") > 0, F.round((F.col("total") - F.col("done")) / (F.col("done") / 60.0)).cast("long"))
    return marks.select("user_id", "done", "total", F.round(100.0 * F.col("done") / F.col("total")).cast("long").alias("percent"), left.alias("seconds_left"))


def t8_drag_order(spark, sf_dir):
    """The place of each nation in its region's order by hand (first where there is one), then by age."""
    by_hand = F.when(F.col("n_nationkey") % 4 == 0, 100 - F.col("n_nationkey"))
    w = Window.partitionBy("n_regionkey").orderBy(F.asc_nulls_last("by_hand"), "n_nationkey")
    return _t(spark, sf_dir, "nation").withColumn("by_hand", by_hand).select("n_regionkey", "n_name", F.row_number().over(w).alias("place"))


def s7_bulk_ingest(spark, sf_dir):
    """Records from JSON arrays, one text a supplier; what is no array gives none; the address under any column named so."""
    text = F.when(F.col("s_suppkey") % 5 != 0, F.to_json(F.array(F.struct("s_suppkey", "s_name"), F.struct((-F.col("s_suppkey")).alias("s_suppkey"), F.lit("second").alias("s_name"))))).otherwise(F.lit("oops"))
    items = _t(spark, sf_dir, "supplier").select(F.explode(seeds.json_items(text, "s_suppkey:bigint,s_name:string")).alias("x")).select("x.*")
    odd = items.select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.lit(" ")).otherwise(F.col("s_name")).alias("Page URL"), F.concat(F.lit("u"), "s_name").alias("second_url"))
    return odd.select("s_suppkey", seeds.first_filled(odd, "url").alias("address"))


ALIASES = {"university": ("university", "universityname", "institution"), "country": ("country", "nation"), "course": ("course", "coursename")}


def s12_aliased_input(spark, sf_dir):
    """One file with aliased headers becomes institutions (first non-empty country, by name) and their course rows."""
    c = _t(spark, sf_dir, "customer")
    raw = c.select(
        F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).otherwise(F.lit(" ")).alias("University Name"), F.lower("c_mktsegment").alias("Institution"),
        F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("N"), F.col("c_nationkey"))).alias("Nation"), F.when(F.col("c_custkey") % 5 == 0, F.col("c_name")).alias("course_name"), "c_custkey",
    )
    rows = seeds.by_alias(raw, ALIASES | {"line": ("ccustkey",)}).withColumn("line", F.col("line").cast("long"))
    first = F.min_by("country", F.when(F.col("country").isNotNull(), F.col("line")))
    return rows.groupBy(F.lower("university").alias("university")).agg(first.alias("country"), F.count("course").alias("courses"), F.count("*").alias("lines"))


def s23_log_words(spark, sf_dir):
    """Lines of a log with each word, and the last hundred of them."""
    lines = _t(spark, sf_dir, "events").select("event_id", F.concat(F.upper("event_type"), F.lit(" by user "), "user_id").alias("value"))
    tail = lines.orderBy(F.desc("event_id")).limit(100).withColumn("part", F.lit("tail"))
    return seeds.log_counts(lines, ["click", "error", "user 1"]).withColumn("part", F.lit("all")).unionByName(seeds.log_counts(tail, ["click", "error", "user 1"]).withColumn("part", F.lit("tail")))


def s24_seeds(spark, sf_dir):
    """Fixed rows put in twice are there once, and rows that were there stay."""
    fixed = spark.createDataFrame([(i, f"seed {i}") for i in range(5)], "k long, name string")
    present = _t(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("k"), F.col("r_name").alias("name")).filter("k < 3")
    once = sinks.restore(fixed, present, "k")
    return sinks.restore(fixed, once, "k")


def e9_overrides(spark, sf_dir):
    """What a person has set counts before what a model has set, that before what was found."""
    p = _t(spark, sf_dir, "part").select("p_partkey", "p_brand")
    by_hand = p.filter("p_partkey % 7 = 0").select("p_partkey", F.lit("by hand").alias("hand"))
    by_model = p.filter("p_partkey % 3 = 0").select("p_partkey", F.concat(F.lit("model "), "p_brand").alias("model"))
    rows = p.join(by_hand, "p_partkey", "left").join(by_model, "p_partkey", "left")
    return rows.select("p_partkey", F.coalesce("hand", "model", "p_brand").alias("value"), F.when(F.col("hand").isNotNull(), "hand").when(F.col("model").isNotNull(), "model").otherwise("found").alias("source"))


LINK_PATH, LINK_KEY = "regexp_extract(link, '^https://[^/]+(.*)$', 1)", (
    r"""org || array_to_string(list_filter(string_split(replace(regexp_replace(lower(tail), '/$', ''), '/international/courses/', '/courses/'), '/'), lambda s: not regexp_matches(s, '^(19|20)[0-9]{2}$')), '/')"""
)
LEVEL = C.sql_export_level("link", LINK_PATH, "kind", "title")
TYPED = "case page_id % 4 when 0 then regexp_replace(url, '^https?://', '') when 1 then upper(array_to_string(list_slice(string_split(url, '/'), 1, 3), '/')) || '/' when 2 then url else '' end"
TYPED_FULL = "case when typed = '' then '' when regexp_matches(typed, '(?i)^https?://') then typed else 'https://' || typed end"
TYPED_ORIGIN = "lower(regexp_extract(full_form, '(?i)^(https?://[^/?#]+)', 1))"
QUERIES = {
    f.__name__: f
    for f in (
        p14_row_gate, j8_gather, f16_feed_keys, f19_typed_addresses, f20_official_scores, c6_pagination, d17_finders, s20_candidates, g10_course_signals, g25_messages, k2_workbook,
        k9_coverage_export, k10_split_sink, k11_state_and_audit, k19_restore, k21_blobs, p4_log_filter, j6_average_of_joined, a27_vocabulary_hash, w7_progress, t8_drag_order, s7_bulk_ingest,
        s12_aliased_input, s23_log_words, s24_seeds, e9_overrides,
    )
}


def _any(column: str, patterns) -> str:
    return "(" + " or ".join(f"regexp_matches({column}, '{p}')" for p in patterns) + ")"


RE2 = {X.BEFORE: "(?:^|[^A-Za-z0-9_])", X.AFTER: "(?:$|[^A-Za-z0-9_])"}


def _re2(pattern: str) -> str:
    """A pattern with the guards that DuckDB's engine knows (they use up the character beside a word)."""
    for guard, plain in RE2.items():
        pattern = pattern.replace(guard, plain)
    return pattern


SAMPLE_SQL = SAMPLE
SQL = {
    "p14_row_gate": f"select page_id, {LEVEL} as level from {LINKS}",
    "j8_gather": f"""select org, level, key, arg_max(link, score * 10000000000 - page_id) as link, count(*) as links,
        case split_part(org, '.', -1) when 'org' then 'organisation' when 'com' then 'generic' when 'net' then 'generic' end as country
        from (select *, case when level = 'course' then {LINK_KEY} else lower(link) end as key from (select *, {LEVEL} as level from {LINKS} where context <> 'SCHOLARSHIP') where level is not null) group by 1, 2, 3""",
    "f16_feed_keys": f"select page_id, {LINK_KEY} as key from {LINKS}",
    "f19_typed_addresses": rf"""select page_id, {TYPED_ORIGIN} as origin, case when full_form = '' then '' else regexp_replace({TYPED_ORIGIN} || case when regexp_matches(rest, '^[?#]') then '/' else '' end || rest, '/$', '') end as normal
        from (select page_id, full_form, regexp_replace(full_form, '(?i)^https?://[^/?#]*', '') as rest from (select page_id, {TYPED_FULL} as full_form from (select page_id, {TYPED} as typed from pages)))""",
    "f20_official_scores": rf"""select page_id, case when regexp_matches(u, '\.edu(/|$|\.)') then 50 else 0 end + case when regexp_matches(u, '\.ac\.[a-z][a-z](/|$)') then 50 else 0 end
        + case when regexp_matches(u, '\.edu\.[a-z][a-z](/|$)') then 45 else 0 end + case when regexp_matches(u, '//[^/]*university') then 12 else 0 end
        + case when regexp_matches(u, '^https://[^/]+/?$') then 12 else case when regexp_matches(u, '^https://[^/]+/[^/]+/?$') then 4 else 0 end end as score
        from (select page_id, 'https://' || split_part({S.HOST}, '.', 1) || (['.edu/', '.ac.uk/', '.edu.au/about/us', '.university.org', '.org/x'])[1 + page_id % 5] as u from pages)""",
    "c6_pagination": rf"""select page_id, {_any('url', urls.PAGE_LINKS)} or (length(words) between 1 and 16 and {_any('words', urls.PAGE_WORDS)}) as paging
        from (select page_id, url, trim(([{S.quoted(ANCHORS)}])[1 + page_id % {len(ANCHORS)}]) as words from pages)""",
    "d17_finders": f"""select page_id, regexp_matches(html || ([{S.quoted(MARKS)}])[1 + page_id % {len(MARKS)}], '{C.FINDER.replace("'", "''")}') as finder from pages""",
    "s20_candidates": f"""with b as (select distinct {S.HOST} as host, 'https://' || {S.HOST} as base, 'https://' as http, {S.REGISTRABLE} as domain from pages),
        own as (select base, i as o, base || ([{S.quoted(PATHS)}])[i] as candidate from b, range(1, {len(PATHS) + 1}) t(i)),
        other as (select base, 1000 * s + i as o, 'https://' || ([{S.quoted(HOSTS)}])[s] || domain || ([{S.quoted(CORE)}])[i] as candidate from b, range(1, {len(HOSTS) + 1}) x(s), range(1, {len(CORE) + 1}) t(i)
            where 'https://' || ([{S.quoted(HOSTS)}])[s] || domain <> base)
        select base, cast(place as int) as place, candidate from (select base, candidate, row_number() over (partition by base order by o) - 1 as place from (select base, candidate, min(o) as o from (select * from own union all select * from other) group by 1, 2)) where place < {MOST}""",
    "g10_course_signals": rf"""select doc_id, 'A-levels ' || nullif(regexp_extract(line, '{X.A_LEVELS}', 1), '') as levels, regexp_matches(line, '{_re2(X.COURSE_NAME)}') as course,
        regexp_matches(line, '{_re2(X.keyword_pattern(X.CRITERIA))}') as criteria, case when doc_id % 10 = 7 then 'Degree in Physics' else trim(nullif(regexp_extract(line, '{_re2(X.COURSE_HINT)}', 1), '')) end as hint
        from (select doc_id, {SAMPLE_SQL} as line from documents)""",
    "g25_messages": f"select {C.SQL_MESSAGE_CLASS} as kind, count(*) as n from (select ([{S.quoted(ERRORS)}])[1 + event_id % {len(ERRORS)}] as message from events) group by 1",
    "k2_workbook": """select n_name, 'https://x.org/' || lower(n_name) as url, case when n_nationkey / 25 < 0.6 then 'low' when n_nationkey / 25 < 0.8 then 'middle' else 'high' end as band from nation where n_nationkey % 3 <> 0""",
    "k9_coverage_export": "select s_suppkey, s_name, '2026-01-02T03:04:05Z' as last_checked from supplier",
    "k10_split_sink": """select case when status = 'F' then 'verified' else 'review' end as part, status, count(*) as n, min(o_orderkey) as least from (
        select o_orderkey, case when o_orderkey % 4 <> 0 then o_orderstatus end as status from orders) group by 1, 2""",
    "k11_state_and_audit": """select '{"absent":0,"broken":0,"json":' || count(*) || ',"kept":' || (select count(*) from nation) || ',"state":' || count(*) || '}' as audit from region""",
    "k19_restore": "select c_custkey, case when c_custkey % 3 = 0 then 'kept' else c_name end as c_name from customer",
    "k21_blobs": f"""select page_id, substr(sha256({S.CANONICAL}), 1, 12) as hash, case when page_id % 3 <> 0 then substr(url, 1, 20) else 'flat' end as body from pages""",
    "p4_log_filter": """select event_id, user_id, event_type from (select * from events where user_id % 20 = 3 and event_type in ('error', 'purchase', 'click') and ts >= timestamp '2024-01-02' order by ts desc, event_id desc limit 100)
        union all select event_id, user_id, event_type from events where event_id = 7""",
    "j6_average_of_joined": """select c_mktsegment, round(avg(n), 6) as average, count(*) as customers from (select c_mktsegment, c_custkey, count(*) as n from orders join customer on o_custkey = c_custkey
        where o_totalprice > 50000 and o_orderstatus is not null and c_custkey % 2 = 0 group by 1, 2) group by 1""",
    "a27_vocabulary_hash": """with w as (select distinct list, lower(trim(word)) as word from (select 'brand' || left(right(p_brand, 2), 1) as list, unnest(string_split(p_type, ' ')) as word from part
            union all select 'brand' || (n_regionkey + 1), ' ' || lower(n_name) from nation) where trim(word) <> ''),
        l as (select list, list || ':' || string_agg(word, '|' order by word) as line, count(*) as n from w group by 1)
        select list, n, (select substr(sha256(string_agg(line, chr(10) order by line)), 1, 12) from l) as hash from l""",
    "w7_progress": rf"""select user_id, done, total, cast(round(100.0 * done / total) as bigint) as percent, case when done > 0 then cast(round((total - done) / (done / 60.0)) as bigint) end as seconds_left from (
        select user_id, arg_max(done, event_id) as done, arg_max(total, event_id) as total from (select user_id, event_id, try_cast(regexp_extract(line, '(?:^|[^0-9A-Za-z_])([0-9]+)\s*/\s*([0-9]+)', 1) as bigint) as done,
        try_cast(regexp_extract(line, '(?:^|[^0-9A-Za-z_])([0-9]+)\s*/\s*([0-9]+)', 2) as bigint) as total from (select user_id, event_id, {LOG} as line from events)) where total > 0 and done <= total group by 1)""",
    "t8_drag_order": """select n_regionkey, n_name, row_number() over (partition by n_regionkey order by case when n_nationkey % 4 = 0 then 100 - n_nationkey end nulls last, n_nationkey) as place from nation""",
    "s7_bulk_ingest": """select k as s_suppkey, case when k % 2 = 0 then 'u' || name else name end as address from (select s_suppkey as k, s_name as name from supplier where s_suppkey % 5 <> 0
        union all select -s_suppkey, 'second' from supplier where s_suppkey % 5 <> 0)""",
    "s12_aliased_input": """select lower(c_mktsegment) as university, arg_min(case when c_custkey % 4 = 0 then 'N' || c_nationkey end, case when c_custkey % 4 = 0 then c_custkey end) as country,
        count(case when c_custkey % 5 = 0 then 1 end) as courses, count(*) as lines from customer group by 1""",
    "s23_log_words": """with l as (select lower(event_type || ' by user ' || user_id) as v, event_id from events), t as (select * from l order by event_id desc limit 100), w as (select unnest(['click', 'error', 'user 1']) as word)
        select word, count(*) as n, 'all' as part from l join w on contains(v, word) group by 1 union all select word, count(*), 'tail' from t join w on contains(v, word) group by 1""",
    "s24_seeds": "select cast(i as bigint) as k, coalesce(r_name, 'seed ' || i) as name from range(0, 5) t(i) left join region on r_regionkey = i and i < 3",
    "e9_overrides": """select p_partkey, case when p_partkey % 7 = 0 then 'by hand' when p_partkey % 3 = 0 then 'model ' || p_brand else p_brand end as value,
        case when p_partkey % 7 = 0 then 'hand' when p_partkey % 3 = 0 then 'model' else 'found' end as source from part""",
}
