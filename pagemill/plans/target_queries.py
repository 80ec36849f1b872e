"""Queries over what pages are good for: targets, scholarships, the feed, the main page of an institution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import admission, courses
from pagemill.functions import targets as T
from pagemill.functions import text as X
from pagemill.functions import urls
from pagemill.plans import sqltext as S
from pagemill.plans.text_queries import _HTML

#: Host pages say nothing about courses, so each gets a class, a sentence and a path of those that such pages have, by its number.
CLASSES = ("COURSE_PAGE", "SCHOLARSHIP_PAGE", "COURSE_LISTING", "FUNDING_PAGE", "NAVIGATION_PAGE", "COURSE_PAGE", "ELIGIBILITY_PAGE", "SCHOLARSHIP_PAGE", "OTHER")
SAYS = (
    "Bachelor of Science. Entry requirements: IELTS 6.5.", "Course structure and duration of the modules.", "For domestic students only.", "",
    "The scholarship has a deadline. Another bursary is here; every scholarship counts.", "Scholarship, then a scholarship again.", "Master of Arts, full-time on campus.",
)
PATHS = (
    "/courses/x/entry-requirements", "/scholarships/named-award", "/scholarships/international", "/news/scholarship", "/scholarships/fees", "/scholarship/login",
    "/domestic/admissions", "/international/how-to-apply", "/find/scholarship-of-merit", "/tag/scholarship-a", "/international/entry-requirements",
)


def _pages(spark, sf_dir) -> DataFrame:
    pick = lambda found: F.element_at(F.array(*map(F.lit, found)), (F.col("page_id") % len(found)).cast("int") + 1)
    base = F.concat(urls.scheme(F.col("url")), F.lit("://"), urls.host(F.col("url")))
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select(
        "page_id", F.concat(base, pick(PATHS)).alias("url"), pick(CLASSES).alias("class"), F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title"),
        F.concat(pick(SAYS), F.lit(" "), X.html_text(F.col("html"))).alias("text"), (F.col("page_id") % 4 == 0).alias("anchor"), (F.col("page_id") % 2).alias("facts"),
    )


def c9_validate_target(spark, sf_dir):
    """What each page is as a target of requirements and as one of funding, with the reason and how sure it is."""
    c = F.col
    course = T.course_target(c("class"), c("title"), c("text"), c("anchor"), c("facts"))
    funding = T.scholarship_target(c("class"), c("url"), c("title"), c("text"))
    rows = _pages(spark, sf_dir).select("page_id", course.alias("c"), funding.alias("f"))
    return rows.select("page_id", *[F.col(f"{k}.{x}").alias(f"{n}_{x}") for k, n in (("c", "course"), ("f", "funding")) for x in ("outcome", "reason", "confidence")], F.col("c.identity").alias("identity"), (F.length("c.evidence") > 0).alias("has_evidence"))


def p16_ordered_reasons(spark, sf_dir):
    """Why an address is no scholarship, whether the page has substance, and whether the feed shows it."""
    url = F.col("url")
    return _pages(spark, sf_dir).select(
        "page_id", T.no_scholarship(url).alias("reason"), T.has_substance(F.col("text")).alias("substance"), T.shown_in_feed(url, F.col("title"), urls.path(url).contains("scholarship")).alias("shown"),
    )


def c18_main_page(spark, sf_dir):
    """Of each host the main page of requirements, and its rank."""
    rows = T.main_pages(_pages(spark, sf_dir).withColumn("host", urls.host(F.col("url"))), "host", "url", "anchor")
    return rows.select("host", "main_page", T.main_page_rank(F.col("main_page")).cast("long").alias("rank"))


#: Addresses and titles of courses, dealt to pages by their number; the title None is the page's own.
COURSES = (
    "/courses/bsc-nursing-and-midwifery", "/course/MGM102/2/2026", "/courses/master-teaching-primary.html", "/courses", "/courses/undefined/4408HO01", "/ug/yacht-beng/2026",
    "/course/course-changes/application-for-intermission.html", "/courses/marine_biology/entry-requirements", "/en/study/abroad", "/course/245ja.pdf", "/programs/12/345",
)
TITLES = (
    "Nursing 2026 entry | Some University", "Bachelor of Teaching - Site", "", "Page not found", "Master of Arts online study", "AB", "MBA full-time | x",
)


def g4_course_names(spark, sf_dir):
    """Whether each address is one course's page, its name by the address, and by title and address together."""
    n, pick = F.col("page_id"), lambda found: F.element_at(F.array(*map(F.lit, found)), (F.col("page_id") % len(found)).cast("int") + 1)
    own = F.concat(urls.scheme(F.col("url")), F.lit("://"), urls.host(F.col("url")), pick(COURSES))
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select(n, own.alias("url"), F.when(n % 8 != 7, pick(TITLES)).otherwise(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)).alias("title"))
    u = F.col("url")
    return rows.select("page_id", courses.is_real_course(u).alias("is_course"), courses.name_from_url(u).alias("by_address"), courses.award_group(F.lower(u)).alias("award"), courses.course_name(F.col("title"), u).alias("name"))


def f21_candidate_urls(spark, sf_dir):
    """where the requirements of each page may stand, all candidates in order; half of the pages end in .html."""
    own = F.concat(F.regexp_replace("url", r"(\.html)?([?#].*)?$", ""), F.when(F.col("page_id") % 2 == 0, ".html").otherwise("/"), F.lit("?x=1"))
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.posexplode(admission.requirement_candidates(own)).alias("position", "candidate"))
    return rows.withColumn("position", F.col("position").cast("long"))


#: Relative links of all kinds, put on each page beside its own.
LINKS = ("../up", "?q=1", "//other.org/p", "x/./y", "#here", "mailto:a@b.org", "/root//a/../b")


def f6_resolved_links(spark, sf_dir):
    """The links of each page, resolved against it; links to no page are left out."""
    hrefs = F.concat(F.expr("regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)"), F.array(*map(F.lit, LINKS)))
    links = F.transform(F.array_distinct(hrefs), lambda h: F.struct(h.alias("href"), urls.resolve(h, F.col("url")).alias("link")))
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.explode(links).alias("l"))
    return rows.select("page_id", "l.href", "l.link").filter("link is not null")


def _links(spark, sf_dir) -> DataFrame:
    """Pages as links: class, disposition, depth and permission by their numbers; some addresses stand twice, some have years."""
    n = F.col("page_id")
    url = F.when(n % 6 == 5, F.concat(F.lit("https://same.org/courses/"), (n % 4).cast("string"))).when(n % 3 == 0, F.concat(F.regexp_replace("url", "/[^/]*$", ""), F.lit("/"), (F.lit(2015) + n % 7).cast("string"), F.lit("/about"))).otherwise(F.col("url"))
    return _pages(spark, sf_dir).select("page_id", "class").join(
        spark.read.parquet(f"{sf_dir}/pages.parquet").select(n, url.alias("url"), F.when(n % 10 == 0, "EXTRACT").otherwise("SKIP").alias("disposition"), (n % 4).alias("depth"), (n % 11 != 3).alias("allowed")), "page_id"
    )


def x5_admission(spark, sf_dir):
    """The step at which each link is turned away, or that it is queued."""
    return admission.admitted_links(_links(spark, sf_dir))


def c21_fast_fetch(spark, sf_dir):
    """Whether a plain fetch of each page does, by a status and a challenge dealt by its number and its text's length."""
    n = F.col("page_id")
    status = F.element_at(F.array(*map(F.lit, (200, 403, 404, 301, 503, 200))), (n % 6).cast("int") + 1)
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", admission.fast_enough(n % 13 != 0, status, n % 17 == 1, F.length(X.html_text(F.col("html")))).alias("slow_because"))


QUERIES = {f.__name__: f for f in (c9_validate_target, p16_ordered_reasons, c18_main_page, g4_course_names, f21_candidate_urls, f6_resolved_links, x5_admission, c21_fast_fetch)}


def _words(col: str, words: tuple[str, ...]) -> str:
    found = "|".join(w.replace("'", "''").replace(" ", "[\\s_-]?") for w in sorted(words, key=lambda w: (-len(w), w)))
    return f"regexp_matches({col}, '(?i)\\b(?:{found})\\b')"


def _like(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, '{pattern.replace(chr(39), chr(39) * 2)}')"


def _pick(found: tuple[str, ...]) -> str:
    return "list_extract([" + ", ".join("'" + x.replace("'", "''") + "'" for x in found) + f"], (page_id % {len(found)} + 1)::int)"


_PAGES = f"""(select *, {S.HOST} as host, regexp_extract(url, '^https?://[^/]+(.*)$', 1) as path from (select page_id, {S.SCHEME} || '://' || {S.HOST} || {_pick(PATHS)} as url, {_pick(CLASSES)} as class,
    regexp_extract(html, '(?is)<title>(.*?)</title>', 1) as title, {_pick(SAYS)} || ' ' || {_HTML} as text, page_id % 4 = 0 as anchor, page_id % 2 as facts from pages))"""
_NO = f"""case when {_like("lower(url)", T.NOISE)} then 'file, news or event' when {_like("lower(url)", T.JUNK)} then 'login or search' when {_like("path", T.BLOG_PATH)} or {_like("host", T.BLOG_HOST)}
    then 'article' when {_like("path", T.FEES)} then 'fees' when {_like("path", T.CONTAINER)} then 'listing' end"""
_GENERAL = " ".join(f"when class = '{k}' then ['DISCOVERY_ONLY', '{v}', '0.3']" for k, v in T.GENERAL.items())
_COUNT = f"len(regexp_extract_all(text, '(?i)\\b(?:{'|'.join(w.replace(chr(39), chr(39) * 2).replace(' ', '[' + chr(92) + 's_-]?') for w in sorted(T.FUNDING, key=lambda w: (-len(w), w)))})\\b'))"
_COURSE = f"""case when class in ('SCHOLARSHIP_PAGE', 'SCHOLARSHIP_LISTING', 'FUNDING_PAGE') then ['REJECTED', 'scholarship page', '0'] when residents then ['DISCOVERY_ONLY', 'for residents only', '0.2']
    when class = 'COURSE_PAGE' and not (award or structure + detail >= 2) then ['DISCOVERY_ONLY', 'no course identity', '0.2'] when class = 'COURSE_PAGE' and evidence then ['VALIDATED_TARGET', 'requirements in the text', '0.9']
    when class = 'COURSE_PAGE' and anchor then ['VALIDATED_TARGET', 'requirements behind an anchor', '0.7'] when class = 'COURSE_PAGE' then ['DISCOVERY_ONLY', 'no requirements', '0.4'] {_GENERAL} else ['REJECTED', 'irrelevant', '0'] end"""
_FUNDING = f"""case when class in ('COURSE_PAGE', 'COURSE_LISTING', 'ELIGIBILITY_PAGE', 'ADMISSIONS_PAGE', 'INTERNATIONAL_ADMISSIONS_PAGE') then ['REJECTED', 'course page', '0']
    when residents then ['DISCOVERY_ONLY', 'for residents only', '0.2'] when class = 'SCHOLARSHIP_PAGE' and no_record is not null then ['DISCOVERY_ONLY', 'no scholarship: ' || no_record, '0.2']
    when class = 'SCHOLARSHIP_PAGE' and lower(trim(title)) in ({S.quoted(T.NO_NAMES)}) then ['DISCOVERY_ONLY', 'label of a category', '0.2']
    when class = 'SCHOLARSHIP_PAGE' and hits >= 2 and named then case when substance then ['VALIDATED_TARGET', 'scholarship in the text', '0.85'] else ['DISCOVERY_ONLY', 'no substance', '0.3'] end
    when class = 'SCHOLARSHIP_PAGE' then ['DISCOVERY_ONLY', 'too little about funding', '0.3'] when class = 'FUNDING_PAGE' then ['DISCOVERY_ONLY', 'scholarship listing', '0.3']
    when class = 'NAVIGATION_PAGE' then ['DISCOVERY_ONLY', 'navigation page', '0.3'] else ['REJECTED', 'irrelevant', '0'] end"""
_RANK = "case " + " ".join(f"when {_like('lower(url)', p)} then {len(T.MAIN_PAGES) - i}" for i, p in enumerate(T.MAIN_PAGES)) + " else 0 end"


def _course_sql() -> str:
    short = " ".join(f"when '{k}' then '{v}'" for k, v in courses.SHORT.items())
    word = f"""case when lower(w) in ({S.quoted(courses.SHORT)}) then case lower(w) {short} end when i > 1 and lower(w) in ({S.quoted(courses.JOINING)}) then lower(w) when length(w) <= 3 then upper(w)
        else upper(w[1:1]) || lower(w[2:]) end"""
    code = f"({_like('s', courses.CODE)} and not regexp_matches(s, '^20[0-9][0-9]$'))"
    award = lambda c: "case " + " ".join(f"when {_like(c, p)} then '{g}'" for p, g in courses.AWARDS) + " end"
    return rf"""with p as (select page_id, {S.SCHEME} || '://' || {S.HOST} || {_pick(COURSES)} as url, {_pick(COURSES)} as path,
        trim(case when page_id % 8 <> 7 then {_pick(TITLES)} else regexp_extract(html, '(?is)<title>(.*?)</title>', 1) end) as title from pages),
        t as (select *, list_filter(list_transform(list_filter(string_split(lower(path), '/'), lambda s: s <> ''), lambda s: regexp_replace(s, '\.(html?|php|aspx|pdf)$', '')),
            lambda s: s not in ({S.quoted(courses.GENERIC)}) and not regexp_matches(s, '^[0-9]+$') and (regexp_matches(s, '[a-z][a-z][a-z]') or {code})) as found from p),
        q as (select *, coalesce(list_filter(found, lambda s: {_like('s', courses.DEGREE)})[1], list_max(list_transform(case when len(list_filter(found, lambda s: not {code})) > 0
            then list_filter(found, lambda s: not {code}) else found end, lambda s, i: {{'n': length(s), 'i': -i, 's': s}})).s) as s from t),
        r as (select *, coalesce(case when {code} then upper(s) else array_to_string(list_transform(list_filter(string_split(regexp_replace(s, '[-_]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w, i: {word}), ' ') end, '') as by_address,
            trim(regexp_replace(regexp_replace(split_part(split_part(title, '|', 1), ' - ', 1), '\s+20\d\d\b.*$', ''), '(?i)\s+(full[-\s]?time|part[-\s]?time|distance learning|online)\b.*$', '')) as clean from q)
        select page_id, not ({_like('lower(url)', courses.BROKEN)} or {_like('lower(url)', courses.NO_COURSE)} or {_like('lower(url)', courses.PROCESS)} or {_like('lower(url)', courses.LISTING)}) and len(found) > 0 as is_course,
        by_address, {award('lower(url)')} as award, case when title <> '' and not {_like('title', courses.SAYS_NOTHING)} and length(clean) >= 3
            and not (by_address <> '' and coalesce({award('lower(url)')} <> {award('clean')}, false)) then clean else by_address end as name from r"""


SQL = {
    "c9_validate_target": f"""with p as (select *, {_words("text", T.RESIDENTS)} as residents, {_like("title", T.AWARD)} or {_like("substr(text, 1, 600)", T.AWARD)} as award, {_like("text", T.STRUCTURE)}::int as structure,
        ({_like("text", T.DETAIL)} or facts >= 1)::int as detail, {_words("text", T.EVIDENCE)} as evidence, {_NO} as no_record, {_COUNT} as hits, {_like("text", T.SUBSTANCE)} as substance,
        {_words("lower(url)", T.FUNDING)} or {_words("lower(title)", T.FUNDING)} as named from {_PAGES}), v as (select *, {_COURSE} as c, {_FUNDING} as f from p)
        select page_id, c[1] as course_outcome, c[2] as course_reason, c[3]::double as course_confidence, f[1] as funding_outcome, f[2] as funding_reason, f[3]::double as funding_confidence,
        c[1] = 'VALIDATED_TARGET' or c[2] = 'no requirements' as identity, c[1] = 'VALIDATED_TARGET' as has_evidence from v""",
    "p16_ordered_reasons": f"""select page_id, reason, substance, (not contains(path, 'scholarship') or reason is null) and not {_words("title", T.RESIDENTS)} and not {_like("path", T.FOR_RESIDENTS)} as shown
        from (select *, {_NO} as reason, {_like("text", T.SUBSTANCE)} as substance from {_PAGES})""",
    "c18_main_page": f"""select host, main_page, rank from (select host, url as main_page, {_RANK} as rank, row_number() over (partition by host order by anchor desc, {_RANK} desc, length(url), url) as n from {_PAGES})
        where n = 1""",
    "g4_course_names": _course_sql(),
    "f21_candidate_urls": f"""select page_id, (row_number() over (partition by page_id order by k, form) - 1)::bigint as position, candidate from (select page_id, k, form, case form when 0 then stem || '/' || seg || '.html' when 1 then stem || '/' || seg
        else stem || '/' || seg || '/' end as candidate from (select page_id, regexp_replace(url, '(\\.html)?([?#].*)?$', '') as stem0 from pages) p, lateral (select rtrim(stem0, '/') as stem),
        (select unnest([{S.quoted(admission.SEGMENTS)}]) as seg, unnest(range({len(admission.SEGMENTS)})) as k), (values (0), (1), (2)) f(form) where form > 0 or page_id % 2 = 0)""",
    "f6_resolved_links": f"""with p as (select page_id, html, {S.SCHEME} as scheme, {S.SCHEME} || '://' || {S.HOST} as origin, {S.PATH} as path from pages),
        d as (select *, regexp_replace(path, '[^/]*$', '') as directory from p),
        h as (select page_id, origin, unnest(list_distinct(regexp_extract_all(html, '<a href="([^"]*)"', 1))) as href from d)
        select page_id, href, origin || href as link from h where starts_with(href, '/') union
        select page_id, unnest(['../up', '?q=1', '//other.org/p', 'x/./y', '/root//a/../b']), unnest([origin || case when directory = '/' then '/' else regexp_replace(directory, '[^/]+/$', '') end || 'up', origin || path || '?q=1',
        scheme || '://other.org/p', origin || directory || 'x/y', origin || '/root//b']) from d""",
    "x5_admission": f"""with l as (select page_id, case when page_id % 6 = 5 then 'https://same.org/courses/' || (page_id % 4) when page_id % 3 = 0 then regexp_replace(url, '/[^/]*$', '') || '/' || (2015 + page_id % 7) || '/about'
        else url end as url, {_pick(CLASSES)} as class from pages), p as (select *, {S.CANONICAL} as canonical, {S.HOST} as host, {S.PATH} as path from l),
        y as (select *, nullif(regexp_extract(path, '/(20[0-3][0-9]|199[0-9])(/|$)', 1), '')::int as year, host || lower(regexp_replace(path, '/(20[0-3][0-9]|199[0-9])(/|$)', '/~year~\\2')) as family from p)
        select page_id, case when page_id <> min(page_id) over (partition by canonical) then 'duplicate' when year < max(year) over (partition by family) then 'older_edition' when page_id % 11 = 3 then 'class'
        when page_id % 10 <> 0 and class not in ({S.quoted(admission.TARGETS)}) and page_id % 4 > 1 and not {_like("path", admission.HUBS)} then 'out_of_scope' else 'queued' end as step from y""",
    "c21_fast_fetch": f"""select page_id, case when page_id % 13 = 0 then 'network' when page_id % 17 = 1 then 'challenge' when page_id % 6 in (1, 4) then 'blocked' when page_id % 6 <> 2 and length({_HTML}) < 400 then 'thin' end as slow_because from pages""",
}
