"""Classes, scores and verdicts as ordered rules; each rule's pattern works in Java and in RE2, so SQL can check it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions import urls
from pagemill.plans import sqltext as S

# Path rules that reject a link, social hosts, class rules in their order, weights of the link score.
REJECTED = (
    r"/login($|[^a-z0-9_])", r"/signin($|[^a-z0-9_])", r"/portal($|[^a-z0-9_])", r"/privacy($|[^a-z0-9_])", r"/terms($|[^a-z0-9_])", r"/news($|[^a-z0-9_])",
    r"/events?($|[^a-z0-9_])", r"/careers?($|[^a-z0-9_])", r"/jobs?($|[^a-z0-9_])", r"/contact($|[^a-z0-9_])", r"/alumni($|[^a-z0-9_])",
    r"/(donate|donation|giving)($|[^a-z0-9_])", r"/library($|[^a-z0-9_])", r"/calendar($|[^a-z0-9_])", r"/search($|[^a-z0-9_])", r"/cart($|[^a-z0-9_])",
    r"/account($|[^a-z0-9_])", r"/(undefined|null)(/|$)", r"/subjects?/(19|20)[0-9][0-9]/", r"/(units?|modules?)/(19|20)[0-9][0-9]/", r"/timetables?($|[^a-z0-9_])",
    r"/exams?($|[^a-z0-9_])", r"/staff(/|$)", r"/sports?($|[^a-z0-9_])", r"/blogs?($|[^a-z0-9_])", r"/(gallery|photos?)($|[^a-z0-9_])",
    r"/(accommodation|housing)($|[^a-z0-9_])", r"/study[-_]?plans?($|[^a-z0-9_])", r"/tags?/", r"\.json$",
)
SOCIAL = ("facebook.com", "twitter.com", "x.com", "instagram.com", "linkedin.com", "youtube.com", "tiktok.com", "pinterest.com", "flickr.com", "weibo.com")
CLASS_RULES = (
    ("SCHOLARSHIP", r"/(scholarships?|bursar(y|ies)|grants?|fee-waivers?)"),
    ("ENTRY_REQUIREMENTS", r"/(entry-requirements?|admission-requirements?|eligibility|how-to-apply|requirements?)"),
    ("COURSE", r"/(courses?|programmes?|programs?|degrees?)/[^/]+"),
    ("COURSE_LIST", r"/(courses?|programmes?|programs?|degrees?)/?$"),
    ("INTERNATIONAL", r"/international"),
    ("FACULTY", r"/(faculty|faculties|schools?|departments?)"),
)
ALLOWED = {
    "ELIGIBILITY": ("ENTRY_REQUIREMENTS", "COURSE", "COURSE_LIST", "INTERNATIONAL", "FACULTY", "UNKNOWN"),
    "SCHOLARSHIP": ("SCHOLARSHIP", "INTERNATIONAL", "UNKNOWN"),
}
WEIGHTS = (
    ("international|overseas", 45), (r"entry[ _-]?requirements?|eligibility|how[ _-]?to[ _-]?apply", 40), (r"(admission|entry)[ _-]?(requirement|criteri|profile)", 18),
    ("undergraduate", 20), ("postgraduate", 20), ("bachelors?|bsc|beng|bba|llb", 20), ("masters?|mba|meng|ph[.]?d|doctoral", 20), ("degrees?", 15), ("programm?es?", 15),
    ("courses?", 15), ("foundation|pathway", 15), ("apply", 10), ("study", 10), ("faculty", 8), ("department", 8), ("catalogu?e|prospectus|handbook", 15),
    ("qualifications?", 10), ("subjects?", 8), ("(school|college)s?", 8),
)
QUEUE, DISCOVER, SAME_SITE, SHALLOW = 40, 20, 15, 5
CHALLENGE = r"checking your browser|verify you are human|attention required|access denied|captcha|enable javascript and cookies"
#: Host URLs are plain, so the rules are tried on them with these endings.
SAMPLE_TAILS = (
    "", "/courses/bachelor-of-arts", "/entry-requirements", "/scholarships", "/news", "/login", "/international/apply", "/faculty", "/programmes", "/x.zip", "/brochure.pdf",
    "/courses", "/blog/tag/", "/study-plans/1", "/postgraduate/degrees/mba",
)


def page_class(url: Column) -> Column:
    """struct(page_class, reason): file type before host before rejecting path before class rules."""
    p, h = F.lower(urls.path(url)), urls.host(url)
    made = lambda k, r: F.struct(F.lit(k).alias("page_class"), F.lit(r).alias("reason"))
    social = h.isin(*SOCIAL)
    for s in SOCIAL:
        social = social | F.endswith(h, F.lit("." + s))
    out = (
        F.when(h.isNull(), made("REJECTED", "NO_ORIGIN")).when(urls.is_pdf(url), made("PDF", "PDF_DEFERRED")).when(urls.is_dropped_type(url), made("REJECTED", "DROPPED_FILE"))
        .when(social, made("REJECTED", "SOCIAL")).when(p.rlike("|".join(REJECTED)), made("REJECTED", "REJECTED_PATH"))
    )
    for k, rule in CLASS_RULES:
        out = out.when(p.rlike(rule), made(k, "PATH"))
    return out.otherwise(made("UNKNOWN", "NO_RULE"))


def link_score(url: Column) -> Column:
    """The weights whose word the URL has, the same-site bonus (a link is told from its own page here) and that for shallow paths."""
    text = F.lower(url)
    score = sum((F.when(text.rlike(p), w).otherwise(0) for p, w in WEIGHTS), F.lit(SAME_SITE))
    return score + F.when(urls.depth(url) <= 3, SHALLOW).otherwise(0)


def disposition(score: Column) -> Column:
    return F.when(score >= QUEUE, "EXTRACT").when(score >= DISCOVER, "DISCOVER_ONLY").otherwise("SKIP")


def page_status(text: Column, length: Column) -> Column:
    return (
        F.when(length == 0, "EMPTY").when(F.lower(text).rlike(CHALLENGE), "BLOCKED").when(F.lower(text).rlike("page not found|404 error"), "SOFT_404")
        .when(length < 200, "THIN").otherwise("OK")
    )


def verdict(code: Column) -> Column:
    return F.when(code.between(200, 299), "VALID").when(code.between(300, 399), "REDIRECT").when(code.isin(404, 410), "DEAD").otherwise("UNCONFIRMED")


SQL_VERDICT = "case when code between 200 and 299 then 'VALID' when code between 300 and 399 then 'REDIRECT' when code in (404, 410) then 'DEAD' else 'UNCONFIRMED' end"


def sql_page_class(sample: str) -> str:
    path, host = S.PATH.replace("url", "sample"), S.HOST.replace("url", "sample")
    rules = " ".join(f"when regexp_matches(lower(p), '{r}') then '{k}'" for k, r in CLASS_RULES)
    social = " or ".join(f"h = '{s}' or ends_with(h, '.{s}')" for s in SOCIAL)
    rejected = "|".join(REJECTED)
    reason = f"""case when ext = '.pdf' then 'PDF_DEFERRED' when ext in ({S.quoted(urls.DROPPED_TYPES)}) then 'DROPPED_FILE' when {social} then 'SOCIAL'
        when regexp_matches(lower(p), '{rejected}') then 'REJECTED_PATH' when {' or '.join(f"regexp_matches(lower(p), '{r}')" for _, r in CLASS_RULES)} then 'PATH' else 'NO_RULE' end"""
    kind = f"case reason when 'PDF_DEFERRED' then 'PDF' when 'NO_RULE' then 'UNKNOWN' when 'PATH' then case {rules} end else 'REJECTED' end"
    return rf"""select page_id, sample, page_class, reason, page_class in ({S.quoted(ALLOWED['ELIGIBILITY'])}) as eligibility_allowed,
        page_class in ({S.quoted(ALLOWED['SCHOLARSHIP'])}) as scholarship_allowed from (select *, {kind} as page_class from (select *, {reason} as reason from (
        select page_id, sample, {path} as p, {host} as h, lower(regexp_extract({path}, '(\.[^./]*)$', 1)) as ext from {sample})))"""


def sql_link_score(sample: str) -> str:
    depth = S.DEPTH.replace("url", "sample")
    score = f"{SAME_SITE} + " + " + ".join(f"case when regexp_matches(lower(sample), '{p}') then {w} else 0 end" for p, w in WEIGHTS) + f" + case when {depth} <= 3 then {SHALLOW} else 0 end"
    return f"select page_id, score, case when score >= {QUEUE} then 'EXTRACT' when score >= {DISCOVER} then 'DISCOVER_ONLY' else 'SKIP' end as disposition from (select page_id, {score} as score from {sample})"


def sql_page_status(t: str) -> str:
    return f"""case when length({t}) = 0 then 'EMPTY' when regexp_matches(lower({t}), '{CHALLENGE}') then 'BLOCKED'
        when regexp_matches(lower({t}), 'page not found|404 error') then 'SOFT_404' when length({t}) < 200 then 'THIN' else 'OK' end"""


# What errors say, first rule first (all of a rule's groups must be met); signs of a list that scripts fill.
MESSAGES = (
    ("database_down", ("econnrefused", "5432|5433|postgres")), ("database_down", ("can't reach database|cannot reach database|database server|p1001",)),
    ("duplicate", ("p2002|unique constraint",)), ("gone", ("p2025|record to update not found|no record was found",)), ("still_linked", ("p2003|foreign key",)),
    ("database", ("prisma",)), ("queue_down", ("redis|connection is closed|stream isn't writeable",)), ("dns", ("enotfound|getaddrinfo",)),
    ("refused", ("econnrefused",)), ("reset", ("econnreset|socket hang up",)), ("timeout", ("etimedout|timed out|timeout|aborterror|the operation was aborted",)),
    ("network", ("eai_again|fetch failed|network error|und_err",)), ("certificate", ("certificate|self-signed|cert_",)),
    ("dns", ("net::err_name_not_resolved",)), ("refused", ("net::err_connection",)), ("browser_closed", ("net::err_aborted|target closed|page.goto|browser has been closed",)),
    ("redirect_loop", ("err_too_many_redirects|redirect",)), ("blocked", ("403|forbidden|429|too many requests",)), ("not_found", ("404|not found",)),
    ("server_error", ("500|502|503|504|bad gateway|service unavailable|gateway timeout",)), ("port_taken", ("eaddrinuse|address already in use",)), ("file_missing", ("enoent|no such file",)),
)
FINDER = r"(?i)name=[\"'][^\"']*_length[\"']|datatables_length|class=[\"'][^\"']*(datatable|finder)[^\"']*[\"']|load more|show more|view all|see all|more courses|load all"
#: Patterns that gate a row of the export: never shipped, layout fragments, courses, completion and admission requirements, domestic paths.
DENIED = (
    r"imprint|about[-_]?us|newsroom|press|campus[-_]?map|data[-_]?protection|accessibility|gender[-_]?equality|/history|/contact|privacy|sitemap|/login|/people/|/staff|/profile/"
    r"|/news/|/events?/|cookie|mailto:|href=|advisory[-_]?council|/advisory|alumni|donate|giving"
)
RESEARCH, RESEARCH_DEGREE = r"/research", r"/research[-_]degree"
COURSE_PAGE, LISTING_END = r"/(courses?|programmes?|programs?|degrees?)/[a-z0-9]", r"/(courses?|programmes?|programs?|degrees?|search|a-z)/?$"
COMPLETION = r"(graduation|degree|minor|completion|major|honou?rs)[-_ ]?requirements?|sample[-_ ]?curriculum|degrees?[-_ ]?available|course[-_ ]?content|module[-_ ]?(list|catalog)"
ADMISSION = r"(admission|entry)[-_ ]?(requirement|criteri|profile)|how[-_ ]?to[-_ ]?apply|/admissions?([^a-z0-9_]|$)|entry[-_ ]?requirements?"
ELIGIBLE, DOMESTIC = r"eligib|entry[-_ ]?requirement|admission|how[-_ ]?to[-_ ]?apply|international", r"/(domestic|home|local)([-_](students?|applicants?))?(/|$)"


def message_class(message: Column) -> Column:
    """What kind of error a message speaks of."""
    low, out = F.lower(message), F
    for kind, groups in MESSAGES:
        met = low.rlike(groups[0])
        for g in groups[1:]:
            met = met & low.rlike(g)
        out = out.when(met, kind)
    return out.otherwise("other")


SQL_MESSAGE_CLASS = "case " + " ".join(f"""when {' and '.join(f"regexp_matches(lower(message), '{g.replace(chr(39), chr(39) * 2)}')" for g in groups)} then '{kind}'""" for kind, groups in MESSAGES) + " else 'other' end"


def is_finder(html: Column) -> Column:
    return html.rlike(FINDER)


def export_level(url: Column, page_kind: Column, title: Column) -> Column:
    """The level at which a link enters the eligibility export (course or university), null where the gate keeps it out.

    In order: scholarship classes, denied paths and layout fragments, pages for domestic students, pages of neither level, listings,
    and requirements for completing a course rather than for entering it.
    """
    low = F.lower(url)
    denied = low.rlike(DENIED) | (low.rlike(RESEARCH) & ~low.rlike(RESEARCH_DEGREE))
    domestic = F.lower(urls.path(url)).rlike(DOMESTIC) | F.coalesce(F.lower(title).rlike("domestic students|home students"), F.lit(False))
    course = low.rlike(COURSE_PAGE)
    out = F.when(page_kind.isin("SCHOLARSHIP") | denied | domestic, F.lit(None)).when(~course & ~low.rlike(ELIGIBLE), F.lit(None))
    out = out.when(course & (urls.path(low).rlike(LISTING_END) | (low.rlike(COMPLETION) & ~low.rlike(ADMISSION))), F.lit(None))
    return out.when(course, "course").otherwise("university")


def sql_export_level(url: str, path: str, kind: str, title: str) -> str:
    low = f"lower({url})"
    has = lambda pattern, of=low: f"regexp_matches({of}, '{pattern}')"
    return f"""case when {kind} = 'SCHOLARSHIP' or {has(DENIED)} or ({has(RESEARCH)} and not {has(RESEARCH_DEGREE)}) or {has(DOMESTIC, f'lower({path})')}
        or coalesce({has('domestic students|home students', f'lower({title})')}, false) then null when not {has(COURSE_PAGE)} and not {has(ELIGIBLE)} then null
        when {has(COURSE_PAGE)} and ({has(LISTING_END, f'lower({path})')} or ({has(COMPLETION)} and not {has(ADMISSION)})) then null when {has(COURSE_PAGE)} then 'course' else 'university' end"""
