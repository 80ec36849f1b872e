"""Whether a page is a target: one course with requirements or one scholarship with substance, told with evidence and reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import text as X
from pagemill.functions import urls

# What a course page shows; labels that name no scholarship; vocabularies of evidence, funding and of pages for
# residents only; what is no record of a scholarship, in order, and what gives one substance.
AWARD = (
    r"(?i)\b(bsc|ba|beng|bba|llb|bcom|bfa|bed|msc|ma|meng|mba|llm|mphil|phd|bachelor|master|doctor(?:ate)?|diploma|associate degree|graduate certificate"
    r"|foundation (?:year|programme|program))\b"
)
STRUCTURE = (
    r"(?i)\b(modules?|curriculum|course structure|programme structure|program structure|units? of study|subjects? you(?:'|’)?ll study"
    r"|what you(?:'|’)?ll (?:study|learn)|course overview|programme overview)\b"
)
DETAIL = (
    r"(?i)\b(duration|intakes?|start dates?|commencement|study mode|full[- ]time|part[- ]time|campus|cricos|ucas code|course code|programme code|atar|credit points)\b"
)
NO_NAMES = (
    "faculty", "faculties", "general", "domestic", "international", "undergraduate", "postgraduate", "postgraduate research", "undergraduate research", "research",
    "equity", "accommodation", "foundation", "commencing", "continuing", "scholarships", "scholarship", "find a scholarship",
)
EVIDENCE = (
    "entry requirements", "entry criteria", "eligibility", "admission requirements", "academic requirements", "english language requirements", "language requirements",
    "ielts", "toefl", "minimum grade", "minimum gpa", "minimum score", "minimum points", "minimum marks", "qualifications required", "how to apply", "country specific",
    "international students", "required subjects", "grade requirements", "selection criteria", "tariff points", "what you need", "applicants must", "you will need",
    "you must have",
)
FUNDING = (
    "scholarship", "scholarships", "scholarship and funding", "scholarships and funding", "scholarship opportunities", "funding", "fees and funding", "tuition funding",
    "financial aid", "financial support", "financial assistance", "bursary", "bursaries", "grant", "grants", "fee waiver", "tuition fee waiver", "fee discount",
    "fee reduction", "merit scholarship", "merit-based scholarship", "need-based aid", "international scholarship", "international scholarships",
    "scholarship for international students", "global scholarship", "vice-chancellor scholarship", "dean's scholarship", "entrance scholarship", "award", "awards",
    "stipend", "fellowship", "fellowships", "studentship", "assistantship", "cost and funding", "ways to pay", "stipendium", "stipendien", "bourse", "bourses", "beca",
    "becas", "borsa di studio", "borse di studio", "bolsa de estudos",
)
RESIDENTS = (
    "domestic students", "domestic student", "domestic applicants", "domestic applicant", "domestic entry", "domestic fee status", "domestic fees", "domestic-only",
    "domestic only", "home students", "home student", "home fee status", "home fees", "home-fee status", "local students only", "local student", "local applicants only",
    "in-state tuition", "state resident tuition", "resident tuition", "australian citizens and permanent residents", "for australian citizens",
    "nz citizens and permanent residents", "uk students only", "eu students only", "eu/eea students only", "settled status",
)
NOISE = r"\.(pdf|xlsx?|docx?|jpe?g|png)(\?|$)|/news/|/blog/|/announcements?/|/events?/|/staff/"
JUNK = r"/(login|signin|sign-in|logout|auth|dashboard|search|apply|application)\b|[?&]returnurl="
BLOG_HOST, BLOG_PATH = r"^(insight|blog|blogs|news|stories|story|magazine|media|pulse)\.", r"(?i)/(tag|category|author|archives?)/"
FEES = (
    r"(?i)/fees?(/|$)|fee[-_]?paying|course[-_]?fees?|tuition[-_]?fees?|commonwealth[-_]?supported|single[-_]?subject[-_]?study|fee[-_]?schedules?|refunds?[-_]"
    r"|re[-_]?crediting|census[-_]?dates?|payment[-_]?(options?|plans?)|/costs?(/|$)"
)
CONTAINER = (
    r"(?i)/(scholarships?|scholarships?-grants|find-scholarship|foundation|continuing|commencing|any-year|accom|accommodation|equity|research|grants?|graduate-research"
    r"|financial-assistance|scholarship-dashboard|faculty|faculties|general|domestic|international|undergraduate|postgraduate|postgraduate-research"
    r"|undergraduate-research)(\.[a-z0-9]{2,5})?/?$"
)
SUBSTANCE = (
    r"(?i)\bdeadline\b|closing date|\bhow to apply\b|application requirements?|award criteria|selection criteria|\beligib\w*|\bstipend\b|fee[-\s]?waiver"
    r"|tuition (?:fee )?waiver|full tuition|\bburs(?:ary|aries)\b|per (?:year|annum|academic year)|[£$€]\s?\d|\b(?:gbp|usd|aud|eur|cad|nzd)\s?\d"
    r"|international students?|\bvalue\b|\bamount\b|\bworth\b"
)

#: Page classes: of the other purpose than courses, of the other purpose than scholarships, and general ones with their reasons.
SCHOLARSHIPS = ("SCHOLARSHIP_PAGE", "SCHOLARSHIP_LISTING", "FUNDING_PAGE")
COURSES = ("COURSE_PAGE", "COURSE_LISTING", "ELIGIBILITY_PAGE", "ADMISSIONS_PAGE", "INTERNATIONAL_ADMISSIONS_PAGE")
GENERAL = {
    "COURSE_LISTING": "course listing", "ELIGIBILITY_PAGE": "general eligibility page", "ADMISSIONS_PAGE": "general admissions page",
    "INTERNATIONAL_ADMISSIONS_PAGE": "general international admissions page", "NAVIGATION_PAGE": "navigation page", "UNKNOWN": "unclassified page",
}

FOR_RESIDENTS = r"(?i)(^|[/_-])(domestic|home-students?|local-students?)([/_.-]|$)"
#: In order of preference, what an institution's main page of requirements has in its address.
MAIN_PAGES = (
    r"(?i)international[^?]*(entry|admission)[-_ ]?requirement", r"(?i)(entry|admission)[-_ ]?requirement[s]?[^?]*international", r"(?i)\bentry[-_ ]?requirement",
    r"(?i)\badmission[-_ ]?requirement", r"(?i)\bentry[-_ ]?criteri", r"(?i)\bentry[-_ ]?profile", r"(?i)how[-_ ]?to[-_ ]?apply", r"(?i)\badmissions?\b",
    r"(?i)international[^?]*(eligib|qualif)", r"(?i)\beligib", r"(?i)\binternational\b",
)
#: A word's edge, by ASCII letters, digits and the underscore, which is what the patterns above mean by theirs.
EDGE = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"

SCHEMA = "struct<outcome:string,target:string,identity:boolean,evidence:string,reason:string,confidence:double>"


def _like(text: Column, pattern: str) -> Column:
    return text.rlike(pattern.replace(r"\b", EDGE))


def speaks_of(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike(X.keyword_pattern(words, loose=True))


def no_scholarship(url: Column, domain: Column | None = None) -> Column:
    """Why an address is no record of a scholarship, null if it may be one. domain: leaves out other institutions' pages."""
    low, path = F.lower(url), urls.path(url)
    reason = F.when(low.rlike(NOISE), "file, news or event").when(_like(low, JUNK), "login or search").when(urls.host(url).isNull(), "malformed")
    if domain is not None:
        reason = reason.when((domain != "") & (urls.registrable_by_rule(urls.host(url)) != domain), "external")
    return reason.when(urls.host(url).rlike(BLOG_HOST) | path.rlike(BLOG_PATH), "article").when(path.rlike(FEES), "fees").when(path.rlike(CONTAINER), "listing")


def has_substance(text: Column) -> Column:
    """A deadline, an amount, criteria or a scope: what a scholarship's page has at least one of."""
    return _like(text, SUBSTANCE)


def shown_in_feed(url: Column, title: Column, is_scholarship: Column, all_audiences: bool = False) -> Column:
    """Whether the feed shows a validated page: no listing of scholarships, nothing for residents only."""
    fine = ~is_scholarship | no_scholarship(url).isNull()
    if not all_audiences:
        for_residents = speaks_of(F.coalesce(title, F.lit("")), RESIDENTS) | F.coalesce(urls.path(url), F.lit("")).rlike(FOR_RESIDENTS)
        fine = fine & ~for_residents
    return F.coalesce(fine, F.lit(False))


def main_page_rank(url: Column) -> Column:
    """How well an address names an institution's main page of requirements: the more, the better; 0 for not at all."""
    ranks = [F.when(_like(F.lower(url), p), len(MAIN_PAGES) - i) for i, p in enumerate(MAIN_PAGES)]
    return F.coalesce(*ranks, F.lit(0))


def main_pages(pages: DataFrame, group: str, url: str, works: str) -> DataFrame:
    """Each group's main page of requirements: working ones first, then by rank, then the shortest address, then by its letters."""
    best = F.min_by(F.col(url), F.struct(~F.coalesce(F.col(works), F.lit(False)), -main_page_rank(F.col(url)), F.length(url), F.col(url)))
    return pages.filter(F.col(url).isNotNull()).groupBy(group).agg(best.alias("main_page"))


def _verdict(outcome: str, reason: Column | str, confidence: float, identity: bool = False, target: str | None = None, evidence: Column | None = None) -> Column:
    return F.struct(
        F.lit(outcome).alias("outcome"), F.lit(target).cast("string").alias("target"), F.lit(identity).alias("identity"), (F.lit("") if evidence is None else evidence).alias("evidence"),
        (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"), F.lit(confidence).alias("confidence"),
    )


def _proof(text: Column, words: tuple[str, ...]) -> Column:
    """50 characters before the first word of evidence and 90 from it on, white space made single."""
    at = F.length(F.regexp_extract(text, f"(?s)^(.*?)(?:{X.keyword_pattern(words, loose=True)})", 1))
    return X.squeeze(F.substring(text, F.greatest(at - 49, F.lit(1)), at - F.greatest(at - 50, F.lit(0)) + 90))


def course_target(page_class: Column, title: Column, text: Column, has_anchor: Column, facts: Column, all_audiences: bool = False) -> Column:
    """SCHEMA of a page read for requirements: first that it is one course, then that it says what the course asks for."""
    award = _like(title, AWARD) | _like(F.substring(text, 1, 600), AWARD)
    signals = award.cast("int") + _like(text, STRUCTURE).cast("int") + (_like(text, DETAIL) | (facts >= 1)).cast("int")
    own = page_class == "COURSE_PAGE"
    out = F.when(~F.coalesce(text.rlike(r"\S"), F.lit(False)), _verdict("REJECTED", "no page text", 0.0)).when(page_class.isin(*SCHOLARSHIPS), _verdict("REJECTED", "scholarship page", 0.0))
    if not all_audiences:
        out = out.when(speaks_of(text, RESIDENTS), _verdict("DISCOVERY_ONLY", "for residents only", 0.2))
    out = (
        out.when(own & ~F.when(award, signals >= 1).otherwise(signals >= 2), _verdict("DISCOVERY_ONLY", "no course identity", 0.2))
        .when(own & speaks_of(text, EVIDENCE), _verdict("VALIDATED_TARGET", "requirements in the text", 0.9, True, "COURSE", _proof(text, EVIDENCE)))
        .when(own & has_anchor, _verdict("VALIDATED_TARGET", "requirements behind an anchor", 0.7, True, "COURSE", F.lit("section of entry requirements on the page")))
        .when(own, _verdict("DISCOVERY_ONLY", "no requirements", 0.4, True))
    )
    for name, reason in GENERAL.items():
        out = out.when(page_class == name, _verdict("DISCOVERY_ONLY", reason, 0.3))
    return out.otherwise(_verdict("REJECTED", "irrelevant", 0.0))


def scholarship_target(page_class: Column, url: Column, title: Column, text: Column, all_audiences: bool = False) -> Column:
    """SCHEMA of a page read for funding: one named scholarship whose text says so repeatedly and has substance."""
    own = page_class == "SCHOLARSHIP_PAGE"
    hits = F.regexp_count(text, F.lit(X.keyword_pattern(FUNDING, loose=True)))
    named = speaks_of(F.lower(url), FUNDING) | speaks_of(F.lower(title), FUNDING)
    out = F.when(~F.coalesce(text.rlike(r"\S"), F.lit(False)), _verdict("REJECTED", "no page text", 0.0)).when(page_class.isin(*COURSES), _verdict("REJECTED", "course page", 0.0))
    if not all_audiences:
        out = out.when(speaks_of(text, RESIDENTS), _verdict("DISCOVERY_ONLY", "for residents only", 0.2))
    return (
        out.when(own & no_scholarship(url).isNotNull(), _verdict("DISCOVERY_ONLY", F.concat(F.lit("no scholarship: "), no_scholarship(url)), 0.2))
        .when(own & F.lower(F.trim(title)).isin(*NO_NAMES), _verdict("DISCOVERY_ONLY", "label of a category", 0.2))
        .when(own & (hits >= 2) & named & ~has_substance(text), _verdict("DISCOVERY_ONLY", "no substance", 0.3))
        .when(own & (hits >= 2) & named, _verdict("VALIDATED_TARGET", "scholarship in the text", 0.85, False, "SCHOLARSHIP", _proof(text, FUNDING)))
        .when(own, _verdict("DISCOVERY_ONLY", "too little about funding", 0.3)).when(page_class.isin(*SCHOLARSHIPS), _verdict("DISCOVERY_ONLY", "scholarship listing", 0.3))
        .when(page_class.isin("NAVIGATION_PAGE", "UNKNOWN"), _verdict("DISCOVERY_ONLY", "navigation page", 0.3)).otherwise(_verdict("REJECTED", "irrelevant", 0.0))
    )
