"""Course pages by their addresses: which are one course, what the course is called, and which award it leads to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions import urls
from pagemill.functions.targets import EDGE

# Addresses that are no course, segments that name none, titles that say nothing, awards, short forms of them.
NO_COURSE = (
    r"(?i)(\?|/abroad\b|study[-_]?abroad|international[-_]?students?|your[-_]?country|country[-_]?or[-_]?territory|/countries?/|english[-_]?language|/visa\b"
    r"|/course[-_]?enquiry|/search\b|/compare\b|/clearing\b|/open[-_]?days?\b|directory|\ba-z\b|apply[-_]?for|how[-_]?to[-_]?apply|/fees?\b|/funding\b"
    r"|/term[-_]?dates?\b|course[-_]?dates?|course[-_]?fees?|tuition[-_]?fees?|\bscholarships?\b|\bbursar(?:y|ies)\b|key[-_]?dates?|intake[-_]?dates?"
    r"|important[-_]?dates?|(left|right|main|top|bottom|side|centre|center|mid)[-_]col(umn)?[-_]content|/index\.(php|html?|aspx)|thank[-_]?you"
    r"|sponsored[-_]and[-_]self[-_]funded|self[-_]funded[-_]places|visiting[-_](research|students?))"
)
LISTING = (
    r"(?i)/(courses?|programmes?|programs?|study|studies|subjects?|undergraduate|postgraduate|graduate|degrees?|abroad|programs?-and-courses|programs?-courses|a-z|all)/?$"
)
PROCESS = (
    r"(?i)(intermission|course[-_]?changes?|change[-_]?of[-_]?(?:course|programme?|program|enrol(?:ment)?|major|preference)|leave[-_]?of[-_]?absence|withdraw(?:al|ing)?"
    r"|deferr?(?:al|ment|ing|red)?|re[-_]?enrol(?:ment|ling)?|readmission|special[-_]?consideration"
    r"|application[-_]?for[-_]?(?:intermission|leave|credit|withdrawal|deferral|admission|extension|special)|enrol(?:ment)?[-_]?(?:variation|change|status|cancellation)"
    r"|/myuc(?:[/_-]|$)|credit[-_]?transfer|recognition[-_]?of[-_]?prior[-_]?learning)"
)
BROKEN = r"(?i)/(undefined|null|nan|\[object%20object\])(/|$)"
GENERIC = (
    "courses", "course", "programmes", "programme", "programs", "program", "study", "studies", "subjects", "subject", "undergraduate", "postgraduate", "graduate", "ug",
    "pg", "degrees", "degree", "abroad", "en", "international", "international-students", "faculties", "faculty", "department", "departments", "schools", "school",
    "academics", "programs-and-courses", "programs-courses", "degree-apprenticeships", "degree-apprenticeship", "research-degrees", "research-degree",
    "short-courses-and-cpd", "short-courses", "short-course", "cpd", "types-of-study", "full-time", "part-time", "fulltime", "parttime", "distance-learning", "online",
    "overview", "how-to-apply", "fees", "apply", "find-a-course", "admission-requirements", "entry-requirements", "graduation-requirements", "degree-requirements",
    "minor-requirements", "completion-requirements", "sample-curriculum", "degrees-available", "requirements", "admission", "admissions", "graduation", "curriculum",
    "entry-profile", "content", "home", "myuc", "portal", "info", "information", "undefined", "null", "nan",
)
CODE = r"(?i)^(?:[a-z]{2,6}\d{1,4}|\d{2,4}[a-z]{2,4})$"
DEGREE = r"(?i)(bsc|beng|bba|llb|bachelor|master|msc|meng|mba|\bma\b|\bba\b|honou?rs|diploma|certificate|minor|phd|foundation|doctorate|associate)"
SAYS_NOTHING = (
    r"(?i)(application information|frequently asked|^faq|^home$|^search|^courses?$|^programmes?$|overview|page not found|not found|^404|enquiry|^undergraduate$"
    r"|^postgraduate$|cookie|^study$|^short courses?( and cpd)?$|^cpd$|^research degrees?$|^(admission|entry|graduation|degree|minor) requirements?$"
    r"|^admission requirements\b|^graduation requirements\b|^error$|^loading$|^untitled$|^redirecting$|please wait|just a moment|^forbidden$|access denied"
    r"|identity provider|production idp)"
)
AWARDS = (
    (r"(?i)\b(doctor|doctorate|phd|dphil|edd|dba)\b", "doctor"), (r"(?i)\b(masters?|msc|meng|mba|mphil|mres|ma|ms|llm)\b", "master"),
    (r"(?i)\b(bachelor|bsc|beng|bba|llb|ba|bs)\b", "bachelor"), (r"(?i)\bassociate\b", "associate"),
)
SHORT = {
    "bsc": "BSc", "ba": "BA", "beng": "BEng", "bba": "BBA", "llb": "LLB", "bs": "BS", "msc": "MSc", "ma": "MA", "mba": "MBA", "phd": "PhD", "meng": "MEng", "ms": "MS",
    "llm": "LLM", "mphil": "MPhil", "hons": "Hons",
}
JOINING = ("and", "or", "of", "the", "with", "in", "for", "to", "at", "on", "a", "an", "as", "by", "from", "into")


def _like(text: Column, pattern: str) -> Column:
    return text.rlike(pattern.replace(r"\b", EDGE))


def is_code(segment: Column) -> Column:
    """Whether a segment is the code of a course: letters and digits, no year."""
    return segment.rlike(CODE) & ~segment.rlike(r"^20\d\d$")


def _telling(url: Column) -> Column:
    """The segments that can name a course, without their endings."""
    found = F.transform(urls.segments(F.lower(url)), lambda s: F.regexp_replace(s, r"(?i)\.(html?|php|aspx|pdf)$", ""))
    return F.filter(found, lambda s: ~s.isin(*GENERIC) & ~s.rlike(r"^\d+$") & (s.rlike("[a-z]{3,}") | is_code(s)))


def is_real_course(url: Column) -> Column:
    """Whether an address is one course's page: not a listing, a process, a general page or a broken link."""
    low = F.lower(url)
    bad = low.rlike(BROKEN) | _like(low, NO_COURSE) | low.rlike(PROCESS) | low.rlike(LISTING)
    return F.coalesce(~bad & (F.size(_telling(url)) > 0), F.lit(False))


def title_of(slug: Column) -> Column:
    """A slug as a title: awards in their short forms, joining words small, short words as they are abbreviated."""
    words = F.filter(F.split(F.regexp_replace(F.regexp_replace(slug, r"(?i)\.(html?|php|aspx)$", ""), "[-_]+", " "), " "), lambda w: w != "")
    short = F.create_map(*[F.lit(x) for pair in SHORT.items() for x in pair])
    word = lambda w, i: (
        F.when(F.lower(w).isin(*SHORT), F.element_at(short, F.lower(w))).when((i > 0) & F.lower(w).isin(*JOINING), F.lower(w)).when(F.length(w) <= 3, F.upper(w))
        .otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30))))
    )
    return F.array_join(F.transform(words, word), " ")


def name_from_url(url: Column) -> Column:
    """The course's name by its address: the first segment with a degree, else the longest words, else a code; '' for none."""
    found = _telling(url)
    words = F.filter(found, lambda s: ~is_code(s))
    pool = F.when(F.size(words) > 0, words).otherwise(found)
    longest = F.array_max(F.transform(pool, lambda s, i: F.struct(F.length(s).alias("n"), (-i).alias("i"), s.alias("s"))))["s"]
    pick = F.coalesce(F.get(F.filter(found, lambda s: _like(s, DEGREE)), F.lit(0)), longest)
    return F.coalesce(F.when(is_code(pick), F.upper(pick)).otherwise(title_of(pick)), F.lit(""))


def award_group(text: Column) -> Column:
    return F.coalesce(*[F.when(_like(text, p), F.lit(g)) for p, g in AWARDS])


def course_name(title: Column, url: Column) -> Column:
    """The page's title up to the site's name, unless it says nothing or another award than the address; else the address's name."""
    t = F.trim(F.coalesce(title, F.lit("")))
    clean = F.substring_index(F.substring_index(t, "|", 1), " - ", 1)
    clean = F.regexp_replace(clean, rf"\s+20\d\d{EDGE}.*$", "")
    clean = F.trim(F.regexp_replace(clean, rf"(?i)\s+(full[-\s]?time|part[-\s]?time|distance learning|online){EDGE}.*$", ""))
    by_url, low = name_from_url(url), F.lower(url)
    against = (by_url != "") & F.coalesce(award_group(low) != award_group(clean), F.lit(False))
    return F.when((t != "") & ~_like(t, SAYS_NOTHING) & (F.length(clean) >= 3) & ~against, clean).otherwise(by_url)
