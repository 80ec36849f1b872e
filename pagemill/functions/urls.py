"""URL functions as column expressions. A URL is split by pattern; what has no scheme and host gives null parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters that only track, file types that are never pages, two-label public suffixes.
TRACKING = (
    "fbclid", "gclid", "mc_cid", "mc_eid", "session", "sid", "phpsessid", "jsessionid", "_ga", "_gl", "ref", "ref_src", "cid", "mkt_tok",
    "msclkid", "dclid", "wbraid", "gbraid", "igshid", "print",
)
TRACKING_PREFIX = "utm_"
DROPPED_TYPES = (
    ".doc", ".docx", ".ppt", ".pptx", ".zip", ".jpg", ".jpeg", ".png", ".gif", ".svg", ".mp4", ".mp3", ".avi", ".mov", ".css", ".js", ".ico",
    ".woff", ".woff2",
)
TWO_LABEL_SUFFIXES = (
    "edu.au", "com.au", "org.au", "net.au", "gov.au", "ac.uk", "co.uk", "org.uk", "gov.uk", "sch.uk", "ac.nz", "edu.nz", "ac.in", "edu.in", "co.in",
    "org.in", "ac.jp", "ed.jp", "edu.sg", "edu.my", "edu.ph", "ac.th", "edu.hk", "edu.cn", "ac.kr", "edu.tw", "ac.id", "edu.pk", "ac.pk", "edu.bd",
    "ac.bd", "edu.np", "edu.lk", "ac.lk", "ac.za", "edu.eg", "ac.ir", "edu.sa", "ac.ae", "edu.qa", "edu.kw", "edu.jo", "edu.lb", "edu.tr", "edu.mx",
    "edu.br", "com.br", "edu.co", "edu.ar", "edu.pe", "edu.ua", "edu.pl", "edu.ng", "edu.gh", "ac.ke", "edu.vn", "ac.at", "edu.ro", "edu.gr",
    "edu.rs", "edu.ge", "edu.kz", "edu.ba", "edu.mt", "edu.cy",
)
SECOND_LEVEL = r"^(edu|ac|com|co|org|gov|net|sch|ed)$"

ORIGIN = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)"


def scheme(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, ORIGIN, 1), F.lit("")))


def host(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, ORIGIN, 2), F.lit("")))


NOT_PAGES = r"(?i)^(mailto:|tel:|javascript:|data:|#)"


def _without_dots(found: Column) -> Column:
    """A path that starts with a slash, its . and .. segments worked off."""
    parts = F.split(F.substring(found, 2, F.lit(1 << 30)), "/")
    dot, up = (lambda s: F.lower(s).isin(".", "%2e")), (lambda s: F.lower(s).isin("..", ".%2e", "%2e.", "%2e%2e"))
    none = F.array().cast("array<string>")
    kept = F.aggregate(
        parts, none, lambda acc, s: F.when(up(s), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(dot(s), acc).otherwise(F.concat(acc, F.array(s)))
    )
    last = F.element_at(parts, -1)
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when((dot(last) | up(last)) & (F.size(kept) > 0), "/").otherwise(""))


def resolve(href: Column, base: Column) -> Column:
    """A link as it stands in a page, resolved against the page's URL as RFC 3986 says; null for links to no page.

    Scheme and host come out in lower case, without the scheme's own port; tabs and line ends inside go, blanks are escaped.
    """
    named = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)  # noqa: E731  # worked out once, however often it stands there
    trimmed = F.regexp_replace(F.trim(F.regexp_replace(href, r"[\t\r\n]", "")), r"^[\x00-\x20]+|[\x00-\x20]+$", "")

    def full(h: Column, b: Column) -> Column:
        own = F.regexp_extract(h, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
        directory = F.regexp_replace(path(b), r"[^/]*$", "")
        origin = F.concat(scheme(b), F.lit("://"), F.regexp_extract(b, ORIGIN, 2))
        return (
            F.when(h == "", None).when(h.rlike(NOT_PAGES), None).when(own != "", F.when(h.rlike("(?i)^https?://[^/?#]"), h))
            .when(F.startswith(h, F.lit("//")), F.concat(scheme(b), F.lit(":"), h)).when(F.startswith(h, F.lit("/")), F.concat(origin, h))
            .when(F.startswith(h, F.lit("?")), F.concat(origin, path(b), h)).otherwise(F.concat(origin, directory, h))
        )

    def clean(found: Column) -> Column:
        authority = F.regexp_replace(F.concat(scheme(found), F.lit("://"), host(found)), r"^(http://.*):80$|^(https://.*):443$", "$1$2")
        rest = F.regexp_extract(found, r"([?#].*)$", 1)
        whole = F.concat(authority, named(path(found), _without_dots), rest)
        return F.when(scheme(found).isin("http", "https"), F.replace(whole, F.lit(" "), F.lit("%20")))

    return named(trimmed, lambda h: named(F.regexp_replace(base, "#.*$", ""), lambda b: named(full(h, b), clean)))


def path(url: Column) -> Column:
    """The path, '/' for none; null without an origin."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    return F.when(host(url).isNotNull(), F.when(found == "", "/").otherwise(found))


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, r"#(.*)$", 1)


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def _kept(url: Column) -> Column:
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    return F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~name(p).isin(*TRACKING) & ~F.startswith(name(p), F.lit(TRACKING_PREFIX)))


def _with_query(base: Column, parameters: Column) -> Column:
    return F.concat(base, F.when(F.size(parameters) > 0, F.concat(F.lit("?"), F.array_join(parameters, "&"))).otherwise(F.lit("")))


def canonical(url: Column) -> Column:
    """Lower-case host, no fragment, no tracking parameters, the others by name, no slash at the end (but the root's)."""
    keyed = F.transform(_kept(url), lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), i.alias("i"), p.alias("p")))
    trimmed = F.when(path(url) == "/", F.lit("/")).otherwise(F.regexp_replace(path(url), "/+$", ""))
    return _with_query(F.concat(scheme(url), F.lit("://"), host(url), trimmed), F.transform(F.sort_array(keyed), lambda s: s["p"]))


def strip_tracking(url: Column) -> Column:
    """The URL without tracking parameters; order, path and fragment stay."""
    tail = F.when(F.instr(url, "#") > 0, F.concat(F.lit("#"), fragment(url))).otherwise(F.lit(""))
    clean = F.concat(_with_query(F.concat(scheme(url), F.lit("://"), host(url), path(url)), _kept(url)), tail)
    return F.coalesce(clean, url)


def url_hash(url: Column) -> Column:
    return F.sha2(canonical(url), 256)


def extension(url: Column) -> Column:
    return F.lower(F.regexp_extract(path(url), r"(\.[^./]*)$", 1))


def is_pdf(url: Column) -> Column:
    return extension(url) == ".pdf"


def is_dropped_type(url: Column) -> Column:
    return extension(url).isin(*DROPPED_TYPES)


def html_page_of_pdf(url: Column) -> Column:
    """The page that a PDF hangs below; null for other URLs and for PDFs at the root."""
    above = F.slice(segments(url), 1, F.greatest(F.size(segments(url)) - 1, F.lit(0)))
    return F.when(is_pdf(url) & (F.size(above) > 0), F.concat(scheme(url), F.lit("://"), host(url), F.lit("/"), F.array_join(above, "/")))


def depth(url: Column) -> Column:
    return F.size(segments(url))


def _last_labels(name: Column, n: Column | int) -> Column:
    parts = F.split(name, r"\.")
    wanted = F.least(F.lit(n) if isinstance(n, int) else n, F.size(parts))
    return F.array_join(F.slice(parts, F.size(parts) - wanted + 1, wanted), ".")


def registrable_domain(name: Column) -> Column:
    """The institution's domain: three labels below a two-label public suffix, else two."""
    name = F.regexp_replace(F.lower(name), r"^\.+|\.+$", "")
    return _last_labels(name, F.when(_last_labels(name, 2).isin(*TWO_LABEL_SUFFIXES), 3).otherwise(2))


def registrable_by_rule(name: Column) -> Column:
    """Three labels if a two-letter country stands behind a generic second level, else two."""
    parts = F.split(F.lower(name), r"\.")
    generic = F.element_at(parts, -1).rlike("^[a-z]{2}$") & F.try_element_at(parts, F.lit(-2)).rlike(SECOND_LEVEL)
    return _last_labels(F.lower(name), F.when(generic, 3).otherwise(2))


def last_two_labels(name: Column) -> Column:
    return _last_labels(F.regexp_replace(F.lower(name), r"^www\.", ""), 2)


def branch(url: Column) -> Column:
    """The first segment of the path, '' at the root."""
    return F.coalesce(F.get(segments(url), 0), F.lit(""))


YEAR = r"^(19|20)[0-9]{2}$"


def year(url: Column) -> Column:
    """The largest segment that is a year."""
    return F.array_max(F.transform(F.filter(segments(url), lambda s: s.rlike(YEAR)), lambda s: s.cast("int")))


def family(url: Column) -> Column:
    """Origin and path without years: the editions of a page share it."""
    plain = F.filter(segments(url), lambda s: ~s.rlike(YEAR))
    return F.lower(F.concat(host(url), F.lit("/"), F.array_join(plain, "/")))


# What a page number looks like in a link and in its words, and what an official site's address has.
PAGE_LINKS = (r"(?i)[?&]page=\d+", r"(?i)[?&]p=\d+", r"(?i)/page/\d+", r"(?i)[?&]start=\d+", r"(?i)[?&]offset=\d+")
PAGE_WORDS = (r"(?i)next", r"(?i)load\s*more", r"(?i)show\s*more", r"(?i)more\s*results", r"^\d+$")
OFFICIAL = (
    (r"\.edu(/|$|\.)", 50), (r"\.ac\.[a-z]{2}(/|$)", 50), (r"\.edu\.[a-z]{2}(/|$)", 45),
    (r"//[^/]*(uni-|\buniversity\b|\buniv\b|hochschule|universite|universidad|universita)", 12),
)


def origin_of(raw: Column) -> Column:
    """Scheme and host of an address as typed (https where it has none); '' where there is no host."""
    typed = F.trim(raw)
    full = F.when(typed.rlike("(?i)^https?://"), typed).otherwise(F.concat(F.lit("https://"), typed))
    return F.when(host(full).rlike(r"^[^\s]+$"), F.concat(scheme(full), F.lit("://"), host(full))).otherwise(F.lit(""))


def normal_url(raw: Column) -> Column:
    """An address as typed in its clean form, without the last slash; '' where there is no host."""
    typed = F.trim(raw)
    rest = F.regexp_replace(typed, "(?i)^(https?://)?[^/?#]*", "")
    return F.when(origin_of(raw) != "", F.regexp_replace(F.concat(origin_of(raw), F.when(rest.rlike("^[?#]"), F.lit("/")).otherwise(F.lit("")), rest), "/$", "")).otherwise(F.lit(""))


def official_score(url: Column) -> Column:
    """How likely an address is an institution's home page."""
    low = F.lower(url)
    score = sum((F.when(low.rlike(p), n).otherwise(0) for p, n in OFFICIAL), F.lit(0))
    return score + F.when(path(low) == "/", 8).otherwise(0) + F.when(depth(low) <= 1, 4).otherwise(0)


def is_pagination(url: Column, anchor: Column) -> Column:
    words = F.trim(F.coalesce(anchor, F.lit("")))
    linked, said = (F.array(*[c.rlike(p) for p in found]) for c, found in ((url, PAGE_LINKS), (words, PAGE_WORDS)))
    return F.exists(linked, lambda x: x) | (F.length(words).between(1, 16) & F.exists(said, lambda x: x))


def feed_key(url: Column) -> Column:
    """The key under which the feed shows a course once: host and path without years, the international variant with the plain one."""
    low = F.lower(url)
    plain = F.replace(F.regexp_replace(path(low), "/$", ""), F.lit("/international/courses/"), F.lit("/courses/"))
    kept = F.filter(F.split(plain, "/"), lambda s: ~s.rlike(YEAR))
    return F.coalesce(F.concat(host(low), F.array_join(kept, "/")), low)
