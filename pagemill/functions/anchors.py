"""Deep links: the section of a page that is about requirements, by its jump links or its ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions import text as X
from pagemill.functions import urls

# What a jump link says, in order of preference; ids in order of preference; affixes of tabs, panels and
# buttons; what makes an id or a link one of requirements.
SAYS = (
    r"(?i)international[^<]*(?:entry|requirement|criteri|eligib|qualif)", r"(?i)entry[\s-]*requirements?", r"(?i)entry[\s-]*criteri",
    r"(?i)admission[\s-]*requirements?", r"(?i)fees?\s*(?:and|&|\/)?\s*entry[\s-]*requirements?", r"(?i)how[\s-]*to[\s-]*apply", r"(?i)\bentry\b[^<]*requirement",
)
SPEAKS = r"(?i)entry|admission|requirement|criteri|eligib|how to apply"
IDS = (
    r"international.*(requirement|criteri|entry|eligib|qualif)", r"entry[-_ ]?requirement", r"entry[-_ ]?criteri", r"admission[-_ ]?requirement", r"admission[-_ ]?criteri",
    r"academic[-_ ]?requirement", r"how[-_ ]?to[-_ ]?apply", r"entry[-_ ]?profile", r"\brequirement", r"\beligib", r"\badmission", r"\bentry\b",
)
CHROME = (
    r"^(tab|tabs|panel|pane|accordion|collapse|collapsible|btn|button|heading|header|hdr|title|nav|navtab|link|section|sect|content|target|jump|toggle|menu|item|trigger|control|aria)[-_]"
    r"|[-_](tab|panel|pane|btn|button|link|heading|header|trigger|content)$"
)
ABROAD = r"requirement|criteri|entry|eligib|qualif|admission"
FRAGMENT = r"(?i)(entry|admission)[-_]?(requirements?|criteria)|^eligibility$"
REQUIREMENTS = r"(?i)(admission|entry)[-_\s]?(requirements?|criteria)"


def _all(html: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(group))


def _said(markup: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(markup, "<[^>]+>", " "), r"\s+", " "))


def _first_by(found: Column, patterns: tuple[str, ...], of=lambda x: x) -> Column:
    """The first item that the earliest pattern with any match finds."""
    matching = lambda p: F.filter(found, lambda x: of(x).rlike(p))
    return F.coalesce(*[F.get(matching(p), F.lit(0)) for p in patterns])


def jump_links(html: Column) -> Column:
    """target and text of the links to places on the page itself."""
    pattern = r"""(?is)<a\b[^>]*\bhref\s*=\s*["']#([A-Za-z0-9_-]{2,60})["'][^>]*>(.*?)</a>"""
    pairs = F.arrays_zip(_all(html, pattern, 1).alias("target"), _all(html, pattern, 2).alias("text"))
    return F.transform(pairs, lambda p: F.struct(F.lower(p["target"]).alias("target"), _said(p["text"]).alias("text")))


def requirements_anchor(html: Column, eligibility: tuple[str, ...], abroad: tuple[str, ...]) -> Column:
    """The id of a page's requirements section, null for none.

    A jump link whose words are about requirements names it; else the page's ids do, those without the affixes of tabs and
    buttons first, by the order of IDS, else the shortest (of equally short ones the first).
    """
    labelled = F.filter(jump_links(html), lambda p: p["text"].rlike(SPEAKS))
    named = _first_by(labelled, SAYS, lambda p: p["text"])["target"]
    ids = F.concat(_all(html, r"""(?:\bid|\bname)\s*=\s*["']([A-Za-z0-9_-]{3,60})["']""", 1), _all(html, r"""href\s*=\s*["']#([A-Za-z0-9_-]{3,60})["']""", 1))
    ids = F.array_distinct(F.transform(ids, F.lower))
    fit = F.filter(ids, lambda i: i.rlike(X.keyword_pattern(eligibility, loose=True)) | (i.rlike(X.keyword_pattern(abroad, loose=True)) & i.rlike(ABROAD)))
    clean = F.filter(fit, lambda i: ~i.rlike(CHROME))
    pool = F.when(F.size(clean) > 0, clean).otherwise(fit)
    shortest = F.array_min(F.transform(pool, lambda i, k: F.struct(F.length(i).alias("n"), k.alias("k"), i.alias("id"))))["id"]
    return F.coalesce(named, _first_by(pool, IDS), shortest)


def deep_link(url: Column, anchor: Column) -> Column:
    """The page's URL at the anchor, unchanged without one."""
    base = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "/$", "")
    return F.when(anchor.isNotNull(), F.concat(base, F.lit("#"), anchor)).otherwise(url)


def requirements_fragment(html: Column) -> Column:
    """Of the ids that say requirements the best scored: plain over tabs, exact over longer, short over long; the first of equals."""
    ids = F.filter(_all(html, r"""(?i)(?:id|name)\s*=\s*["']([^"']+)["']""", 1), lambda i: i.rlike(FRAGMENT))
    points = lambda i: (
        F.when(i.rlike("(?i)^(tab|panel|accordion|section|collapse|heading)[-_]"), -500).otherwise(0)
        + F.when(i.rlike("(?i)requirement"), 300).otherwise(0)
        + F.when(i.rlike("(?i)^(entry|admission)-requirements?$"), 500).otherwise(0)
        - F.length(i)
    )
    return F.array_max(F.transform(ids, lambda i, k: F.struct(points(i).alias("s"), (-k).alias("k"), i.alias("id"))))["id"]


def own_requirements_link(html: Column, url: Column) -> Column:
    """The first link of a page to requirements below its own path on its own host, without fragment; null for none."""
    stem = F.regexp_replace(F.regexp_replace(url, r"(?i)\.(html?|php|aspx?)$", ""), "/+$", "")
    own = F.regexp_replace(urls.path(stem), "/$", "")
    pattern = r"""(?is)<a\b[^>]*href\s*=\s*["']([^"']+)["'][^>]*>(.*?)</a>"""
    pairs = F.arrays_zip(_all(html, pattern, 1).alias("href"), _all(html, pattern, 2).alias("text"))
    fit = F.filter(pairs, lambda p: ~p["href"].startswith("#") & (F.regexp_replace(p["href"], "#.*$", "").rlike(REQUIREMENTS) | _said(p["text"]).rlike(REQUIREMENTS)))
    full = F.transform(fit, lambda p: F.regexp_replace(urls.resolve(p["href"], url), "#.*$", ""))
    path = lambda u: F.regexp_replace(urls.path(u), "/$", "")
    return F.get(F.filter(full, lambda u: (urls.host(u) == urls.host(url)) & (path(u) != own) & F.startswith(path(u), own)), F.lit(0))
