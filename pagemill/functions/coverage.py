"""How far a course's requirements have been found, and pages that answer well though they are gone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import admission, urls

# What a page says that isn't there, statuses of pages that hold requirements, addresses that say so.
GONE = (
    r"(?i)(page not found|404 error|error 404|page (you|you're|you are) looking for (can ?not|cannot|could not) be found|no longer available|does not exist"
    r"|page unavailable|page has moved|sorry,?\s+(this|the) page|content not found|we can'?t find)"
)
HOLDING = ("VALID_COURSE_PAGE", "POSSIBLE_REQUIREMENT_PAGE")
INSIDE = r"(?i)(entry[-_]?requirements?|entry[-_]?criteria|eligib|admission|how[-_]?to[-_]?apply|requirements?)"


def soft_not_found(url: Column, final_url: Column, status: Column, html: Column) -> Column:
    """Whether a page that answers with success is none: sent from deep down to the top, or saying that it isn't there."""
    deep, shallow = urls.depth(url), urls.depth(final_url)
    sent = (deep >= 2) & (shallow == 0) | (deep >= 3) & (shallow <= 1) & (urls.path(url) != urls.path(final_url))
    start = F.substring(F.coalesce(html, F.lit("")), 1, 60_000)
    text = F.substring(F.regexp_replace(F.regexp_replace(start, r"(?is)<script.*?</script>", " "), r"<[^>]+>", " "), 1, 4000)
    says = text.rlike(GONE) | F.regexp_extract(start, r"(?is)<title[^>]*>(.*?)</title>", 1).rlike(GONE)
    return F.coalesce(status.between(200, 299), F.lit(False)) & (F.coalesce(sent, F.lit(False)) | says)


def link_status(status: Column, soft: Column) -> Column:
    """What a probe says for sure of a link; null where it says nothing."""
    return F.when(status.isNull(), None).when(status.isin(403, 429), "BLOCKED").when(status.isin(404, 410) | soft, "BROKEN_LINK")


def is_dead(status: Column, http_status: Column) -> Column:
    return F.coalesce(status == "BROKEN_LINK", F.lit(False)) | F.coalesce(http_status.isin(404, 410), F.lit(False))


def ladder(courses: DataFrame, working: DataFrame, shared: DataFrame) -> DataFrame:
    """link_id, status, requirements_url, kind, confidence of courses (link_id, site, url, status, http_status).

    Dead ones are NOT_FOUND; then a working page (site, url) at the likeliest candidate address of the course that isn't the
    course itself; then the course's own page if its state or address says that it holds requirements; then the site's shared
    page (site, url, score; the best counts, ties by address); the rest needs review. Candidates meet working pages by a join on
    the address without query, case and last slash.
    """
    plain = lambda u: F.lower(F.regexp_replace(F.regexp_replace(u, "[?#].*$", ""), "/+$", ""))
    tries = courses.select("link_id", "site", plain(F.col("url")).alias("own"), F.posexplode(admission.requirement_candidates(F.col("url"))).alias("place", "candidate"))
    tries = tries.select("link_id", "site", "place", plain(F.col("candidate")).alias("key")).filter(F.col("key") != F.col("own"))
    known = working.filter("url is not null").groupBy("site", plain(F.col("url")).alias("key")).agg(F.min("url").alias("hit"))
    child = tries.join(known, ["site", "key"]).groupBy("link_id").agg(F.min_by("hit", "place").alias("child"))
    common = shared.filter("url is not null").groupBy("site").agg(F.min_by("url", F.struct(-F.coalesce("score", F.lit(0)), F.col("url"))).alias("common"))
    rows = courses.join(child, "link_id", "left").join(common, "site", "left")
    inside = F.coalesce(F.col("status").isin(*HOLDING), F.lit(False)) | F.col("url").rlike(INSIDE)
    rung = lambda status, url, kind, sure: F.struct(F.lit(status).alias("status"), url.cast("string").alias("requirements_url"), F.lit(kind).alias("kind"), F.lit(sure).alias("confidence"))
    none = F.lit("")
    found = (
        F.when(is_dead(F.col("status"), F.col("http_status")), rung("NOT_FOUND", none, "", 0.3)).when(F.col("child").isNotNull(), rung("FOUND", F.col("child"), "requirements_page", 0.97))
        .when(inside, rung("FOUND", F.col("url"), "inside_course_page", 0.9)).when(F.col("common").isNotNull(), rung("SHARED", F.col("common"), "shared_page", 0.7))
        .otherwise(rung("NEEDS_REVIEW", none, "", 0.3))
    )
    return rows.select("link_id", found.alias("f")).select("link_id", "f.*")


def look_deeper(enabled: Column, passes: Column, most_passes: Column, surface: Column, validated: Column, links: Column, least_surface: int = 30, ratio: float = 0.15) -> Column:
    """Whether another pass over a site pays: nothing was found; or it is large, or large enough to tell, and little was found."""
    low = F.when(surface > 0, validated / surface < ratio).otherwise(F.lit(False))
    large = (F.coalesce(links, F.lit(0)) > 1000) | (surface > 300)
    return F.coalesce(enabled & (passes < most_passes) & ((validated == 0) | large & low | (surface >= least_surface) & low), F.lit(False))
