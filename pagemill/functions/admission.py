"""What becomes of a link before it is read: whether its kind and place are worth it, and how a page has to be fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import urls
from pagemill.streaming.gates import editions

# Classes that are always read, sections that lead to them, statuses that block, characters of a page that has
# come whole, segments of requirements pages by likelihood.
TARGETS = (
    "COURSE_PAGE", "COURSE_LISTING", "ELIGIBILITY_PAGE", "ADMISSIONS_PAGE", "INTERNATIONAL_ADMISSIONS_PAGE", "SCHOLARSHIP_PAGE", "SCHOLARSHIP_LISTING", "FUNDING_PAGE",
)
HUBS = (
    r"(?i)(^|/)(courses?|programmes?|programs?|degrees?|study|find[-_]?(a[-_]?)?courses?|coursefinder|course[-_]?finder|faculties|faculty|schools?|departments?"
    r"|colleges?|international|overseas|admissions?|apply|entry[-_]?requirements?|how[-_]?to[-_]?apply|handbook|catalog(ue)?|scholarships?|funding"
    r"|fees[-_]?and[-_]?funding|financial[-_]?aid|bursar(y|ies)|fellowships?)(/|$|\?|\.)"
)
BLOCKED, WHOLE = (401, 403, 429, 503), 400
SEGMENTS = (
    "admission-requirements", "admissions-requirements", "entry-requirements", "entry-requirement", "admission-requirement", "requirements", "admission", "admissions",
    "eligibility", "entry", "how-to-apply", "international/entry-requirements", "international",
)
LIVE = r"(?i)(admission|requirement|eligib|entry|how-to-apply|international)"
EXTENSION = r"(?i)\.(html?|php|aspx?)$"


def worth_reading(url: Column, page_class: Column, disposition: Column, depth: Column, by_catalogue: bool = True) -> Column:
    """Whether a link found on a page is followed: extracted ones, target classes, first links and hubs; without a catalogue all."""
    if not by_catalogue:
        return F.lit(True)
    hub = F.coalesce(urls.path(url).rlike(HUBS), F.lit(False))
    return F.coalesce(disposition == "EXTRACT", F.lit(False)) | F.coalesce(page_class.isin(*TARGETS), F.lit(False)) | F.coalesce(depth <= 1, F.lit(False)) | hub


def admitted_links(links: DataFrame, by_catalogue: bool = True) -> DataFrame:
    """page_id and step: where each link (page_id, url, class, disposition, depth, allowed) is turned away, or that it is queued.

    In order: an address seen before under a smaller id, an older edition than the newest of its family, a class that the
    purpose doesn't allow, a place not worth reading. Malformed addresses are each their own.
    """
    key = F.coalesce(urls.canonical(F.col("url")), F.concat(F.lit("?"), F.col("page_id").cast("string")))
    first = links.groupBy(key.alias("key")).agg(F.min("page_id").alias("first"))
    dated = editions(links)
    newest = dated.groupBy("family").agg(F.max("year").alias("newest"))
    older = dated.join(newest, "family").filter("year < newest").select(F.col("page_id").alias("_older"))
    rows = links.withColumn("key", key).join(first, "key").join(older, F.col("page_id") == F.col("_older"), "left")
    step = (
        F.when(F.col("page_id") != F.col("first"), "duplicate").when(F.col("_older").isNotNull(), "older_edition").when(~F.col("allowed"), "class")
        .when(~worth_reading(F.col("url"), F.col("class"), F.col("disposition"), F.col("depth"), by_catalogue), "out_of_scope").otherwise("queued")
    )
    return rows.select("page_id", step.alias("step"))


def fast_enough(reached: Column, status: Column, challenged: Column, length: Column) -> Column:
    """null if a plain fetch of a page will do, else why it won't: dead pages will, empty shells won't."""
    return (
        F.when(~F.coalesce(reached, F.lit(False)), "network").when(F.coalesce(challenged, F.lit(False)), "challenge").when(status.isin(*BLOCKED), "blocked")
        .when(status >= 400, None).when(length < WHOLE, "thin")
    )


def requirement_candidates(url: Column) -> Column:
    """Addresses below a course's page where its requirements may stand, likeliest first: with the page's ending, without, as a folder."""
    clean = F.regexp_replace(url, "[?#].*$", "")
    ending = F.regexp_extract(clean, EXTENSION, 0)
    stem = F.regexp_replace(F.regexp_replace(clean, EXTENSION, ""), "/+$", "")
    each = [F.array(F.when(ending != "", F.concat(stem, F.lit(f"/{s}"), ending)), F.concat(stem, F.lit(f"/{s}")), F.concat(stem, F.lit(f"/{s}/"))) for s in SEGMENTS]
    return F.array_distinct(F.array_compact(F.flatten(F.array(*each))))


def still_there(status: Column, final_url: Column) -> Column:
    """Whether a candidate is a page of its own: answered well, and not sent on to a place that says nothing of requirements."""
    return F.coalesce(status.between(200, 299) & final_url.rlike(LIVE), F.lit(False))
