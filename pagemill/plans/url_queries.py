"""Queries over the URLs of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.functions import urls
from pagemill.plans import sqltext as S


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def f1_canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical form, hash, depth; of pages with one canonical form the first is no duplicate."""
    first = Window.partitionBy("canonical_url").orderBy("page_id")
    u = F.col("url")
    rows = _pages(spark, sf_dir).select("page_id", urls.canonical(u).alias("canonical_url"), urls.depth(u).cast("long").alias("depth"))
    return rows.withColumn("url_hash", F.sha2("canonical_url", 256)).withColumn("is_duplicate", F.row_number().over(first) > 1)


def f2_strip_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", urls.strip_tracking(F.col("url")).alias("shipped_url"))


def f4_url_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4 F5. The pages have no PDFs, so the PDF rule is also tried on each page's would-be prospectus."""
    u = F.col("url")
    pdf = F.concat(F.regexp_replace(u, r"[?#].*$", ""), F.lit("/prospectus.pdf"))
    return _pages(spark, sf_dir).select(
        "page_id", urls.extension(u).alias("extension"), urls.is_pdf(u).alias("is_pdf"), urls.is_dropped_type(u).alias("is_dropped"),
        urls.html_page_of_pdf(pdf).alias("html_page"),
    )


def f7_registrable_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rules for the domain that an institution owns."""
    h = urls.host(F.col("url"))
    return _pages(spark, sf_dir).select(
        "page_id", h.alias("host"), urls.registrable_domain(h).alias("registrable"), urls.registrable_by_rule(h).alias("by_rule"),
        urls.last_two_labels(h).alias("last_two"),
    )


def f10_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """country by the host's last label, where the map knows it."""
    return _pages(spark, sf_dir).select("page_id", urls_country(F.col("url")).alias("country"))


COUNTRIES = {"au": "Australia", "uk": "United Kingdom", "nz": "New Zealand", "ca": "Canada", "us": "United States", "ie": "Ireland", "in": "India",
             "sg": "Singapore", "my": "Malaysia", "de": "Germany", "fr": "France", "nl": "Netherlands", "es": "Spain", "it": "Italy", "jp": "Japan"}


def urls_country(url):
    known = F.create_map(*[F.lit(x) for pair in COUNTRIES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.regexp_extract(urls.host(url), r"\.([a-z]+)$", 1)), F.lit(""))


def f13_course_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The family of a page's yearly editions, and its year."""
    dated = F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.lit("/"), (F.lit(2020) + F.col("page_id") % 5).cast("string"))
    return _pages(spark, sf_dir).select("page_id", urls.family(dated).alias("family"), urls.year(dated).cast("long").alias("year"))


def f18_branch_yield_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and shallow pages by first segment."""
    u = F.col("url")
    return (
        _pages(spark, sf_dir)
        .groupBy(urls.branch(u).alias("branch"))
        .agg(F.count("*").alias("pages"), F.count_if(F.lower("html").contains("<article>")).alias("targets"), F.count_distinct(urls.host(u)).alias("hosts"))
    )


QUERIES = {
    f.__name__: f
    for f in (
        f1_canonical_url, f2_strip_tracking, f4_url_kinds, f7_registrable_domain, f10_country, f13_course_key, f18_branch_yield_counts,             )
}

_DATED = f"(regexp_replace(url, '[?#].*$', '') || '/' || cast(2020 + page_id % 5 as varchar))"
_CASES = " ".join(f"when '{k}' then '{v}'" for k, v in COUNTRIES.items())
SQL = {
    "f1_canonical_url": f"""select page_id, canonical_url, depth, sha256(canonical_url) as url_hash,
        row_number() over (partition by canonical_url order by page_id) > 1 as is_duplicate
        from (select page_id, {S.CANONICAL} as canonical_url, {S.DEPTH} as depth from pages)""",
    "f2_strip_tracking": f"""select page_id, {S.SCHEME} || '://' || {S.HOST} || {S.PATH} ||
        case when len({S.KEPT}) > 0 then '?' || array_to_string({S.KEPT}, '&') else '' end ||
        case when contains(url, '#') then '#' || regexp_extract(url, '#(.*)$', 1) else '' end as shipped_url from pages""",
    "f4_url_kinds": rf"""select page_id, ext as extension, ext = '.pdf' as is_pdf, ext in ({S.quoted(urls.DROPPED_TYPES)}) as is_dropped,
        rtrim(scheme || '://' || host || path, '/') as html_page
        from (select page_id, lower(regexp_extract({S.PATH}, '(\.[^./]*)$', 1)) as ext, {S.SCHEME} as scheme, {S.HOST} as host,
              case when {S.PATH} = '/' then null else {S.PATH} end as path from pages)""",
    "f7_registrable_domain": rf"""select page_id, {S.HOST} as host, {S.REGISTRABLE} as registrable,
        {S.last_labels(S.HOST, f"case when regexp_matches({S.HOST}, '{chr(92)}.(edu|ac|com|co|org|gov|net|sch|ed){chr(92)}.[a-z][a-z]$') then 3 else 2 end")} as by_rule,
        {S.last_labels(f"regexp_replace({S.HOST}, '^www{chr(92)}.', '')", '2')} as last_two from pages""",
    "f10_country": rf"select page_id, case regexp_extract({S.HOST}, '\.([a-z]+)$', 1) {_CASES} else '' end as country from pages",
    "f13_course_key": f"""select page_id, lower(host || '/' || array_to_string(list_filter(segs, lambda s: not regexp_matches(s, '^(19|20)[0-9][0-9]$')), '/')) as family,
        list_max(list_transform(list_filter(segs, lambda s: regexp_matches(s, '^(19|20)[0-9][0-9]$')), lambda s: cast(s as bigint))) as year
        from (select page_id, {S.HOST} as host, list_append({S.SEGMENTS.replace(S.PATH, "regexp_replace(" + S.PATH + ", '[?#].*$', '')")}, cast(2020 + page_id % 5 as varchar)) as segs from pages)""",
    "f18_branch_yield_counts": f"""select coalesce({S.SEGMENTS}[1], '') as branch, count(*) as pages,
        count(*) filter (where contains(lower(html), '<article>')) as targets, count(distinct {S.HOST}) as hosts from pages group by 1""",
}
