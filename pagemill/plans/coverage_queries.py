"""Queries over what has been found of each course's requirements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import coverage, urls
from pagemill.plans import sqltext as S

ENDS = ("/admission-requirements", "/entry", "/about", "/requirements/", "/x", "/International")


def _pages(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def c20_soft_not_found(spark, sf_dir):
    """C20: pages that answer with success though they are gone, by where they lead and by what they say, and the state of each link."""
    n, url = F.col("page_id"), F.col("url")
    home = F.concat(urls.scheme(url), F.lit("://"), urls.host(url), F.lit("/"))
    final = F.when(n % 5 == 0, home).when(n % 5 == 1, F.concat(home, F.lit("top"))).otherwise(url)
    status = F.when(n % 9 == 8, None).otherwise(F.element_at(F.array(*map(F.lit, (200, 200, 404, 403))), (n % 4).cast("int") + 1))
    html = F.concat(F.when(n % 7 == 0, "<title>Error 404</title>").when(n % 7 == 1, "<script>page not found</script>").when(n % 7 == 2, "<p>Sorry, this page <b>went").otherwise(""), F.col("html"))
    rows = _pages(spark, sf_dir).select("page_id", coverage.soft_not_found(F.concat(F.regexp_replace(url, r"[?#].*$", ""), F.lit("/deep")), final, status, html).alias("soft"), status.alias("s"))
    return rows.select("page_id", "soft", coverage.link_status(F.col("s"), F.col("soft")).alias("status"))


def c14_coverage_ladder(spark, sf_dir):
    """The rung that each page's course has reached, among pages of its host at candidate addresses."""
    n = F.col("page_id")
    base = F.concat(urls.scheme(F.col("url")), F.lit("://"), urls.host(F.col("url")), F.lit("/c/"))
    p = _pages(spark, sf_dir).select("page_id", urls.host(F.col("url")).alias("site"), F.concat(base, n.cast("string")).alias("own"))
    state = F.when(n % 13 == 0, "BROKEN_LINK").when(n % 5 == 0, "VALID_COURSE_PAGE").otherwise("QUEUED")
    courses = p.select(n.alias("link_id"), "site", F.col("own").alias("url"), state.alias("status"), F.when(n % 17 == 1, 404).otherwise(200).alias("http_status"))
    end = F.element_at(F.array(*map(F.lit, ENDS)), (n % len(ENDS)).cast("int") + 1)
    working = p.filter(n % 4 < 2).select("site", F.concat("own", end, F.lit("?x#y")).alias("url"))
    shared = p.filter(n % 3 == 0).select("site", F.concat("own", F.lit("/shared")).alias("url"), (n % 7).cast("double").alias("score"))
    return coverage.ladder(courses, working, shared).withColumnRenamed("link_id", "page_id")


def c22_deep_discovery(spark, sf_dir):
    """Which customers' orders, taken as a site's surface, validated targets and links, call for another pass."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = o.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("validated"))
    surface, links = F.col("orders") * (F.col("o_custkey") % 40), F.col("orders") * (F.col("o_custkey") % 90) * 3
    return rows.select("o_custkey", coverage.look_deeper(F.col("o_custkey") % 10 != 9, F.col("o_custkey") % 4, F.lit(3), surface, F.col("validated"), links).alias("again"))


QUERIES = {f.__name__: f for f in (c20_soft_not_found, c14_coverage_ladder, c22_deep_discovery)}

_GONE = coverage.GONE.replace("'", "''")
SQL = {
    "c20_soft_not_found": f"""with p as (select page_id, len({S.SEGMENTS.replace(S.PATH, "regexp_replace(" + S.PATH + ", '[?#].*$', '')")}) + 1 as deep, case page_id % 5 when 0 then 0 when 1 then 1 else {S.DEPTH} end as shallow,
        case when page_id % 9 = 8 then null else list_extract([200, 200, 404, 403], (page_id % 4 + 1)::int) end as status, substr(case page_id % 7 when 0 then '<title>Error 404</title>' when 1 then '<script>page not found</script>'
        when 2 then '<p>Sorry, this page <b>went' else '' end || html, 1, 60000) as html from pages),
        s as (select page_id, status, coalesce(status between 200 and 299, false) and (deep >= 2 and shallow = 0 or deep >= 3 and shallow <= 1
        or regexp_matches(substr(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '<[^>]+>', ' ', 'g'), 1, 4000), '{_GONE}') or regexp_matches(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '{_GONE}')) as soft from p)
        select page_id, soft, case when status is null then null when status = 403 then 'BLOCKED' when status = 404 or soft then 'BROKEN_LINK' end as status from s""",
    "c14_coverage_ladder": f"""with p as (select page_id, {S.HOST} as site, {S.SCHEME} || '://' || {S.HOST} || '/c/' || page_id as own, list_extract([{S.quoted(ENDS)}], (page_id % {len(ENDS)} + 1)::int) as tail from pages),
        s as (select site, first(own || '/shared' order by page_id % 7 desc, own || '/shared') as common from p where page_id % 3 = 0 group by site),
        v as (select p.*, common, page_id % 13 = 0 or page_id % 17 = 1 as dead, page_id % 4 < 2 and tail in ('/admission-requirements', '/entry', '/requirements/', '/International') as child, page_id % 5 = 0 as inside
        from p left join s using (site))
        select page_id, case when dead then 'NOT_FOUND' when child or inside then 'FOUND' when common is not null then 'SHARED' else 'NEEDS_REVIEW' end as status,
        case when dead then '' when child then own || tail || '?x#y' when inside then own when common is not null then common else '' end as requirements_url,
        case when dead then '' when child then 'requirements_page' when inside then 'inside_course_page' when common is not null then 'shared_page' else '' end as kind,
        case when dead then 0.3 when child then 0.97 when inside then 0.9 when common is not null then 0.7 else 0.3 end::double as confidence from v""",
    "c22_deep_discovery": """select o_custkey, o_custkey % 10 <> 9 and o_custkey % 4 < 3 and (validated = 0 or low and (links > 1000 or surface > 300 or surface >= 30)) as again
        from (select *, surface > 0 and validated::double / nullif(surface, 0) < 0.15 as low from (select o_custkey, count(*) filter (where o_orderstatus = 'F') as validated, count(*) * (o_custkey % 40) as surface,
        count(*) * (o_custkey % 90) * 3 as links from orders group by o_custkey))""",
}
