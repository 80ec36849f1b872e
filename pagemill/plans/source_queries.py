"""Queries that go through sources and sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import urls
from pagemill.plans import sqltext as S
from pagemill.sources import seeds, sinks


def _t(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _place(spark) -> str:
    """A folder of its own where executors and driver both write: the shared one, or a temporary one in a local session."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(shared or tempfile.mkdtemp()).rstrip('/')}/{uuid.uuid4().hex}"


def k3_csv_round_trip(spark, sf_dir):
    """Suppliers written as quoted CSV and read again."""
    path = _place(spark)
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.concat(F.lit('said "'), "s_name", F.lit('", twice')).alias("remark"))
    sinks.write_quoted_csv(s, path)
    return spark.read.schema("s_suppkey long, s_name string, remark string").option("header", True).option("escape", '"').csv(path)


def k5_export_by_group(spark, sf_dir):
    """Customers in a folder for each segment, read again and counted."""
    path = _place(spark)
    sinks.write_by_group(_t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), path, "c_mktsegment")
    return spark.read.option("header", True).csv(path).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.min("c_name").alias("first_name"))


def k6_report_lines(spark, sf_dir):
    """K6: nations by region as lines of a report."""
    n, r = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region")
    return sinks.markdown_lines(n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey), "r_name", F.col("n_name")).select("value")


def s3_seed_roles(spark, sf_dir):
    """Customers under odd headers get their roles; rows without an address are told apart."""
    c = _t(spark, sf_dir, "customer")
    odd = c.select(F.col("c_name").alias("Institution Name"), F.when(F.col("c_custkey") % 7 != 0, F.concat(F.lower("c_mktsegment"), F.lit(".example.org"))).alias("Web Site"), F.col("c_nationkey").alias("Nation"))
    good, bad = seeds.split_seeds(seeds.with_roles(odd))
    return good.withColumn("fault", F.lit("")).unionByName(bad).groupBy("base_url", "fault").agg(F.count("*").alias("n"))


def s16_sitemap(spark, sf_dir):
    """Locations of one sitemap a host, made from its pages."""
    p = _t(spark, sf_dir, "pages").select(urls.host(F.col("url")).alias("file"), F.concat(F.lit("<url><loc> "), urls.canonical(F.col("url")), F.lit(" </loc></url>")).alias("x"))
    files = p.groupBy("file").agg(F.array_join(F.collect_list("x"), "\n").alias("text"))
    return seeds.sitemap_locations(files)


ROBOTS = "User-agent: other\nDisallow: /\n\nUser-agent: *\nUser-agent: pagebot\nDisallow: /en/*1\nAllow: /en/ # all of it\nDisallow: /fr\nDisallow: /de/*5$\n"


def s17_robots(spark, sf_dir):
    """One robots file for every host, applied to the paths."""
    p = _t(spark, sf_dir, "pages").select(urls.host(F.col("url")).alias("host"), urls.path(F.col("url")).alias("path")).distinct()
    rules = seeds.robots_rules(p.select("host").distinct().withColumn("text", F.lit(ROBOTS)))
    return seeds.robots_decisions(p, rules)


QUERIES = {f.__name__: f for f in (k3_csv_round_trip, k5_export_by_group, k6_report_lines, s3_seed_roles, s16_sitemap, s17_robots)}
SQL = {
    "k3_csv_round_trip": """select s_suppkey, s_name, 'said "' || s_name || '", twice' as remark from supplier""",
    "k5_export_by_group": "select c_mktsegment, count(*) as n, min(c_name) as first_name from customer group by 1",
    "k6_report_lines": """select '## ' || r_name || ' (' || count(*) || ')' as value from nation join region on n_regionkey = r_regionkey group by r_name
        union all select '- ' || n_name from nation join region on n_regionkey = r_regionkey""",
    "s3_seed_roles": """select base_url, fault, count(*) as n from (select case when c_custkey % 7 <> 0 then 'https://' || lower(c_mktsegment) || '.example.org' end as base_url,
        case when c_custkey % 7 <> 0 then '' else 'no address' end as fault from customer) group by 1, 2""",
    "s16_sitemap": f"select {S.HOST} as file, {S.CANONICAL} as location, false as is_index from pages",
    "s17_robots": f"""select distinct host, path, not (starts_with(path, '/fr') or (regexp_matches(path, '^/de/.*5$')) or (starts_with(path, '/en/') and regexp_matches(path, '^/en/.*1')))
        as allowed from (select {S.HOST} as host, {S.PATH} as path from pages)""",
}
