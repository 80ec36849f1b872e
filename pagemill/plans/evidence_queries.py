"""Queries over pages and their evidence: traced snippets, embedded data, documents as blocks, deep links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import anchors, harvest, tree, urls
from pagemill.operators import snippets
from pagemill.plans import sqltext as S


def _t(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _items(spark, sf_dir) -> DataFrame:
    """Benchmark items, their first four words and their last word."""
    b = _t(spark, sf_dir, "benchmark")
    words = F.split("text", " ")
    first = b.select((-1 - F.col("item_id")).alias("item_id"), F.array_join(F.slice(words, 1, 4), " ").alias("item"))
    last = b.select((-1000000 - F.col("item_id")).alias("item_id"), F.element_at(words, -1).alias("item"))
    return b.select("item_id", F.col("text").alias("item")).unionByName(first).unionByName(last)


def g20_snippet_match(spark, sf_dir):
    """Benchmark items, and their first words and last words, that stand whole in documents."""
    return snippets.contained_items(_t(spark, sf_dir, "documents"), _items(spark, sf_dir))


def g20_fuzzy_windows(spark, sf_dir):
    """Benchmark items against all documents, traced by the best window where they don't stand whole."""
    items = _t(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    traced = snippets.trace_items(_t(spark, sf_dir, "documents"), items)
    return traced.select("doc_id", "item_id", "contained", F.round("similarity", 6).alias("similarity"), F.round("best", 6).alias("best"), (F.col("similarity") >= 0.85).alias("valid"))


def d6_deep_harvest(spark, sf_dir):
    """Addresses in the data that each page carries, here an island made from its id, nested to the last level read and beyond."""
    n = F.col("page_id").cast("string")
    nested = lambda depth: F.concat(F.lit("[" * depth + '"/level-' + str(depth) + "/"), n, F.lit('"' + "]" * depth))
    island = F.concat(
        F.lit('<script type="application/json">{"props":{"slug":"item-'), n, F.lit('","list":[{"url":"../up/'), n, F.lit('","name":"plain word"},["/a/b c",{"to":"https://x.org/'), n,
        F.lit('"}]]},"last":'), nested(11), F.lit(',"lost":'), nested(12), F.lit("}</script>"),
    )
    pages = _t(spark, sf_dir, "pages").select("page_id", "url", F.concat(F.coalesce("html", F.lit("")), island).alias("html"))
    return harvest.harvested(pages).select("page_id", "link", F.col("position").cast("long").alias("position"))


def _is(kind: str):
    return lambda b: b["type"] == kind


def _cells(*values):
    """A row of a table in HTML; a null is an empty cell."""
    escaped = lambda v: F.replace(F.replace(F.coalesce(v.cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), escaped(v)) for v in values])


def d12_page_text(spark, sf_dir):
    """Each page as blocks, with a table put behind it (host and depth of the page, then of each of its links, with the link's first word); cleaned and written out."""
    rows = tree.documents(_t(spark, sf_dir, "pages").select("page_id", "url", "html")).withColumn("links", tree.resolved(F.col("links"), F.col("url")))
    of_links = F.transform("links", lambda k: _cells(urls.host(k["url"]), urls.depth(k["url"]), F.substring_index(k["text"], " ", 1)))
    table = F.concat(
        F.lit("<table><caption>Page "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("</caption><tr><th>Host<th>Depth<th>First word"),
        _cells(urls.host(F.col("url")), urls.depth(F.col("url"))), F.array_join(of_links, ""), F.lit("</table>"),
    )
    rows = rows.withColumn("kept", tree.cleaned(F.concat("blocks", tree.blocks_of(table))))
    kinds = {k: F.size(F.filter("kept", _is(k))) for k in ("heading", "paragraph", "list", "table")}
    counts = [c.cast("long").alias(f"{k}s") for k, c in (kinds | {"link": F.size("links")}).items()]
    return rows.select("page_id", "title", "lang", *counts, F.col("visible").alias("visible_text"), tree.blocks_text(F.col("kept")).alias("text"))


VOCABULARY = ("eligibility", "entry requirements", "entry requirement", "entry criteria", "admission requirements", "how to apply", "admission", "admissions")
ABROAD = ("international", "overseas")


def _sections(spark, sf_dir) -> DataFrame:
    """Pages with sections and links of the kinds that pages of courses have, dealt by the page's number."""
    n = F.col("page_id")
    own = F.regexp_replace("url", r"[?#].*$", "")
    part = (
        F.when(n % 5 == 0, '<a href="#c161699">Fees and <b>entry requirements</b></a><a href="#other">How to apply</a>')
        .when(n % 5 == 1, '<div id="tab-entry-requirements"></div><h2 id="entry-requirements">x</h2><p id="international-entry-criteria">y</p>')
        .when(n % 5 == 2, F.concat(F.lit('<a href="'), own, F.lit('/admission-requirements.html#top">More</a><a href="/other/entry-requirements">no</a>')))
        .when(n % 5 == 3, '<a name="panel-admission"></a><section id="how_to_apply"></section>')
        .otherwise("<p>nothing here</p>")
    )
    return _t(spark, sf_dir, "pages").select("page_id", "url", F.concat(F.coalesce("html", F.lit("")), part).alias("html"))


def d14_anchor(spark, sf_dir):
    """The requirements section of each page, the deep link to it, the best fragment and the page's own requirements page."""
    html, url = F.col("html"), F.col("url")
    rows = _sections(spark, sf_dir).select("page_id", "url", anchors.requirements_anchor(html, VOCABULARY, ABROAD).alias("anchor"), anchors.requirements_fragment(html).alias("fragment"), anchors.own_requirements_link(html, url).alias("own_page"))
    return rows.select("page_id", "anchor", anchors.deep_link(url, F.col("anchor")).alias("deep_link"), "fragment", "own_page")


QUERIES = {f.__name__: f for f in (g20_snippet_match, g20_fuzzy_windows, d6_deep_harvest, d12_page_text, d14_anchor)}
SQL = {
    "g20_snippet_match": """with i as (select item_id, text as item from benchmark union all select -1 - item_id, array_to_string(list_slice(string_split(text, ' '), 1, 4), ' ') from benchmark
        union all select -1000000 - item_id, list_extract(string_split(text, ' '), -1) from benchmark) select distinct doc_id, item_id from documents d join i on contains(d.text, item)""",
    "d6_deep_harvest": f"""with p as (select page_id, {S.SCHEME} || '://' || {S.HOST} as origin, {S.PATH} as path from pages),
        d as (select page_id, origin, regexp_replace(path, '[^/]*$', '') as directory, regexp_replace(regexp_replace(path, '[^/]*$', ''), '[^/]+/$', '') as above from p)
        select page_id, link, position::bigint as position from (select page_id, unnest([origin || directory || 'item-' || page_id, origin || above || 'up/' || page_id,
        'https://x.org/' || page_id, origin || '/level-11/' || page_id]) as link, unnest([0, 1, 2, 3]) as position from d)""",
    "d14_anchor": r"""select page_id, anchor, case when anchor is null then url else regexp_replace(regexp_replace(url, '#.*$', ''), '/$', '') || '#' || anchor end as deep_link,
        case page_id % 5 when 1 then 'entry-requirements' end as fragment, case page_id % 5 when 2 then regexp_replace(url, '[?#].*$', '') || '/admission-requirements.html' end as own_page
        from (select *, case page_id % 5 when 0 then 'c161699' when 1 then 'international-entry-criteria' when 3 then 'how_to_apply' end as anchor from pages)""",
}
