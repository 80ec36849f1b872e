"""Resolution, document trees, harvested addresses and traced snippets, each against a plain version."""

import json
import random
from collections import Counter
from urllib.parse import urljoin, urlsplit
from xml.etree import ElementTree

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagemill.functions import blocks, harvest, tree, urls
from pagemill.operators import snippets

HREFS = [
    "../courses", "x", "./x", "../../../x", "?q=1", "/r/../s", "//other.org/a", "http://Z.org", "HTTPS://z.org:443/a/../b", "http://z.org:80", "a/b/", "a/./b/..", "..",
    ".", "a?x=../y", "a#f", "/a b", "x/../../y#z", "/", "http://z.org?q", "/%2e%2e/up",
]
BASES = ["https://example.edu/admissions/index", "https://example.edu", "http://e.org/a/b/c/?q=1#f", "http://E.org/a/b;c"]


def test_links_resolve(spark):
    rows = [(h, b) for h in HREFS for b in BASES]
    got = spark.createDataFrame(rows, "h string, b string").select("h", "b", urls.resolve(F.col("h"), F.col("b")).alias("r")).collect()
    for h, b, r in got:
        u = urlsplit(urljoin(b, h.replace("%2e", ".")))
        host = u.netloc.lower().removesuffix(":80" if u.scheme == "http" else ":443")
        tail = f"?{u.query}" * bool(u.query) + f"#{u.fragment}" * bool(u.fragment)
        assert r == (urljoin(f"{u.scheme}://{host}/", u.path or "/") + tail).replace(" ", "%20"), (h, b)


def test_links_to_no_page(spark):
    rows = [(h,) for h in ("mailto:a@b.com", "tel:+1", "#top", "JavaScript:void(0)", "data:x", "ftp://a.org/x", "", "  ", None)]
    got = spark.createDataFrame(rows, "h string").select(urls.resolve(F.col("h"), F.lit("https://a.org/x")).alias("r")).collect()
    assert [r[0] for r in got] == [None] * len(rows)
    assert spark.createDataFrame([("a//b",)], "h string").select(urls.resolve(F.col("h"), F.lit("https://a.org/x/y"))).first()[0] == "https://a.org/x/a//b"
    blanks = spark.createDataFrame([(" \n a\t b ",)], "h string").select(urls.resolve(F.col("h"), F.lit("https://a.org/x/y"))).first()[0]
    assert blanks == "https://a.org/x/a%20b"


def random_markup(rng, depth=0):
    kind = rng.choice(["p", "h1", "h2", "h3", "h4", "ul", "ol", "table", "div", "a", "text"] if depth < 5 else ["text", "p"])
    some = lambda n=3: "".join(random_markup(rng, depth + 1) for _ in range(rng.randint(0, n)))
    if kind == "text":
        return rng.choice(["some words ", " a &amp; b", "\n x \t y ", "A paragraph that is long enough to be content. "])
    if kind == "p":
        return f"<p>{rng.choice(['short', 'A paragraph that is long enough to be content.', 'Accept each cookie that we offer you here'])}<b> bold</b></p>"
    if kind in ("ul", "ol"):
        return f"<{kind}>" + "".join(f"<li>{some(2)}</li>" for _ in range(rng.randint(0, 3))) + f"</{kind}>"
    if kind == "table":
        rows = "".join("<tr>" + "".join(f"<{c}>{some(1)}</{c}>" for c in rng.choices(["td", "td", "th"], k=rng.randint(0, 3))) + "</tr>" for _ in range(rng.randint(0, 3)))
        return f"<table>{rng.choice(['', '<caption>Cap <i>tion</i></caption>'])}{rng.choice([rows, f'<tbody>{rows}</tbody>', f'<thead>{rows}</thead>'])}</table>"
    if kind == "a":
        return f'<a href="/x{rng.randint(0, 9)}">link {rng.randint(0, 9)}</a>'
    return f"<{kind}>{some()}</{kind}>"


def plain_document(html):
    """The same blocks by another parser, over the parsed tree."""
    root = ElementTree.fromstring(html)
    above = {c: p for p in root.iter() for c in p}
    text = lambda e: " ".join("".join(e.itertext()).split())

    def inside(e, names):
        while (e := above.get(e)) is not None:
            if e.tag in names:
                return True
        return False

    blocks = []
    for e in root.iter():
        if e.tag in ("h1", "h2", "h3") and text(e):
            blocks.append(("heading", int(e.tag[1]), text(e), None, None))
        elif e.tag == "p" and not inside(e, {"table", "li"}) and text(e):
            blocks.append(("paragraph", None, text(e), None, None))
        elif e.tag in ("ul", "ol") and not inside(e, {"table", "li"}):
            if items := [text(x) for x in e if x.tag == "li" and text(x)]:
                blocks.append(("list", None, None, items, None))
        elif e.tag == "table":
            caption = next((text(x) for x in e.iter("caption")), None)
            headers = [text(x) for x in e.iter("th") if text(x)]
            rows = [[text(c) for c in r.iter("td")] for r in e.iter("tr")]
            blocks.append(("table", None, None, None, (caption, headers, [r for r in rows if r])))
    return blocks, [(a.get("href"), text(a)) for a in root.iter("a")]


def plain_text(blocks):
    """Cleaned and written out, block by block."""
    import re

    junk = lambda t: any(re.search(p, t) for p in tree.FURNITURE)
    seen, parts = set(), []
    for kind, level, text, items, table in blocks:
        if kind == "table":
            lines = [x for x in (table[0], " | ".join(table[1])) if x] + [" | ".join(r) for r in table[2]]
            parts.append("\n".join(lines))
        elif kind == "list":
            if kept := [i for i in items if not junk(i)]:
                parts.append("\n".join(f"- {i}" for i in kept))
        elif not junk(text) and (kind == "heading" or len(text) >= 25 and text.lower() not in seen):
            seen |= {text.lower()} if kind == "paragraph" else set()
            parts.append(f"\n{'#' * level} {text}" if kind == "heading" else text)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(parts)).strip()


def test_documents_equal_another_parser(spark):
    rng = random.Random(7)
    pages = [f"<html lang='en'><body>{''.join(random_markup(rng) for _ in range(6))}</body></html>" for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").repartition(3)
    found = tree.documents(df)
    assert found.schema["blocks"].dataType.simpleString() == f"array<{tree.BLOCK}>"
    rows = found.select("*", tree.blocks_text(tree.cleaned(F.col("blocks"))).alias("written")).collect()
    assert sum(len(b.table.rows) for r in rows for b in r["blocks"] if b.type == "table") > 20
    for r in rows:
        blocks, links = plain_document(pages[r["page_id"]])
        got = [(b.type, b.level, b.text, b["items"], b.table and (b.table.caption, b.table.headers, b.table.rows)) for b in r["blocks"]]
        assert got == blocks and [tuple(x) for x in r["links"]] == links and r["lang"] == "en"
        assert r["written"] == plain_text(blocks)


def test_documents_of_careless_markup():
    title, lang, blocks, links = tree.document("<title>Error</title><h1>Real name</h1><p>one<p>two<table><tr><td>a<td>b<tr><th>h</table><ul><li>x<li>y</ul><script>p</script>")
    assert (title, lang, links) == ("Real name", None, [])
    assert [(b["type"], b["text"] or b["items"] or b["table"]) for b in blocks] == [
        ("heading", "Real name"), ("paragraph", "one"), ("paragraph", "two"), ("table", {"caption": None, "headers": ["h"], "rows": [["a", "b"]]}), ("list", ["x", "y"]),
    ]
    assert tree.document(None) == tree.document("") == ("", None, [], [])
    assert len(tree.document("<div>" * 5000 + "<p>deep</p>")[2]) == 1


def plain_addresses(node, depth=0):
    if depth > 12 or node is None:
        return
    if isinstance(node, str):
        if node.lower().startswith(("http://", "https://")) or node.startswith("/") and not any(c in node for c in " \n\t\"'"):
            yield node
    elif isinstance(node, list):
        for v in node:
            yield from plain_addresses(v, depth + 1)
    elif isinstance(node, dict):
        for k, v in node.items():
            if isinstance(v, str) and v and k.lower() in ("url", "slug", "to") and not v.lower().startswith(("http://", "https://", "/")):
                yield v
            yield from plain_addresses(v, depth + 1)


def random_json(rng, depth=0):
    kind = rng.choice("sssnldddd" if depth < 15 else "s")
    if kind == "s":
        return rng.choice(["/a/b", "/has blank", "http://x.org/1", "HTTPS://y.org", "word", "", "../up", "bsc-nursing", "/it's"]) + rng.choice(["", str(rng.randrange(50))])
    if kind == "n":
        return rng.choice([None, 1, True, 2.5])
    if kind == "l":
        return [random_json(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice(["url", "slug", "Slug", "name", "to", "items"]): random_json(rng, depth + 1) for _ in range(rng.randint(0, 4))}


def test_addresses_equal_a_recursive_walk():
    rng = random.Random(2)
    found = 0
    for _ in range(400):
        value = random_json(rng)
        want = list(plain_addresses(value))
        assert [str(a) for a in harvest.addresses(value)] == want
        found += len(want)
    deep = "/end"
    for _ in range(12):
        deep = [deep]
    assert list(harvest.addresses(deep)) == ["/end"] and not list(harvest.addresses([deep])) and found > 300


def test_harvested_pages(spark):
    island = lambda v, kind="application/ld+json": f'<script type="{kind}">{v if isinstance(v, str) else json.dumps(v)}</script>'
    pages = [
        (1, "https://a.org/c/list", f'<SCRIPT id="__NEXT_DATA__" type="x">{{"slug": "first"}}</SCRIPT>' + island({"url": "../x", "a": ["/y", "/y", "mailto:q"]}, "application/json")),
        (2, "https://a.org/", island("{broken") + island('{"url": NaN}') + island({"url": "ok"}) + island({"url": "no"}, "text/javascript")),
        (3, "https://a.org/", "".join(island([f"/{i}"]) for i in range(45))), (4, "https://a.org/", None), (5, None, island(["/x", "https://b.org/x"])),
    ]
    rows = harvest.harvested(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    by_page = {}
    for r in sorted(rows, key=lambda r: (r["page_id"], r["position"])):
        by_page.setdefault(r["page_id"], []).append(r["link"])
    assert by_page.pop(3) == [f"https://a.org/{i}" for i in range(40)]
    assert by_page == {1: ["https://a.org/c/first", "https://a.org/x", "https://a.org/y"], 2: ["https://a.org/ok"], 5: ["https://b.org/x"]}


def plain_dice(a, b):
    a, b = snippets.normal(a), snippets.normal(b)
    if a == b:
        return 1.0
    if min(len(a), len(b)) < 2:
        return 0.0
    x, y = (Counter(s[i : i + 2] for i in range(len(s) - 1)) for s in (a, b))
    return 2 * sum((x & y).values()) / (len(a) + len(b) - 2)


def plain_trace(item, text, threshold):
    """All windows of the text, one by one."""
    item, text = snippets.normal(item), snippets.normal(text)
    if not item or len(text) < len(item):
        return None
    if item in text:
        return True, 1.0, 1.0
    each = [plain_dice(item, text[i : i + len(item)]) for i in range(len(text) - len(item) + 1)]
    if len(item) < 2 or max(each) < threshold:
        return None
    stepped = each[:: max(1, len(item) // 4)]
    return False, next((x for x in stepped if x >= threshold), max(stepped)), max(each)


@pytest.mark.parametrize(("seed", "threshold", "block"), [(1, 0.85, 500_000), (2, 0.7, 60), (3, 0.6, 500_000)])
def test_traces_equal_all_windows(spark, seed, threshold, block):
    rng = random.Random(seed)
    words = "alpha beta gamma delta epsilon zeta of the in a é 日本".split()
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 14)))) for i in range(25)] + [(90, ""), (91, None), (92, "é"), (1, "other text of one")]
    texts = []
    for d in range(60):
        t = [rng.choice(words) for _ in range(rng.choice([0, 5, 30, 60]))]
        if rng.random() < 0.8:
            edited = list(rng.choice(items[:25])[1])
            for _ in range(rng.randint(0, 6)):
                edited[rng.randrange(len(edited))] = rng.choice("xyz a\n")
            t.insert(rng.randrange(len(t) + 1), "".join(edited).upper())
        texts.append((d, " ".join(t)))
    texts += [(70, None), (71, ""), (0, texts[0][1])]
    traced = snippets.trace_items(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item string"), threshold, block)
    got = {}
    for r in traced.collect():
        got.setdefault((r["doc_id"], r["item_id"]), []).append((r["contained"], r["similarity"], r["best"]))
    want = {}
    for d, t in dict.fromkeys(texts):
        for i, item in items:
            if found := plain_trace(item, t, threshold):
                want.setdefault((d, i), []).append(found)
    assert set(got) == set(want) and sum(not x[0][0] for x in want.values()) > 5
    for k, found in want.items():
        for (c, s, b), (wc, ws, wb) in zip(sorted(got[k]), sorted(found), strict=True):
            assert c == wc and b == pytest.approx(wb) and (s >= threshold) == (ws >= threshold) and (s == pytest.approx(ws) or s < threshold)


PAGE = "Admission requirements: Applicants must have completed Grade 12 with Mathematics and a minimum overall average of 75%. IELTS 6.5 overall is required for English."


def test_records_without_a_source_lose_confidence(spark):
    items = [(1, "minimum overall average of 75%"), (2, "minimum overall average of 75 percent"), (3, "a degree in basket weaving with no requirements")]
    traced = snippets.trace_items(spark.createDataFrame([(1, PAGE)], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item string"), 0.7)
    records = spark.createDataFrame([(1, i, 0.9) for i, _ in items] + [(2, 1, 0.2)], "doc_id long, item_id long, confidence double")
    got = {(r["doc_id"], r["item_id"]): r for r in snippets.validated(records, traced, 0.7).collect()}
    assert got[1, 1]["similarity"] == 1.0 and 0.7 < got[1, 2]["similarity"] < 1
    assert [got[k]["confidence"] for k in ((1, 1), (1, 2), (1, 3), (2, 1))] == [0.9, 0.9, 0.3, 0.2]
    assert [got[k]["review_status"] for k in ((1, 1), (1, 3), (2, 1))] == ["PENDING", "NEEDS_REVIEW", "NEEDS_REVIEW"]


def test_sections_and_their_links(spark):
    from pagemill.functions import anchors

    pages = [
        ('<a href="#Opaque1">Fees <i>and</i> entry requirements</a><a href="#x2">International entry criteria</a>', "x2", None),
        ('<p id="tab-entry-requirements"><p id="entry_requirements-list"><p id="admission">', "entry_requirements-list", "entry_requirements-list"),
        ('<p id="panel-admissions-tab">', "panel-admissions-tab", None), ('<p id="campus"><p id="international">', None, None), (None, None, None), ("", None, None),
        ('<p id="section-admission-criteria"><p id="Entry-Requirements">', "entry-requirements", "Entry-Requirements"), ('<p id="overseas-qualifications">', "overseas-qualifications", None),
    ]
    html = F.col("html")
    words = ("entry requirements", "admission", "admissions", "admission criteria"), ("international", "overseas")
    rows = spark.createDataFrame([(i, h) for i, (h, *_) in enumerate(pages)], "i int, html string")
    got = {r["i"]: r for r in rows.select("i", anchors.requirements_anchor(html, *words).alias("a"), anchors.requirements_fragment(html).alias("f")).collect()}
    assert [(got[i]["a"], got[i]["f"]) for i in range(len(pages))] == [(a, f) for _, a, f in pages]
    links = [
        ("https://a.org/c/bsc.html", '<a href="bsc/entry-requirements#x">a</a>', "https://a.org/c/bsc/entry-requirements"), ("https://a.org/c/bsc", '<a href="/c/bsc/x?y">Entry requirements</a>', "https://a.org/c/bsc/x?y"),
        ("https://a.org/c/bsc", '<a href="https://b.org/c/bsc/entry-requirements">a</a><a href="#entry-requirements">b</a><a href="/c/entry-requirements">c</a>', None),
    ]
    rows = spark.createDataFrame(links, "url string, html string, want string")
    assert all(r[0] == r[1] for r in rows.select("want", anchors.own_requirements_link(html, F.col("url"))).collect())
    linked = rows.select(anchors.deep_link(F.lit("https://a.org/x/#old"), F.lit("id")), anchors.deep_link(F.lit("https://a.org/x/#old"), F.lit(None).cast("string"))).first()
    assert tuple(linked) == ("https://a.org/x#id", "https://a.org/x/#old")


def test_bound_leaves_few_strips():
    """Texts of the items' own words: nearly no strip is left for exact counts, and all that hold an edited item are."""
    rng = random.Random(11)
    words = ["".join(rng.choice("etaoinshrdlu" * 3 + "cmfwypvbgkjqxz") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    said = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, said(35)) for i in range(40)]
    texts = [said(rng.randrange(5, 3000)) for _ in range(30)]
    for d in range(0, 30, 3):
        words_of = items[d][1].split()
        words_of[5] = "xyzzy"
        texts[d] += " " + " ".join(words_of) + " " + said(50)
    found = snippets.Items(items, 0.85)
    near = found.near(texts)
    strips = sum(len(t) // snippets.STRIP for t in texts)
    assert all(items[d][1] in near[d] for d in range(0, 30, 3))
    assert sum(len(s) for by_item in near for s in by_item.values()) < 0.005 * strips * len(items)
    assert {(d, i) for d, i, *_ in found.trace(texts)} >= {(d, d) for d in range(0, 30, 3)}


def test_blocks_of_a_batch_come_in_parts():
    """No task holds the blocks of a whole batch of pages."""

    class Pages:
        select = lambda self, *_: self
        mapInArrow = lambda self, run, _: run

    batch = pa.RecordBatch.from_pydict({"page_id": list(range(950)), "html": ["<p>one</p><p>two</p>"] * 949 + [None]})
    got = list(blocks.blocks(Pages())([batch]))
    assert sum(b.num_rows for b in got) == 2 * 949 and max(b.num_rows for b in got) <= 2 * blocks.PAGES


def test_cleaning_judges_each_text_once(spark):
    """Lines of furniture are looked for once in each block, not again for each other block of its page."""
    rows = tree.documents(spark.createDataFrame([(1, "<p>x</p>")], "page_id long, html string")).select(tree.cleaned(F.col("blocks")))
    plan = rows._jdf.queryExecution().analyzed().toString().lower()
    assert 0 < plan.count("rlike") <= 6 * len(tree.FURNITURE)  # twice as many where blocks are cleaned again for their keys


def test_a_link_is_taken_apart_once(spark):
    """The parts of a link and its base are named, not written out again at each place that needs them."""
    rows = spark.createDataFrame([("../x", "https://a.org/b/c")], "href string, base string").select(urls.resolve(F.col("href"), F.col("base")).alias("link"))
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert rows.first()["link"] == "https://a.org/x" and plan.count("base#") < 5 and plan.count("href#") < 5


def plain_visible(html):
    """The lines that are seen, by another parser, over the parsed tree."""
    root = ElementTree.fromstring(html)
    places = {c for m in root.iter("main") for c in m.iter() if c is not m} if root.find(".//main") is not None else set(root.iter())
    own = lambda e: (e.text or "") + "".join(("" if c.tag in ("ul", "ol", "table") else "".join(c.itertext())) + (c.tail or "") for c in e)
    lines = [" ".join(own(e).split()) for e in root.iter() if e in places and e.tag in "h1 h2 h3 h4 h5 h6 p li td th dt dd figcaption blockquote".split()]
    return "\n".join(x for x in lines if x)


def test_visible_text_equals_another_parser(spark):
    rng = random.Random(5)

    def some():
        kind = rng.choice(["{}", "{}", "<main>{}</main>", "<main><div>{}</div><main>x {}</main></main>", "<dl><dt>{}</dt><dd>{} tail</dd></dl>", "<blockquote>{} of</blockquote>", "<figure><figcaption>{}</figcaption></figure>"])
        return kind.replace("{}", random_markup(rng))

    pages = [f"<html lang='en'><head><title>Of the page</title></head><body>{''.join(some() for _ in range(rng.randint(0, 6)))}</body></html>" for _ in range(150)]
    rows = tree.documents(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").repartition(3)).select("page_id", "visible").collect()
    assert {r["page_id"]: r["visible"] for r in rows} == {i: plain_visible(p) for i, p in enumerate(pages)}
    assert tree.parsed("<p>one<figure><figcaption>two</figure><dl><dt>a<dd>b<script>no</script><dt>c</dl><ul><li>x<ul><li>y</ul>z<li>w</ul>")[4].split("\n") == ["one", "two", "a", "b", "c", "xz", "y", "w"]


def test_page_text_ends_in_the_table_of_its_links(spark, tmp_path):
    """Links count where they lead to a page, and each is a row of the table, whatever the page leaves open or has as its URL."""
    from pagemill.plans import evidence_queries

    links = '<html lang="de"><nav><a href="../x?q">Away  from here</a><a href="mailto:a@b.c">Mail us</a><a href="#top">Top</a></nav><p>Short<p><a href="https://B.org/c/d">&lt;td&gt;R&amp;D| now</a><a href="/"> </a>'
    pages = [(1, "https://a.org/b/c/", links), (2, None, links), (3, "https://a.org/b", None), (None, "https://a.org/b", "<h1>Head</h1><script>open")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r for r in evidence_queries.d12_page_text(spark, str(tmp_path)).collect()}
    head = "Host | Depth | First word"
    assert got[1]["text"] == f"Page 1\n{head}\na.org | 2\na.org | 2 | Away\nb.org | 2 | <td>R&D|\na.org | 0 |"
    assert got[2]["text"] == f"Page 2\n{head}\n | \nb.org | 2 | <td>R&D|"
    assert (got[3]["text"], got[None]["text"]) == (f"Page 3\n{head}\na.org | 1", f"# Head\nPage\n{head}\na.org | 1")
    assert [(got[k]["links"], got[k]["tables"], got[k]["lang"], got[k]["visible_text"]) for k in (1, 2, 3, None)] == [
        (3, 1, "de", "Short\n<td>R&D| now"), (1, 1, "de", "Short\n<td>R&D| now"), (0, 1, None, ""), (0, 1, None, "Head"),
    ]
