"""Pages as typed blocks in document order, with lists and tables as units, the page's links and the text that is seen."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import urls

TABLE = "struct<caption:string,headers:array<string>,rows:array<array<string>>>"
BLOCK = f"struct<type:string,level:int,text:string,items:array<string>,table:{TABLE}>"
SCHEMA = f"page_id long, title string, lang string, blocks array<{BLOCK}>, links array<struct<href:string,text:string>>, visible string"
_PA_TABLE = pa.struct([("caption", pa.string()), ("headers", pa.list_(pa.string())), ("rows", pa.list_(pa.list_(pa.string())))])
_PA_BLOCK = pa.struct([("type", pa.string()), ("level", pa.int32()), ("text", pa.string()), ("items", pa.list_(pa.string())), ("table", _PA_TABLE)])
_PA_LINK = pa.struct([("href", pa.string()), ("text", pa.string())])

# Titles that say nothing, phrases of page furniture, characters of the shortest paragraph kept.
JUNK_TITLE = r"(?i)^(error|loading|untitled|redirecting|please wait|just a moment|forbidden|access denied|page not found|not found|\d{3})$"
FURNITURE = (
    r"(?i)cookie", r"(?i)privacy policy", r"(?i)terms (of|&) (use|service)", r"(?i)all rights reserved", r"©\s*\d{4}", r"(?i)\bshare (on|via)\b",
    r"(?i)follow us", r"(?i)sign in", r"(?i)skip to (main )?content", r"(?i)back to top", r"(?i)subscribe to (our )?newsletter",
)
SHORTEST = 25

HIDDEN = {"script", "style", "noscript", "svg", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: A start tag ends an open element of these names, unless one of the second names stands between.
ENDS = {
    "li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
    "dt": ({"dt", "dd"}, {"dl", "ul", "ol", "table"}), "dd": ({"dt", "dd"}, {"dl", "ul", "ol", "table"}),
}
CLOSES_P = {"p", "ul", "ol", "table", "div", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "nav", "form", "blockquote", "pre", "dl", "hr", "main", "aside", "li", "dt", "dd", "figure", "figcaption"}
#: Elements whose text is seen, a line each, and what has lines of its own where it stands right in one of them.
SEEN = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "td", "th", "dt", "dd", "figcaption", "blockquote"}
APART = {"ul", "ol", "table"}


class _Elements(HTMLParser):
    """Elements in the order of their start tags. An element's text is a run of pieces, its descendants a run of elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.tags: list[str] = []
        self.attrs: list[dict] = []
        self.parent: list[int] = []
        self.start: list[int] = []  # first piece
        self.end: list[int] = []  # behind the last piece
        self.last: list[int] = []  # behind the last descendant
        self.open: list[int] = []
        self.hidden = 0

    def _close(self, place: int) -> None:
        for e in self.open[place:]:
            self.end[e], self.last[e] = len(self.pieces), len(self.tags)
        del self.open[place:]

    def _end_open(self, names: set[str], fence: set[str]) -> None:
        found = None
        for place in range(len(self.open) - 1, -1, -1):
            tag = self.tags[self.open[place]]
            if tag in names:
                found = place
            elif tag in fence:
                break
        if found is not None:
            self._close(found)

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        if self.hidden:
            return
        if tag in CLOSES_P:
            self._end_open({"p"}, {"table", "td", "th", "li", "div", "article", "section"})
        if tag in ENDS:
            self._end_open(*ENDS[tag])
        self.tags.append(tag)
        self.attrs.append({k: v or "" for k, v in reversed(attrs)})
        self.parent.append(self.open[-1] if self.open else -1)
        self.start.append(len(self.pieces))
        self.end.append(len(self.pieces))
        self.last.append(len(self.tags))
        if tag not in VOID:
            self.open.append(len(self.tags) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif not self.hidden:
            for place in range(len(self.open) - 1, -1, -1):
                if self.tags[self.open[place]] == tag:
                    return self._close(place)

    def handle_data(self, data):
        if not self.hidden:
            self.pieces.append(data)

    def text(self, e: int) -> str:
        return " ".join("".join(self.pieces[self.start[e] : self.end[e]]).split())

    def own_text(self, e: int) -> str:
        """The text without that of the lists and tables right in the element."""
        pieces, at, child = [], self.start[e], e + 1
        while child < self.last[e]:
            if self.tags[child] in APART:
                pieces += self.pieces[at : self.start[child]]
                at = self.end[child]
            child = self.last[child]
        return " ".join("".join(pieces + self.pieces[at : self.end[e]]).split())

    def visible(self) -> str:
        """The lines of text that are seen: in the main elements if there are any, else in the whole page."""
        until, lines = 0 if "main" in self.tags else len(self.tags), []
        for e, tag in enumerate(self.tags):
            if tag == "main":
                until = max(until, self.last[e])
            elif tag in SEEN and e < until and (text := self.own_text(e)):
                lines.append(text)
        return "\n".join(lines)

    def inside(self, e: int, names: set[str]) -> bool:
        while (e := self.parent[e]) >= 0:
            if self.tags[e] in names:
                return True
        return False

    def below(self, e: int, *names: str) -> list[int]:
        return [d for d in range(e + 1, self.last[e]) if self.tags[d] in names]


def _table(page: _Elements, e: int) -> dict:
    caption = page.below(e, "caption")
    headers = [h for h in page.below(e, "th") if page.inside(h, {"tr", "thead"})]
    rows = [[page.text(c) for c in page.below(r, "td")] for r in page.below(e, "tr")]
    return {"caption": page.text(caption[0]) if caption else None, "headers": [t for h in headers if (t := page.text(h))], "rows": [r for r in rows if r]}


def parsed(html: str | None) -> tuple[str, str | None, list[dict], list[dict], str]:
    """Title, language, blocks, links and visible text. A null or empty page has an empty title and nothing else."""
    page = _Elements()
    page.feed(html or "")
    page.close()
    page._close(0)
    blocks = []
    first = {}
    for e, tag in enumerate(page.tags):
        first.setdefault(tag, e)
        block = {"type": None, "level": None, "text": None, "items": None, "table": None}
        if tag in ("h1", "h2", "h3") and (text := page.text(e)):
            blocks.append(block | {"type": "heading", "level": int(tag[1]), "text": text})
        elif tag in ("p", "ul", "ol") and page.inside(e, {"table", "li"}):
            continue
        elif tag == "p" and (text := page.text(e)):
            blocks.append(block | {"type": "paragraph", "text": text})
        elif tag in ("ul", "ol"):
            items = [t for d in page.below(e, "li") if page.parent[d] == e and (t := page.text(d))]
            if items:
                blocks.append(block | {"type": "list", "items": items})
        elif tag == "table":
            blocks.append(block | {"type": "table", "table": _table(page, e)})
    title, h1 = (page.text(first[t]) if t in first else "" for t in ("title", "h1"))
    lang = page.attrs[first["html"]].get("lang") if "html" in first else None
    links = [{"href": page.attrs[e]["href"], "text": page.text(e)} for e, tag in enumerate(page.tags) if tag == "a" and "href" in page.attrs[e]]
    return (title if title and not re.search(JUNK_TITLE, title) else h1 or title), lang, blocks, links, page.visible()


def document(html: str | None) -> tuple[str, str | None, list[dict], list[dict]]:
    """Title, language, blocks and links."""
    return parsed(html)[:4]


def documents(pages: DataFrame) -> DataFrame:
    """SCHEMA of pages (page_id, html): each page is one row; a url stays with it."""
    url = [c for c in pages.columns if c == "url"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.list_(_PA_BLOCK), pa.list_(_PA_LINK), pa.string())
        names = ["page_id", "title", "lang", "blocks", "links", "visible", *url]
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                columns = zip(*[parsed(h) for h in part.column(1).to_pylist()], strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], *part.columns[2:]], names=names)

    return pages.select(F.col("page_id").cast("long"), "html", *url).mapInArrow(run, SCHEMA + "".join(f", {c} string" for c in url))


def blocks_of(markup: Column) -> Column:
    """The blocks of markup that comes as a column, as of what is put behind a page."""

    @F.arrow_udf(f"array<{BLOCK}>")
    def run(markup: pa.Array) -> pa.Array:
        parts = (markup.slice(a, 500).to_pylist() for a in range(0, len(markup), 500))
        return pa.chunked_array([pa.array([parsed(m)[2] for m in part], pa.list_(_PA_BLOCK)) for part in parts], pa.list_(_PA_BLOCK)).combine_chunks()

    return run(markup)


def resolved(links: Column, url: Column) -> Column:
    """A page's links as (url, text), resolved against the page's URL; those to no page go."""
    found = F.transform(links, lambda k: F.struct(urls.resolve(k["href"], url).alias("url"), k["text"].alias("text")))
    return F.filter(found, lambda k: k["url"].isNotNull())


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is worked out once, however often it stands there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _furniture(text: Column) -> Column:
    return F.exists(F.array(*[text.rlike(p) for p in FURNITURE]), lambda x: x)


def cleaned(blocks: Column) -> Column:
    """Without furniture, short paragraphs and a page's repeated paragraphs; tables stay, lists lose furniture and go when empty."""
    trimmed = F.transform(blocks, lambda b: b.withField("items", F.filter(F.transform(b["items"], lambda i: F.trim(i)), lambda i: (i != "") & ~_furniture(i))))
    fine = F.filter(
        trimmed,
        lambda b: (b["type"] == "table")
        | (b["type"] == "list") & (F.size(b["items"]) > 0)
        | (b["type"] == "heading") & ~_furniture(b["text"])
        | (b["type"] == "paragraph") & ~_furniture(b["text"]) & (F.length(b["text"]) >= SHORTEST),
    )
    key = lambda b: F.concat_ws(":", b["type"], F.lower(b["text"]))
    first = lambda found, keys: F.filter(found, lambda b, i: (b["type"] != "paragraph") | (F.array_position(keys, key(b)) == i + 1))
    return named(fine, lambda found: named(F.transform(found, key), lambda keys: first(found, keys)))


def table_text(table: Column) -> Column:
    """Caption, headers and rows as lines, cells between bars; a table of nothing is empty."""
    line = lambda cells: F.array_join(cells, " | ")
    head = F.array(table["caption"], F.when(F.size(table["headers"]) > 0, line(table["headers"])))
    return F.array_join(F.concat(F.filter(head, lambda x: F.coalesce(x, F.lit("")) != ""), F.transform(table["rows"], line)), "\n")


def blocks_text(blocks: Column) -> Column:
    """The blocks as plain text: headings behind their marks, list items behind dashes, tables as lines."""
    text = F.transform(
        blocks,
        lambda b: F.when(b["type"] == "heading", F.concat(F.lit("\n"), F.repeat(F.lit("#"), b["level"]), F.lit(" "), b["text"]))
        .when(b["type"] == "paragraph", b["text"])
        .when(b["type"] == "list", F.array_join(F.transform(b["items"], lambda i: F.concat(F.lit("- "), i)), "\n"))
        .otherwise(table_text(b["table"])),
    )
    return F.regexp_replace(F.regexp_replace(F.array_join(text, "\n"), "\n{3,}", "\n\n"), r"^\s+|\s+$", "")
