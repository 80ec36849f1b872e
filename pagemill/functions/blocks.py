"""Pages as blocks in page order, and blocks as section chunks."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADINGS = {f"h{i}": i for i in range(1, 7)}
BLOCKS = {**dict.fromkeys(HEADINGS, "heading"), "p": "paragraph", "li": "list", "td": "table", "th": "table"}
#: Characters of a chunk's body, and of the shortest block that counts as content; pages whose blocks are held at once.
CHUNK, LEAST, PAGES = 6000, 25, 100


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int, str]] = []
        self.kind, self.level, self.text, self.hidden = "paragraph", 0, [], 0

    def _close(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.blocks.append((self.kind, self.level, text))
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title", "noscript"):
            self.hidden += 1
        elif tag in BLOCKS:
            self._close()
            self.kind, self.level = BLOCKS[tag], HEADINGS.get(tag, 0)

    def handle_endtag(self, tag):
        if tag in ("script", "style", "title", "noscript"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in BLOCKS or tag in ("div", "article", "ul", "ol", "table", "nav", "footer", "header", "section"):
            self._close()
            self.kind, self.level = "paragraph", 0

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)


def page_blocks(html: str | None) -> list[tuple[str, int, str]]:
    """(type, level, text) of the headings, paragraphs, list items and cells, in page order."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader._close()
    return reader.blocks


def blocks(pages: DataFrame) -> DataFrame:
    """page_id, block_no, type, level, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (batch.slice(a, PAGES) for batch in batches for a in range(0, batch.num_rows, PAGES))
        for part in parts:
            rows = [(p.as_py(), i, *b) for p, h in zip(part.column(0), part.column(1), strict=True) for i, b in enumerate(page_blocks(h.as_py()))]
            if rows:
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string()), strict=True)], names=["page_id", "block_no", "type", "level", "text"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, block_no int, type string, level int, text string")


def cleaned(found: DataFrame) -> DataFrame:
    """Without short blocks that are no headings, and without a page's repeated texts (the first stays)."""
    first = found.groupBy("page_id", "text").agg(F.min("block_no").alias("block_no"))
    return found.filter((F.col("type") == "heading") | (F.length("text") >= LEAST)).join(first, ["page_id", "text", "block_no"], "left_semi")


def chunks(found: DataFrame, most: int = CHUNK) -> DataFrame:
    """page_id, chunk_index, heading, body: blocks under their heading, bodies of at most ``most`` characters.

    A page's blocks are one row's array, as the page was one row; the cutting is by running lengths in the array.
    """
    one = found.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("block_no", "type", "text"))).alias("b"))
    zero = F.struct(F.lit(0).alias("section"), F.lit("").alias("heading"), F.array().cast("array<struct<section:int,heading:string,text:string>>").alias("out"))

    def step(acc, b):
        head = b["type"] == "heading"
        section = acc["section"] + F.when(head, 1).otherwise(0)
        heading = F.when(head, b["text"]).otherwise(acc["heading"])
        row = F.struct(section.alias("section"), heading.alias("heading"), b["text"].alias("text"))
        return F.struct(section.alias("section"), heading.alias("heading"), F.when(head, acc["out"]).otherwise(F.concat(acc["out"], F.array(row))).alias("out"))

    rows = one.select("page_id", F.posexplode(F.aggregate("b", zero, step)["out"]).alias("pos", "r"))
    bodies = rows.groupBy("page_id", F.col("r.section").alias("section"), F.col("r.heading").alias("heading")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.col("r.text").alias("t")))), lambda s: s["t"]), "\n").alias("body")
    )
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length("body") - 1) / most).cast("int")), lambda i: F.substring(F.col("body"), i * most + 1, F.lit(most)))
    cut = bodies.select("page_id", "section", "heading", F.posexplode(pieces).alias("piece", "body"))
    from pyspark.sql import Window

    return cut.select("page_id", (F.row_number().over(Window.partitionBy("page_id").orderBy("section", "piece")) - 1).alias("chunk_index"), "heading", "body")
