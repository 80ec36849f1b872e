"""Addresses in the data that pages carry along: JSON islands walked to their depth."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import urls

# Which islands hold data, keys whose bare values are addresses, levels and islands looked at.
ISLAND = re.compile(r"""<script\b[^>]*\btype\s*=\s*["'](?:application/json|application/ld\+json)["'][^>]*>([\s\S]*?)</script>""", re.I)
PAGE_DATA = re.compile(r"""<script\b[^>]*\bid\s*=\s*["']__NEXT_DATA__["'][^>]*>([\s\S]*?)</script>""", re.I)
URL_KEY = re.compile(r"(url|href|link|slug|path|permalink|canonical(?:Url)?|pageUrl|detailUrl|to)", re.I)
DEEPEST, MOST_ISLANDS = 12, 40

_ABSOLUTE, _ROOTED = re.compile(r"https?://", re.I), re.compile(r"/[^\s\"']*")


def _refuse(name: str) -> None:
    raise ValueError(name)  # NaN and infinities are no JSON


def addresses(value: object, deepest: int = DEEPEST) -> Iterator[str]:
    """Absolute and rooted addresses among the strings, and bare ones under address keys, in reading order.

    The walk keeps its own stack: a value nested without end takes no more than its own size.
    """
    stack: list[tuple[object, int]] = [(value, 0)]
    while stack:
        node, depth = stack.pop()
        if isinstance(node, _Found):
            yield node
        elif depth > deepest or node is None:
            continue
        elif isinstance(node, str):
            if _ABSOLUTE.match(node) or _ROOTED.fullmatch(node):
                yield node
        elif isinstance(node, list):
            stack.extend((v, depth + 1) for v in reversed(node))
        elif isinstance(node, dict):
            below: list[tuple[object, int]] = []
            for k, v in node.items():
                if isinstance(v, str) and v and URL_KEY.fullmatch(k) and not _ABSOLUTE.match(v) and not v.startswith("/"):
                    below.append((_Found(v), depth))
                below.append((v, depth + 1))
            stack.extend(reversed(below))


class _Found(str):
    """A bare address that its key has told."""

    __slots__ = ()


def islands(html: str) -> list[object]:
    """The page's own data first, then its islands; what is no JSON is left out."""
    first = PAGE_DATA.search(html)
    raw = [first.group(1)] if first else []
    raw += [m.group(1) for _, m in zip(range(MOST_ISLANDS), ISLAND.finditer(html), strict=False)]
    out = []
    for text in raw:
        try:
            out.append(json.loads(text.strip(), parse_constant=_refuse))
        except (ValueError, RecursionError):
            continue
    return out


def harvested(pages: DataFrame) -> DataFrame:
    """page_id, position and link: the distinct addresses of each page's data, resolved against the page (page_id, url, html).

    Null pages and pages without data give no rows; an address that resolves to no page is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, links, places, found = [], [], [], []
            for page, url, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                seen = dict.fromkeys(str(a) for island in islands(html or "") for a in addresses(island))
                for place, a in enumerate(seen):
                    ids.append(page)
                    links.append(url)
                    places.append(place)
                    found.append(a.encode("utf-8", "replace").decode())
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(links, pa.string()), pa.array(places, pa.int32()), pa.array(found, pa.string())], names=["page_id", "url", "position", "raw"])

    rows = pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, position int, raw string")
    rows = rows.select("page_id", "position", urls.resolve(F.col("raw"), F.col("url")).alias("link")).filter("link is not null")
    return rows.groupBy("page_id", "link").agg(F.min("position").alias("position"))
