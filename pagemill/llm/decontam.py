"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may differ from a passage by e = floor(rate * m) edits. Cut into e + 1 pieces, at least one piece
of it then stands unharmed in the passage: an automaton over all pieces finds every exact hit in one pass over a text, the
hits of an item on neighbouring diagonals name a window, and Myers' bit-parallel distance decides it.

Items of fewer than LEAST characters ("Yes") stand in texts that never saw the benchmark: only a text that is such an item
as a whole holds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import lean

#: Edits per character of an item, the characters of items that one pass over the documents looks for, and of the shortest item.
#: An automaton of a million characters takes about 60 MB of a task and under a second to build.
RATE, BLOCK_CHARS, LEAST = 0.08, 1_000_000, 20


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(length: int, rate: float = RATE) -> int:
    return int(length * rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 consecutive pieces of nearly equal length, with their places."""
    n = min(errors + 1, len(item))
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """The least edit distance of the pattern to a part of the text, and where the first such part ends."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    eq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        eq[c] = eq.get(c, 0) | 1 << i
    up, down, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        x = eq.get(c, 0)
        v = x | down
        x |= (((x & up) + up) ^ up) | down
        h_up = down | ~(x | up) & full
        h_down = up & x
        if h_up & top:
            score -= -1
        elif h_down & top:
            score -= 1
        h_up = h_up << 1 & full
        h_down = h_down << 1 & full
        up = h_down | ~(v | h_up) & full
        down = h_up & v
        if score < best:
            best, end = score, j
    return best, end


class Items:
    """The items (id, normal text) of a block with the automaton over all their pieces; made once a task."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items, self.rate = items, rate
        self.short: dict[str, list[int]] = {}
        words: dict[str, list[tuple[int, int]]] = {}
        for i, (_, text) in enumerate(items):
            if len(text) < LEAST:
                self.short.setdefault(text, []).append(i)
                continue
            for at, piece in pieces(text, budget(len(text), rate)):
                words.setdefault(piece, []).append((i, at))
        self.found = ahocorasick.Automaton()
        for w, where in words.items():
            self.found.add_word(w, (len(w), where))
        self.found.make_automaton()
        self.any = bool(words)


def leaks_in(text: str, items: Items) -> list[tuple[int, int, int, int]]:
    """(index of the item, distance, start, end) of the best passage for each item that the text holds."""
    diagonals: dict[int, set[int]] = {}
    for end, (length, where) in items.found.iter(text) if items.any else ():
        for i, at in where:
            diagonals.setdefault(i, set()).add(end + 1 - length - at)
    out = [(i, 0, 0, len(text)) for i in items.short.get(text, ())]
    for i, starts in diagonals.items():
        item = items.items[i][1]
        errors = budget(len(item), items.rate)
        best = None
        ordered = sorted(starts)
        while ordered:
            # Hits at most `errors` diagonals after the first belong to one window.
            first = ordered[0]
            last = max(d for d in ordered if d <= first + errors)
            ordered = [d for d in ordered if d > last]
            lo, hi = max(0, first - errors), last + len(item) + errors
            distance, end = myers(item, text[lo:hi])
            if distance <= errors and (best is None or distance < best[1]):
                back = text[lo : lo + end][::-1]
                best = (i, distance, lo + end - myers(item[::-1], back[: len(item) + errors])[1], lo + end)
        if best:
            out.append(best)
    return out


def _blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The distinct items (id, normal text) that aren't null or blank, in blocks of about ``block_chars`` characters."""
    items = items.select(F.col("item_id").cast("long"), "text").filter(F.length(F.trim("text")) > 0).dropDuplicates()
    blocks = (items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars + 1
    for block in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).toLocalIterator()
        chosen = sorted((r["item_id"] if r["item_id"] is not None else -1, normal(r["text"])) for r in own)
        if chosen:
            yield chosen


def find_leaks(docs: DataFrame, items: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance, start, end: the best passage of each item in each document, in the normal text.

    Texts are lower-cased and their white space made single. Whole texts are searched. Null or blank items match nothing,
    null documents hold nothing; repeated rows repeat the result; an item without an id is -1. Items are looked for in blocks
    of at most ``block_chars`` characters, each block in one pass over the documents, so what a task holds is bounded.
    """
    schema = "doc_id long, item_id long, distance int, start int, end int"
    out = None
    source = docs.select(F.col("doc_id").cast("long"), "text")
    for chosen in _blocks(items, block_chars):
        found = source.mapInArrow(lean(_searcher(chosen, rate)), schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def _searcher(chosen: list[tuple[int, str]], rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]
        items = Items(chosen, rate)
        for batch in batches:
            rows = [
                (doc, chosen[i][0], distance, start, end)
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)
                for i, distance, start, end in leaks_in(normal(text.as_py()), items)
            ]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), types, strict=True)], names=[n for n, _ in types])

    return run


def drop_leaks(docs: DataFrame, items: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that hold no item, with all their columns; a row's own text decides, whatever its id."""
    at = docs.columns.index("text")

    def keeper(chosen: list[tuple[int, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items(chosen, rate)
            for batch in batches:
                yield batch.filter(pa.array([not leaks_in(normal(t.as_py()), items) for t in batch.column(at)], pa.bool_()))

        return run

    for chosen in _blocks(items, block_chars):
        docs = docs.mapInArrow(lean(keeper(chosen)), docs.schema)
    return docs
