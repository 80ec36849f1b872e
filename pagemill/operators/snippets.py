"""Tracing short texts to their sources: an item stands whole in a text, or a window of the text is nearly it.

Nearly is a Dice similarity over bigrams, counted as multisets, of the item and a window of its length. Windows are told
apart by the strip of the text in which they start; the bigrams of the few strips that such windows reach bound what any of
them can share, and one matrix product bounds all items against all strips, over the bigrams that many strips lack
(what an item has besides them counts as shared). Only where the bound reaches the threshold are windows counted, exactly.
Items are a query set: they are taken in blocks of bounded size, each held against all texts in one pass.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of items in a block, places of a strip, columns that bound, copies of a bigram told apart, rows of a product,
#: characters of texts taken together, pieces of a strip.
BLOCK_CHARS, STRIP, COLUMNS, LEVELS, ROWS, TOGETHER, PIECES = 500_000, 32, 768, 3, 2048, 500_000, 4
FOUND = "doc_id long, item_id long, contained boolean, similarity double, best double, place long"
_SPACE = re.compile(r"\s+")


def normal(text: str | None) -> str:
    return _SPACE.sub(" ", (text or "").lower()).strip()


def _codes(text: str) -> np.ndarray:
    """A number for each bigram."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return (c[:-1] << 21) | c[1:]


def _spots(grams: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Which of the sorted grams each code is, or -1."""
    spot = np.minimum(np.searchsorted(grams, codes), len(grams) - 1)
    return np.where(grams[spot] == codes, spot, -1)


class Item:
    """An item's bigrams in order, with their numbers."""

    def __init__(self, text: str):
        self.length = len(text)
        self.grams, self.most = np.unique(_codes(text), return_counts=True)

    def spots(self, codes: np.ndarray) -> np.ndarray:
        return _spots(self.grams, codes)

    def most_shared(self, known: np.ndarray) -> int:
        return int(np.minimum(np.bincount(known[known >= 0], minlength=len(self.most)), self.most).sum())

    def similarities(self, known: np.ndarray, blank: np.ndarray) -> np.ndarray:
        """Dice of the item and each window of its length. blank: where the text has spaces; one at an end isn't the window's."""
        m = self.length
        windows = len(blank) - m + 1
        here = np.zeros((len(self.grams), len(known) + 1), np.int16)
        at = np.flatnonzero(known >= 0)
        here[known[at], at + 1] = 1
        np.cumsum(here, axis=1, out=here)
        inside = here[:, m - 1 : m - 1 + windows] - here[:, :windows]
        head, tail = blank[:windows], blank[m - 1 : m - 1 + windows]
        for gone, gram in ((head, known[:windows]), (tail, known[m - 2 : m - 2 + windows])):
            w = np.flatnonzero(gone & (gram >= 0))
            inside[gram[w], w] -= 1
        shared = np.minimum(inside, self.most[:, None]).sum(axis=0)
        length = m - head - tail
        return np.where(length >= 2, 2.0 * shared / (m - 1 + np.maximum(length - 1, 1)), 0.0)


class Items:
    """A block's items, made ready once a task."""

    def __init__(self, items: list[tuple[int, str]], threshold: float):
        import ahocorasick

        self.threshold = threshold
        self.by_text: dict[str, list[int]] = {}
        for i, text in items:
            if text:
                self.by_text.setdefault(text, []).append(i)
        self.whole = ahocorasick.Automaton()
        for text in self.by_text:
            self.whole.add_word(text, text)
        if self.by_text:
            self.whole.make_automaton()
        groups: dict[int, list[str]] = {}
        for text in self.by_text:
            if len(text) >= 2:
                groups.setdefault(1 + -(-(len(text) - 2) // STRIP), []).append(text)  # strips that windows from one strip reach
        self.parts = {text: Item(text) for texts in groups.values() for text in texts}
        self.texts = sorted(groups.items())
        self.groups: list[tuple] | None = None

    def choose(self, codes: np.ndarray) -> None:
        """Which bigrams, at which numbers of copies, tell strips apart, judged by some text; any choice bounds rightly.

        A column is a bigram and a number of copies; what an item has outside the columns counts as shared.
        """
        all_grams = np.unique(np.concatenate([i.grams for i in self.parts.values()]))
        held = np.zeros((LEVELS, len(all_grams)), np.int64)
        for item in self.parts.values():
            at = np.searchsorted(all_grams, item.grams)
            for k in range(LEVELS):
                held[k, at] += item.most > k
        spots = _spots(all_grams, codes)
        often = np.bincount(spots[spots >= 0], minlength=len(all_grams)) / max(1, len(codes))
        expected = often * STRIP * float(np.median([reach for reach, _ in self.texts]))
        fewer = np.exp(-expected)[None, :] * np.cumsum([expected**k / math.factorial(k) for k in range(LEVELS)], axis=0)
        worth = held * fewer
        best = np.argsort(-worth, axis=None, kind="stable")[:COLUMNS]
        level, gram = np.unravel_index(best[worth.ravel()[best] > 0], worth.shape)
        self.columns = all_grams[np.unique(gram)]
        gram = np.searchsorted(self.columns, all_grams[gram])
        self.of_level = [np.arange(len(self.columns)), *(np.sort(gram[level == k]) for k in range(1, LEVELS))]
        starts = np.cumsum([0, *(len(g) for g in self.of_level)])
        self.groups = []
        for reach, texts in self.texts:
            has, own = np.zeros((starts[-1], len(texts)), np.float32), []
            for i, text in enumerate(texts):
                item = self.parts[text]
                most = np.zeros(len(self.columns), np.int64)
                known = _spots(self.columns, item.grams) if len(self.columns) else np.full(len(item.grams), -1)
                most[known[known >= 0]] = item.most[known >= 0]
                for k, grams in enumerate(self.of_level):
                    has[starts[k] : starts[k + 1], i] = most[grams] > k
                at = np.flatnonzero(most)
                reached = -(-(STRIP + len(text) - 2) // (STRIP // PIECES))
                own.append((at, most[at], reached, self.threshold * (len(text) - 2) - (len(text) - 1 - most.sum()) - 1e-3))
            outside = np.array([len(t) - 1 for t in texts]) - has.sum(axis=0)
            need = np.array([self.threshold * (len(t) - 2) for t in texts]) - outside - 1e-3
            self.groups.append((reach, texts, has.T.copy(), need.astype(np.float32), own))

    def contained(self, text: str) -> set[str]:
        return {found for _, found in self.whole.iter(text)} if self.by_text else set()

    def suspects(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(group, item, strips) where a window that starts in the strip could be near the item."""
        strips, width, piece = -(-len(codes) // STRIP), len(self.columns), STRIP // PIECES
        most = max(g[0] for g in self.groups)
        spots = _spots(self.columns, codes) if width else np.full(len(codes), -1)
        for a in range(0, strips, ROWS):
            n = min(ROWS, strips - a)
            part = spots[a * STRIP : (a + n + most) * STRIP]
            at = np.flatnonzero(part >= 0)
            pieces = (n + most) * PIECES
            sums = np.zeros((width, pieces + 1), np.int32)
            each = np.bincount(part[at] * pieces + at // piece, minlength=pieces * width).reshape(width, pieces)
            np.cumsum(each.astype(np.int32), axis=1, out=sums[:, 1:])
            whole = sums[:, ::PIECES].copy()
            for g, (reach, _, has, need, own) in enumerate(self.groups):
                counts = whole[:, reach : reach + n] - whole[:, :n]
                there = np.empty((has.shape[1], n), np.float32)
                there[:width] = counts > 0
                place = width
                for k, grams in enumerate(self.of_level[1:], 1):
                    there[place : place + len(grams)] = np.take(counts, grams, axis=0) > k
                    place += len(grams)
                items, rows = np.nonzero(has @ there >= need[:, None])
                cuts = np.searchsorted(items, np.arange(len(own) + 1))
                for i in np.flatnonzero(np.diff(cuts)):  # the same over the very places that such windows reach
                    grams, copies, reached, least = own[i]
                    here = rows[cuts[i] : cuts[i + 1]]
                    start = here * PIECES
                    shared = np.minimum(sums[np.ix_(grams, start + reached)] - sums[np.ix_(grams, start)], copies[:, None])
                    here = here[shared.sum(axis=0) >= least]
                    if len(here):
                        yield g, int(i), a + here

    def near(self, texts: list[str]) -> list[dict[str, list[int]]]:
        """For each text the strips in which windows near an item could start. Texts are searched together, each from a strip of its own."""
        first, padded, strips = [], [], 0
        for text in texts:
            codes = _codes(text) if len(text) > 1 else np.zeros(0, np.int64)
            first.append(strips)
            padded += [codes, np.full(-len(codes) % STRIP, -1, np.int64)]
            strips += -(-len(codes) // STRIP)
        codes = np.concatenate(padded) if padded else np.zeros(0, np.int64)
        if self.groups is None and len(codes) and self.parts:
            self.choose(codes)
        found: list[dict[str, list[int]]] = [{} for _ in texts]
        for g, i, at in self.suspects(codes) if self.groups else ():
            item = self.groups[g][1][i]
            for d, strip in zip((np.searchsorted(first, at, side="right") - 1).tolist(), at.tolist(), strict=True):
                if len(texts[d]) >= len(item):
                    found[d].setdefault(item, []).append(strip - first[d])
        return found

    def trace(self, texts: list[str]) -> Iterator[tuple[int, int, bool, float, float, int]]:
        """(number of the text, item_id, contained, similarity, best, place)."""
        d = 0
        while d < len(texts):
            end, chars = d + 1, len(texts[d])
            while end < len(texts) and chars + len(texts[end]) <= TOGETHER:
                chars += len(texts[end])
                end += 1
            for number, *found in self._trace(texts[d:end]):
                yield d + number, *found
            d = end

    def _trace(self, texts: list[str]) -> Iterator[tuple[int, int, bool, float, float, int]]:
        whole = [self.contained(t) for t in texts]
        for d, found in enumerate(whole):
            for item in found:
                for i in self.by_text[item]:
                    yield d, i, True, 1.0, 1.0, texts[d].find(item)
        for d, near in enumerate(self.near(texts)):
            text = texts[d]
            near = {item: strips for item, strips in near.items() if item not in whole[d]}
            if near:
                codes = _codes(text)
                blank = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") == 32
            for item, strips in near.items():
                best, place, step, stepped = 0.0, 0, max(1, len(item) // 4), 0.0
                own = self.parts[item]
                first: tuple[int, float] | None = None
                for strip in strips:
                    a = strip * STRIP
                    end = min(len(text), a + STRIP + len(item) - 1)
                    known = own.spots(codes[a : end - 1])
                    if end - a < len(item) or own.most_shared(known) < self.threshold * (len(item) - 2) - 1e-9:
                        continue
                    values = own.similarities(known, blank[a:end])
                    k = int(values.argmax())
                    if values[k] > best:
                        best, place = float(values[k]), a + k
                    for w in range(-a % step, len(values), step):
                        stepped = max(stepped, float(values[w]))
                        if values[w] >= self.threshold and (first is None or a + w < first[0]):
                            first = a + w, float(values[w])
                if best >= self.threshold:
                    for number in self.by_text[item]:
                        yield d, number, False, first[1] if first else stepped, best, place


def trace_items(docs: DataFrame, items: DataFrame, threshold: float = 0.85, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, contained, similarity, best, place: items (item_id, item) traced to texts (doc_id, text).

    Case and runs of white space don't count. ``best`` is the highest similarity of any window and ``place`` where it starts;
    ``similarity`` looks only at windows a quarter of the item apart, from the text's start, and is that of the first that
    reaches the threshold: a reader that steps accepts a row when its similarity does. Rows have a best of the threshold at
    least. Blank items and null texts trace to nothing; items of one character only as a whole; an item longer than a
    text isn't near it. Equal rows of either side give one row.
    """
    once = items.select(F.col("item_id").cast("long"), F.col("item").cast("string")).filter("trim(item) != ''").distinct()
    out = None
    for block in _blocks(once, block_chars):
        rows = [(r["item_id"], normal(r["item"])) for r in block.collect()]  # about block_chars characters

        def run(batches: Iterator[pa.RecordBatch], rows: list[tuple[int, str]] = rows) -> Iterator[pa.RecordBatch]:
            found = None
            for batch in batches:
                found = found or Items(rows, threshold)
                for a in range(0, batch.num_rows, 500):
                    part = batch.slice(a, 500)
                    ids = part.column(0).to_pylist()
                    hits = [(ids[d], *h) for d, *h in found.trace([normal(t) for t in part.column(1).to_pylist()])]
                    if hits:
                        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.float64(), pa.float64(), pa.int64())
                        columns = [pa.array(c, k) for c, k in zip(zip(*hits, strict=True), kinds, strict=True)]
                        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in FOUND.split(", ")])

        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FOUND)
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def validated(records: DataFrame, traced: DataFrame, threshold: float = 0.85, doubtful: float = 0.3) -> DataFrame:
    """Evidence records (doc_id, item_id, confidence) with ``traced`` and ``similarity``; a snippet that can't be traced to its
    own document leaves a confidence of ``doubtful`` at most and sends the record to review."""
    best = traced.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))
    rows = records.join(best, ["doc_id", "item_id"], "left")
    good = F.coalesce(F.col("similarity") >= threshold, F.lit(False))
    return rows.withColumns({
        "similarity": F.coalesce("similarity", F.lit(0.0)), "traced": good, "confidence": F.when(good, F.col("confidence")).otherwise(F.least("confidence", F.lit(doubtful))),
        "review_status": F.when(good, "PENDING").otherwise("NEEDS_REVIEW"),
    })


def contained_items(docs: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id and item_id of the items (item_id, item) that stand whole in texts (doc_id, text), letter by letter.

    One automaton a task finds all items of a block in one pass over each text. Empty items stand nowhere; equal rows of
    either side give one row.
    """

    def find(rows: list[tuple[int, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            own: dict[str, list[int]] = {}
            for i, text in rows:
                own.setdefault(text, []).append(i)
            found = ahocorasick.Automaton()
            for text, ids in own.items():
                found.add_word(text, ids)
            if own:
                found.make_automaton()
            for batch in batches if own else ():
                docs, hits = [], []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    for i in {i for _, ids in found.iter(text.as_py() or "") for i in ids}:
                        docs.append(doc)
                        hits.append(i)
                if docs:
                    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(hits, pa.int64())], names=["doc_id", "item_id"])

        return run

    texts = docs.select(F.col("doc_id").cast("long"), "text")
    once = items.select(F.col("item_id").cast("long"), F.col("item").cast("string")).filter("item != ''").distinct()
    parts = [texts.mapInArrow(find([(r["item_id"], r["item"]) for r in block.collect()]), "doc_id long, item_id long") for block in _blocks(once, block_chars)]
    return reduce(DataFrame.unionByName, parts).distinct()


def _blocks(once: DataFrame, block_chars: int) -> list[DataFrame]:
    """Items in blocks of about so many characters, by hash."""
    total = once.agg(F.sum(F.length("item"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    return [once.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b) for b in range(blocks)]
