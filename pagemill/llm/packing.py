"""Best-fit packing by exact-complement hashing.

Texts become token pieces of at most ``capacity`` ids. The plan works on the histogram of piece lengths alone
(``capacity`` entries, whatever the corpus): from the longest length down, the gap that a piece leaves is looked up
among single lengths, pair sums and triple sums that are still available, and every exact filling found is consumed as
often as its counts allow; what is left is packed best-fit, longest first. The plan is a list of patterns with
repeat counts. Pieces then take their places by their rank within their length, with no group gathered anywhere.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import lean, shuffle_width, staged, with_rank

CAPACITY, END_ID = 1024, 2


@lru_cache(maxsize=2)
def _encoders(path: str):
    """The tokenizer of the file, and an encoder over the same ranks that gives the same ids sooner."""
    import json

    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    spec = json.loads(exact.to_str())
    letters = {c: b for b, c in _byte_letters().items()}
    special = tuple(x["content"] for x in spec["added_tokens"])
    ranks = {bytes(letters[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}
    try:
        from public_tokenizers import PATTERN
    except ImportError:
        return exact, special, None
    return exact, special, tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def encode(text: str, path: str) -> list[int]:
    exact, special, quick = _encoders(path)
    if quick is None or any(s in text for s in special):
        return exact.encode(text, add_special_tokens=False).ids
    return quick.encode_ordinary(text)


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (little-endian unsigned 32-bit ids).

    A document is its ids and then ``end_id``; only documents over ``capacity`` are cut, and then only the first
    piece may be shorter. A null or empty text is the piece [end_id]. Repeated rows give repeated pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or "", tokenizer), end_id], dtype="<u4")
                first = (len(ids) - 1) % capacity + 1
                for piece, end in enumerate(range(first, len(ids) + 1, capacity)):
                    start = 0 if piece == 0 else end - capacity
                    for into, v in zip(rows, (doc, piece, start, end - start, ids[start:end].tobytes()), strict=True):
                        into.append(v)
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, schema, strict=True)], schema=schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(lean(run), "doc_id long, piece int, start long, length long, ids binary")


class _Counts:
    """Available pieces by length, with the lengths that are left in order."""

    def __init__(self, histogram: dict[int, int]):
        self.n = {k: v for k, v in histogram.items() if v > 0}
        self.order = sorted(self.n)

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for x in lengths:
            self.n[x] -= times
            if not self.n[x]:
                del self.n[x]
                self.order.pop(bisect.bisect_left(self.order, x))

    def times(self, lengths: tuple[int, ...]) -> int:
        return min(self.n.get(x, 0) // lengths.count(x) for x in set(lengths))


def _fillings(counts: _Counts, longest: int, gap: int) -> Iterator[tuple[int, ...]]:
    """Combinations of one, two or three available lengths that fill the gap exactly, longest members first."""
    if gap in counts.n:
        yield (gap,)
    for a in reversed(counts.order[: bisect.bisect_right(counts.order, min(longest, gap - 1))]):
        if a * 2 < gap:
            break
        if gap - a in counts.n:
            yield (a, gap - a)
    for a in reversed(counts.order[: bisect.bisect_right(counts.order, min(longest, gap - 2))]):
        if a * 3 < gap:
            break
        for b in reversed(counts.order[: bisect.bisect_right(counts.order, min(a, gap - a - 1))]):
            if b * 2 < gap - a:
                break
            if gap - a - b in counts.n:
                yield (a, b, gap - a - b)


def plan_patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of one sequence, at most capacity) and how many sequences use each."""
    counts = _Counts(histogram)
    plan: list[tuple[tuple[int, ...], int]] = []
    if capacity in counts.n:
        plan.append(((capacity,), counts.n[capacity]))
        counts.take((capacity,), counts.n[capacity])
    for head in sorted(counts.n, reverse=True):
        while counts.n.get(head):
            for rest in _fillings(counts, head, capacity - head):
                if times := counts.times((head, *rest)):
                    plan.append(((head, *rest), times))
                    counts.take((head, *rest), times)
                    break
            else:
                break
    open_by_gap: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    gaps: list[int] = []

    def put(lengths: tuple[int, ...], times: int) -> None:
        gap = capacity - sum(lengths)
        if gap not in open_by_gap:
            bisect.insort(gaps, gap)
        open_by_gap.setdefault(gap, []).append((lengths, times))

    for x in sorted(counts.n, reverse=True):
        left = counts.n[x]
        while left:
            at = bisect.bisect_left(gaps, x)
            if at == len(gaps):
                many, rest = divmod(left, capacity // x)
                if many:
                    put((x,) * (capacity // x), many)
                if rest:
                    put((x,) * rest, 1)
                break
            gap = gaps[at]
            lengths, times = open_by_gap[gap].pop()
            if not open_by_gap[gap]:
                del open_by_gap[gap], gaps[at]
            each = min(gap // x, left)
            used = min(times, left // each)
            if used < times:
                put(lengths, times - used)
            put(lengths + (x,) * each, used)
            left -= used * each
    return plan + [p for found in open_by_gap.values() for p in found]


def pack(pieces: DataFrame, capacity: int = CAPACITY, keys: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Add sequence_id and offset to rows that have a ``length`` from 1 to capacity.

    Only the histogram of lengths, at most ``capacity`` rows, reaches the driver. An empty input gives no rows.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows, base, used = [], 0, dict.fromkeys(histogram, 0)
    for lengths, times in plan_patterns(histogram, capacity):
        offset = 0
        places: dict[int, list[int]] = {}
        for x in lengths:
            places.setdefault(x, []).append(offset)
            offset += x
        for x, at in places.items():
            rows.append((x, used[x], used[x] + times * len(at), base, at))
            used[x] += times * len(at)
        base += times
    # Every length has its intervals of ranks in one sorted array, so a piece finds its own by a lookup, not by a range join.
    spans = spark.createDataFrame(rows, "length long, lo long, hi long, base long, at array<long>")
    lookup = spans.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "base", "at"))).alias("spans"))
    ranked = with_rank(pieces, ["length"], list(keys), max(16, shuffle_width(spark)), rank="_rank")
    found = ranked.join(F.broadcast(lookup), "length").withColumn("_s", F.expr("filter(spans, s -> s.lo <= _rank and _rank < s.hi)[0]"))
    nth = F.col("_rank") - F.col("_s.lo")
    width = F.size("_s.at")
    return found.select(
        *pieces.columns,
        (F.col("_s.base") + F.floor(nth / width)).cast("long").alias("sequence_id"),
        F.get(F.col("_s.at"), (nth % width).cast("int")).alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The digest columns of op5: where each piece goes, and the checksum of its ids."""
    pieces = token_pieces(docs, tokenizer).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(staged(pieces, "pieces"))
