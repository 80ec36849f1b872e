"""Removal of repeated passages by suffix arrays.

A byte goes when a string of ``length`` bytes that covers it also starts in a document with a smaller id. Every such string
holds a minimiser (the k-gram with the least hash of its window), the same wherever the string stands, so two documents that
share a string share a minimiser. The regions round shared minimisers go to the block of the smallest document that has them;
there a suffix array finds the strings that truly repeat. The array comes by two-stage sorting: suffixes smaller than their
successors are sorted directly, the rest are induced by scanning the buckets of first bytes in order; adjacent common prefixes
of ``length`` bytes or more then make groups of equal strings, and all but those in a group's smallest document are removed.

A passage may stand in a third of all documents. Grams that frequent are counted first, and the block that they name is
salted by document; so each part hands on every string once, with its smallest document, and a second round, whose grams
are nearly whole strings, compares what the parts are left with. Such a gram stands in few strings of a part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import lean, shuffle_width

#: Bytes of a repeated string, of a k-gram, of the text that one suffix array is built over, and of a part of a leader.
LENGTH, GRAM, SLICE, PART = 50, 24, 500_000, 1_024
#: Bytes of a k-gram of the second round.
SECOND = 44
#: Occurrences of a frequent gram at least, and the share of all grams (one in so many) that it is at least.
COMMON, FREQUENT = 2_048, 65_536
#: Minimisers of a bucket, about: what a task holds of its partition's; bytes that are hashed at once.
BUCKET, PIECE = 500_000, 500_000


def _words8(data: np.ndarray) -> np.ndarray:
    """At each place the next eight bytes as a number that sorts as they do; zeros follow the end."""
    padded = np.r_[data, np.zeros(7, np.uint8)].astype(np.uint64)
    two = (padded[:-1] << np.uint64(8)) | padded[1:]
    four = (two[:-2] << np.uint64(16)) | two[2:]
    return (four[:-4] << np.uint64(32)) | four[4:]


def _slide(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least or largest of every ``width`` neighbours."""
    pick, have = np.minimum if least else np.maximum, 1
    while have * 2 <= width:
        x, have = pick(x[:-have], x[have:]), have * 2
    return pick(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def minimisers(data: np.ndarray, length: int = LENGTH, k: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the k-grams that are least in some window of ``length`` bytes."""
    n, w = len(data), length - k + 1
    if n < length:
        return np.zeros(0, np.int32), np.zeros(0, np.uint64)
    if n > 2 * PIECE:  # windows that begin in a piece lie in it and the length - 1 bytes after it
        parts = [(a, *minimisers(data[a : a + PIECE + length - 1], length, k)) for a in range(0, n - length + 1, PIECE)]
        at, first = np.unique(np.concatenate([p + a for a, p, _ in parts]), return_index=True)
        return at.astype(np.int32), np.concatenate([h for *_, h in parts])[first]
    eight = _words8(data)
    h = np.zeros(n - k + 1, np.uint64)
    for at in [*range(0, k - 7, 8), *([k - 8] if k % 8 else [])]:
        h = (h ^ eight[at : at + n - k + 1]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    least = _slide(h, w, True)
    edge = np.zeros(w - 1, np.uint64)
    most = _slide(np.r_[edge, least, edge], w, False)
    at = np.flatnonzero(most == h)
    return at.astype(np.int32), h[at]


def suffix_order(data: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """The places of ``data`` ordered by the ``depth`` bytes (at least) that follow, by two-stage sorting."""
    n = len(data)
    if n < 2:
        return np.arange(n)
    # A suffix is smaller than its successor if the first byte that differs from its own is larger.
    differs = np.flatnonzero(data[:-1] != data[1:])
    after = np.searchsorted(differs, np.arange(n))
    rising = np.zeros(n, bool)
    inner = after < len(differs)
    where = differs[after[inner]]
    rising[np.flatnonzero(inner)] = data[where] < data[where + 1]
    small = np.flatnonzero(rising)
    # Stage one: the smaller suffixes, eight bytes and then four more at a time, each within the ties so far.
    eight = _words8(data)
    first, ranked = eight[small], np.zeros(len(small), np.int64)
    order = np.argsort(first, kind="stable")
    small, first = small[order], first[order]
    if len(small):
        ranked = np.cumsum(np.r_[0, (first[1:] != first[:-1]).astype(np.int64)])
    for at in range(8, depth, 4):
        tied = np.zeros(len(small), bool)
        if len(small) > 1:
            same = ranked[1:] == ranked[:-1]
            tied[1:] |= same
            tied[:-1] |= same
        live = np.flatnonzero(tied)
        if not len(live):
            break
        place = small[live] + at
        more = np.where(place < n, eight[np.minimum(place, n - 1)] >> np.uint64(32), np.uint64(0))
        key = (ranked[live].astype(np.uint64) << np.uint64(32)) | more
        order = np.argsort(key)
        small[live], key = small[live][order], key[order]
        step = np.r_[True, ranked[1:] != ranked[:-1]]
        step[live[1:]] |= key[1:] != key[:-1]
        ranked = np.cumsum(step) - 1
    # Stage two: scan the buckets of first bytes in order; what precedes a scanned suffix and isn't smaller is induced.
    ends = np.searchsorted(data[small], np.arange(257))
    queues: list[list[np.ndarray]] = [[] for _ in range(256)]
    last = np.array([n - 1])  # the last suffix is larger than its (empty) successor, which sorts before all
    queues[int(data[-1])].append(last)
    out = []
    for c in range(256):
        larger = queues[c]
        front = np.concatenate(larger) if larger else np.zeros(0, np.int64)
        parts = []
        while len(front):
            parts.append(front)
            before = front[front > 0] - 1
            front = before[(data[before] == c) & ~rising[before]]
        parts.append(small[ends[c] : ends[c + 1]])
        bucket = np.concatenate(parts)
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[~rising[before] & (data[before] > c)]
        if len(before):
            chars = data[before]
            order = np.argsort(chars, kind="stable")
            before, chars = before[order], chars[order]
            cuts = np.flatnonzero(np.r_[True, chars[1:] != chars[:-1]])
            for a, b in zip(cuts, [*cuts[1:], len(chars)], strict=True):
                queues[int(chars[a])].append(before[a:b])
    return np.concatenate(out)


def _equal_neighbours(data: np.ndarray, ordered: np.ndarray, length: int) -> np.ndarray:
    """Whether each of the ordered places but the first has ``length`` bytes in common with the one before it."""
    eight = _words8(data)
    alive = np.arange(1, len(ordered))
    for at in [*range(0, length - 7, 8), length - 8] if length >= 8 else []:
        alive = alive[eight[ordered[alive] + at] == eight[ordered[alive - 1] + at]]
    out = np.zeros(max(0, len(ordered) - 1), bool)
    out[alive - 1] = True
    return out


def repeated(regions: list[tuple[int, int, bytes]], length: int = LENGTH, flags: list[bool] | None = None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, bytes]]]:
    """Spans (region, start, end) that smaller documents among the regions (doc, start, bytes) hold as well; and what is left.

    What is left are, of the flagged regions, the strings that no smaller document has, as (region, start, bytes).
    """
    sizes = np.array([len(r[2]) for r in regions])
    data = np.frombuffer(b"".join(r[2] for r in regions), np.uint8)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(regions), dtype=np.int32), sizes)
    docs = np.array([r[0] for r in regions], np.int64)
    ordered = suffix_order(data, length)
    ordered = ordered[ordered + length <= ends[owner[ordered]]]
    if not len(ordered):
        return [], []
    head = np.flatnonzero(np.r_[True, ~_equal_neighbours(data, ordered, length)])
    doc = docs[owner[ordered]]
    least = np.repeat(np.minimum.reduceat(doc, head), np.diff(np.r_[head, len(ordered)]))
    begins = ends - sizes

    def cover(starts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Region, bounds in it and place of the maximal runs that the strings at the starts cover; a region's run ends with it."""
        if not len(starts):
            return
        starts = np.sort(starts)
        fresh = np.flatnonzero(np.r_[True, (starts[1:] > starts[:-1] + length) | (owner[starts[1:]] != owner[starts[:-1]])])
        for a, b in zip(starts[fresh].tolist(), starts[np.r_[fresh[1:], len(starts)] - 1].tolist(), strict=True):
            r = int(owner[a])
            shift = regions[r][1] - int(begins[r])
            yield r, a + shift, b + length + shift, a

    spans = [(r, a, b) for r, a, b, _ in cover(ordered[doc > least])]
    left = ordered[(doc == least) & np.array(flags, bool)[owner[ordered]]] if flags and any(flags) else ordered[:0]
    return spans, [(r, a, data[at : at + b - a].tobytes()) for r, a, b, at in cover(left)]


def _packed(keys: np.ndarray, columns: list[np.ndarray], names: list[str], key_name: str) -> Iterator[pa.RecordBatch]:
    """One row per key with each column's values for it as bytes; keys are sorted."""
    if not len(keys):
        return
    cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    bounds = list(zip(cuts, [*cuts[1:], len(keys)], strict=True))
    arrays = [pa.array([c[a:b].tobytes() for a, b in bounds], pa.binary()) for c in columns]
    yield pa.RecordBatch.from_arrays([pa.array(keys[cuts].astype(np.int32)), *arrays], names=[key_name, *names])


def _blocked(leader: np.ndarray, part: np.ndarray, salted: bool) -> np.ndarray:
    """Numbers of blocks by leader and part; salted blocks have odd ones. Blocks with equal numbers merely share arrays."""
    x = leader.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return ((x & ~np.uint64(1)) | np.uint64(salted)).view(np.int64)


def _hashed(texts: Iterator[tuple[int, int, pa.Scalar]], length: int, k: int, most: int = 250_000) -> Iterator[tuple[np.ndarray, ...]]:
    """Of texts (doc, key, text): doc, key, place and hash of the minimisers, about ``most`` at a time."""
    held: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    size = 0

    def joined() -> tuple[np.ndarray, ...]:
        counts = [len(x[2]) for x in held]
        ids = (np.repeat(np.array([x[i] for x in held], np.int64), counts) for i in (0, 1))
        return (*ids, np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held]))

    for doc, key, text in texts:
        buffer = text.as_buffer()
        if buffer is None or buffer.size < length:
            continue
        held.append((doc, key, *minimisers(np.frombuffer(buffer, np.uint8), length, k)))
        size += len(held[-1][2])
        if size > most:
            yield joined()
            held, size = [], 0
    if size:
        yield joined()


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Scalar]]:
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True)


def _once(batches: Iterator[pa.RecordBatch], most: int = 200_000) -> Iterator[tuple[int, int, pa.Scalar]]:
    """A text that a task has seen already counts once (as far as ``most`` keys are remembered)."""
    seen: set[int] = set()
    for doc, key, text in _each(batches):
        if key not in seen:
            if len(seen) < most:
                seen.add(key)
            yield doc, key, text


@dataclass
class Frequent:
    """Grams that a large share of all texts has, sorted; the label of each; of a label the leader, the part and the salts."""

    grams: np.ndarray
    label: np.ndarray
    leader: np.ndarray
    part: np.ndarray
    salts: np.ndarray

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """The label of each hash, -1 for grams that aren't frequent."""
        if not len(self.grams):
            return np.full(len(hashes), -1, np.int32)
        at = np.minimum(np.searchsorted(self.grams, hashes), len(self.grams) - 1)
        return np.where(self.grams[at] == hashes, self.label[at], -1).astype(np.int32)

    def block(self, label: np.ndarray, doc: np.ndarray) -> np.ndarray:
        salt = ((doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % self.salts[label].astype(np.uint64)
        return _blocked(self.leader[label], (self.part[label].astype(np.uint64) << np.uint64(20)) + salt, True)


NOTHING = Frequent(np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4)))


def _count_grams(length: int, k: int, floor: int):
    """Over (doc_id, key, text): the grams that stand out in a task's texts, with their smallest document and a place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, gram, n, doc, place = 0, np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
        for d, _, p, h in _hashed(_once(batches), length, k):
            total += len(h)
            gram, n = np.r_[gram, h], np.r_[n, np.ones(len(h), np.int64)]
            doc, place = np.r_[doc, d], np.r_[place, p]
            order = np.lexsort((place, doc, gram))
            gram, n, doc, place = gram[order], n[order], doc[order], place[order]
            head = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
            n = np.add.reduceat(n, head)
            gram, doc, place = gram[head], doc[head], place[head]
            keep = n >= max(2, total // (4 * FREQUENT))  # rarer ones start anew: their counts may come out low
            if len(gram) > 4 * FREQUENT:
                gram, n, doc, place = gram[keep], n[keep], doc[keep], place[keep]
        keep = n >= max(floor, total // (4 * FREQUENT))
        columns = [np.r_[gram[keep].view(np.int64), 0], np.r_[n[keep], 0], np.r_[doc[keep], 0], np.r_[place[keep], 0], np.r_[np.zeros(keep.sum(), np.int64), total]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["gram", "n", "doc", "place", "total"])

    return run


def frequent_grams(texts: DataFrame, length: int, k: int) -> tuple[Frequent, int]:
    """Of (doc_id, key, text) the grams with COMMON occurrences and a FREQUENT-th of all at least, so FREQUENT at most; and the count of all.

    They only say how the work is dealt; whatever they are, the same bytes are found.
    """
    counted = texts.mapInArrow(lean(_count_grams(length, k, max(2, COMMON // 512))), "gram long, n long, doc long, place long, total long")
    total = F.coalesce(F.sum("total"), F.lit(0)).alias("total")
    grams = counted.groupBy("gram").agg(F.sum("n").alias("n"), F.min(F.struct("doc", "place")).alias("first"), total)
    # At most FREQUENT rows pass: their counts make up all grams at most.
    whole = counted.agg(total).first()[0]
    least = max(COMMON, whole // FREQUENT)
    rows = [(r["gram"], r["n"], *r["first"]) for r in grams.filter(F.col("n") >= least).collect()]
    if not rows:
        return NOTHING, whole
    gram, n, doc, place = (np.array(c, np.int64) for c in zip(*rows, strict=True))
    gram = gram.view(np.uint64)
    order = np.argsort(gram)
    gram, n, doc, part = gram[order], n[order], doc[order], place[order] // PART
    label_of, label = np.unique(np.stack([doc, part], axis=1), axis=0, return_inverse=True)
    label = label.ravel().astype(np.int32)
    most, grams_of = np.zeros(len(label_of), np.int64), np.zeros(len(label_of), np.int64)
    np.maximum.at(most, label, n)
    np.add.at(grams_of, label, n)
    salts = (most * (2 * length - k) + grams_of * (length - k + 2) // 2) // (SLICE // 2) + 1
    return Frequent(gram, label, label_of[:, 0].copy(), label_of[:, 1].copy(), salts), whole


def _halves(x: np.ndarray, to: type) -> list[np.ndarray]:
    """Low and high halves, which compress better apart."""
    bits = np.uint64(8 * np.dtype(to).itemsize)
    x = x.astype(np.uint64)
    return [x.astype(to), (x >> bits).astype(to)]


PACKED = ("doc", np.uint32), ("doc_high", np.uint32), ("place", np.uint16), ("place_high", np.uint16), ("gram", np.uint32)
KEYED = *PACKED, ("key", np.uint32), ("key_high", np.uint32)


def _find_minimisers(buckets: int, length: int, k: int, frequent: Frequent, keyed: bool):
    """Over (doc_id, key, text, gone): the minimisers, dealt to buckets by hash, as packed columns; frequent ones to negative buckets.

    Texts whose key is among ``gone`` are copies. Of a hash 32 bits are kept beside the bucket: grams that fall together only
    make regions more. Keys are kept if ``keyed``.
    """
    names = [n for n, _ in (KEYED if keyed else PACKED)]

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Scalar]]:
        for batch in batches:
            for *own, gone in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                if not gone or own[1] not in gone:
                    yield tuple(own)

    def columns(doc: np.ndarray, place: np.ndarray, gram: np.ndarray, key: np.ndarray) -> list[np.ndarray]:
        out = [*_halves(doc, np.uint32), *_halves(place, np.uint16), gram.astype(np.uint32)]
        return [*out, *_halves(key, np.uint32)] if keyed else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for turn, (doc, key, place, h) in enumerate(_hashed(texts(batches), length, k)):
            label = frequent.of(h)
            hot, at = np.flatnonzero(label >= 0), np.flatnonzero(label < 0)
            bucket = (h[at] % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            at = at[order]
            yield from _packed(bucket[order], columns(doc[at], place[at], h[at] >> np.uint64(32), key[at]), names, "bucket")
            if len(hot):
                share = -1 - ((np.arange(len(hot)) // 50_000 + int(h[0] % np.uint64(9973)) + turn) % buckets).astype(np.int32)
                yield from _packed(share, columns(doc[hot], place[hot], label[hot], key[hot]), names, "bucket")

    return run


def _share(frequent: Frequent, keyed: bool):
    """Over packed minimisers sorted by bucket: those that several documents have, each with the number of its block.

    A block is named by the smallest document that has the gram and by the part of it where the gram stands.
    """
    types = [t for _, t in (KEYED if keyed else PACKED)]

    def joined(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return low.astype(np.int64) | (high.astype(np.int64) << (8 * low.dtype.itemsize))

    def shared(bucket: int, rows: list[tuple[bytes, ...]]) -> Iterator[pa.RecordBatch]:
        cols = [np.concatenate([np.frombuffer(r[i], t) for r in rows]) for i, t in enumerate(types)]
        doc, place, h = joined(cols[0], cols[1]), joined(cols[2], cols[3]), cols[4]
        key = joined(cols[5], cols[6]) if keyed else doc
        if bucket < 0:
            yield batch_of(doc, key, place, frequent.block(h.astype(np.int64), doc))
            return
        order = np.argsort(h, kind="stable")
        run = np.cumsum(np.r_[0, (h[order][1:] != h[order][:-1]).astype(np.int64)])
        order = order[(np.bincount(run) > 1)[run]]
        if not len(order):
            return
        order = order[np.lexsort((place[order], doc[order], h[order]))]
        h, doc, key, place = h[order], doc[order], key[order], place[order]
        gram = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        width = np.diff(np.r_[gram, len(h)])
        several = doc[gram] != doc[gram + width - 1]
        block = np.repeat(_blocked(doc[gram], place[gram] // PART, False), width)
        keep = np.repeat(several, width)
        if keep.any():
            yield batch_of(doc[keep], key[keep], place[keep], block[keep])

    def batch_of(doc: np.ndarray, key: np.ndarray, place: np.ndarray, block: np.ndarray) -> pa.RecordBatch:
        arrays = [pa.array(doc), pa.array(key), pa.array(place.astype(np.int32)), pa.array(block)]
        names = ["doc_id", "key", "place", "block"]
        return pa.RecordBatch.from_arrays(arrays, names=names) if keyed else pa.RecordBatch.from_arrays([arrays[0], *arrays[2:]], names=[names[0], *names[2:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, rows = None, []
        for batch in batches:
            for own, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and (own != bucket or own < 0):
                    yield from shared(bucket, rows)
                    rows = []
                bucket = own
                rows.append(tuple(rest))
        if rows:
            yield from shared(bucket, rows)

    return run


def _cut_regions(length: int, k: int):
    """Over (doc_id, h, base, row, at) with the places and blocks of a text's shared minimisers: the regions round them."""
    names, types = ["block", "doc_id", "h", "start", "bytes"], (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(4).is_valid())
            if not batch.num_rows:
                continue
            at = batch.column(4)
            flat = at.flatten()
            place, block = flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64), flat.field(1).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(at.offsets.to_numpy()))
            order = np.lexsort((place, block, owner))
            place, block, owner = place[order], block[order], owner[order]
            lo, hi = np.maximum(0, place + k - length), place + length
            fresh = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (block[1:] != block[:-1]) | (lo[1:] > hi[:-1])])
            stop = np.r_[fresh[1:], len(place)] - 1
            docs, hs, bases = (batch.column(i).to_pylist() for i in range(3))
            texts, last, raw, size = batch.column(3).field("text"), -1, b"", 0
            out: list[list] = [[], [], [], [], []]
            for o, who, a, b in zip(owner[fresh].tolist(), block[fresh].tolist(), lo[fresh].tolist(), hi[stop].tolist(), strict=True):
                if o != last:
                    last, raw = o, bytes(texts[o].as_buffer())
                for into, v in zip(out, (who, docs[o], hs[o], bases[o] + a, raw[a:b]), strict=True):
                    into.append(v)
                size += b - a
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)
                    out, size = [[], [], [], [], []], 0
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    return run


def _find_spans(length: int, most: int, last: bool):
    """Over regions sorted by block: the repeated spans (bytes: null), and what is left of split blocks (with its bytes).

    Small blocks share a suffix array. A block that was salted, or that is too large for one array, is split: each part's
    strings go on once, to the next round; in the last one, where a string stands once a part, to the block's next array.
    """
    names, types = ["doc_id", "h", "start", "end", "bytes"], (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes, bool]] = []
        size, block, begun, split = 0, None, 0, False  # begun: where the last block's regions start in held

        def result(regions: list) -> Iterator[pa.RecordBatch]:
            spans, rest = repeated([(r[0], r[2], r[3]) for r in regions], length, [r[4] for r in regions])
            rows = [(regions[r][0], regions[r][1], a, b, None) for r, a, b in spans]
            rows += [(regions[r][0], regions[r][1], a, a + len(raw), raw) for r, a, raw in rest]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        def carried(regions: list) -> tuple[pa.RecordBatch, list]:
            spans, rest = repeated([(r[0], r[2], r[3]) for r in regions], length, [True] * len(regions))
            rows = [(regions[r][0], regions[r][1], a, b, None) for r, a, b in spans]
            made = pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], names=names)
            return made, [(regions[r][0], regions[r][1], a, raw, False) for r, a, raw in rest]

        for batch in batches:
            for own, doc, h, start, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != block:
                    if size > most:
                        yield from result(held)
                        held, size = [], 0
                    block, begun, split = own, len(held), bool(own & 1) and not last
                elif size > 2 * most:
                    if last:
                        if begun:
                            yield from result(held[:begun])
                        made, held = carried(held[begun:])
                        yield made
                        begun, size = 0, 0  # what is carried is bounded: a block's strings, each once
                    else:
                        split = True
                        yield from result([(*r[:4], r[4] or i >= begun) for i, r in enumerate(held)])
                        held, begun, size = [], 0, 0
                held.append((doc, h, start, raw, split))
                size += len(raw)
        if held:
            yield from result(held)

    return run


def _runs(spans: list[dict] | None, key: int) -> list[list[int]]:
    """The maximal runs (start, end) that a text's own spans cover."""
    out: list[list[int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans or [] if s["h"] == key):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def _kept(raw: bytes, runs: list[list[int]]) -> bytes:
    return b"".join(raw[a:b] for a, b in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(raw)], strict=True))


def _pick(left: bool):
    """Of the rows of _find_spans those of what is left, or the spans. (As a filter it would split the exchange below.)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(batch.column(4).is_valid() if left else batch.column(4).is_null())

    return run


FOUND = "doc_id long, h long, start long, end long, bytes binary"


def _round(texts: DataFrame, gone: DataFrame | None, total: int, frequent: Frequent, length: int, k: int, refer: list[Column]) -> DataFrame:
    """The rows of _find_spans for texts: doc_id, key, row (has the text), and what ``refer`` needs.

    ``refer`` are the columns h and base: whose spans a text's are, and where it begins there. ``gone`` has the keys of copies
    by document. In the second round (without it) a document has several texts, and shared grams know theirs by the key.
    """
    width, last = shuffle_width(texts.sparkSession), gone is None
    keys = ["doc_id", "key"] if last else ["doc_id"]
    marked = texts.withColumn("gone", F.lit(None).cast("array<long>")) if last else texts.join(gone, "doc_id", "left")
    names = KEYED if last else PACKED
    buckets = width * (1 + total // (width * BUCKET))
    mins = marked.select("doc_id", "key", F.col("row.text").alias("text"), "gone") if last else marked.select("doc_id", "key", "row", "gone")
    find = _find_minimisers(buckets, length, k, frequent, last)
    mins = mins.mapInArrow(lean(find if last else _of_rows(find)), "bucket int, " + ", ".join(f"{n} binary" for n, _ in names))
    shared = mins.repartition(width, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(_share(frequent, last)), ", ".join(f"{c} long" for c in keys) + ", place int, block long")
    shared = shared.groupBy(*keys).agg(F.collect_list(F.struct("place", "block")).alias("at"))
    met = texts.join(shared, keys, "left").select("doc_id", *refer, "row", "at")
    regions = met.mapInArrow(lean(_cut_regions(length, k)), "block long, doc_id long, h long, start long, bytes binary")
    regions = regions.repartition(width, "block").sortWithinPartitions("block")
    return regions.mapInArrow(lean(_find_spans(length, SLICE, last)), FOUND)


def _of_rows(find):
    """``find`` over batches whose third column is a row that has the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = (pa.RecordBatch.from_arrays([*b.columns[:2], b.column(2).field("text"), b.column(3)], names=["doc_id", "key", "text", "gone"]) for b in batches)
        yield from find(texts)

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, key, row (all columns) and spans (h, start, end; those with h = key are the text's own; null: none) of every row.

    ``key`` is the text's hash, so rows that share an id keep their own spans. Texts are dealt once by doc_id; the joins all
    use that exchange, whole rows as they are, so that no filter or column makes it another. Copies (equal texts with a
    larger id) are one span, and take no part in the search.
    """
    width = shuffle_width(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    # A cast that changes nothing would stay in one use of the exchange and go from another, which makes them two.
    doc = F.col("doc_id") if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long").alias("doc_id")
    key = F.xxhash64(text).alias("key")
    unnamed = docs.filter("doc_id is null").select(doc, key, F.struct(*docs.columns).alias("row"), F.lit(None).cast("array<struct<h:bigint,start:bigint,end:bigint>>").alias("spans"))
    docs = docs.filter("doc_id is not null")
    slim = docs.select(doc, F.xxhash64(text).alias("h"), F.crc32(text.cast("binary")).alias("c"), F.octet_length(text).cast("long").alias("end")).filter(f"end >= {length}")
    first = slim.groupBy("h", "c", "end").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    copies = slim.join(first, ["h", "c", "end"]).filter("doc_id > first").select("doc_id", "h", F.lit(0).cast("long").alias("start"), "end")
    gone = copies.groupBy("doc_id").agg(F.collect_set("h").alias("gone"))
    frequent, total = frequent_grams(docs.select(doc, key, text.alias("text")), length, GRAM)
    texts = docs.select(doc, key, F.struct(*docs.columns).alias("row")).repartition(width, "doc_id")
    found = _round(texts, gone, total, frequent, length, GRAM, [F.col("key").alias("h"), F.lit(0).cast("long").alias("base")])
    found = found.repartition(width, "doc_id")
    rest = found.mapInArrow(lean(_pick(True)), FOUND).select("doc_id", F.xxhash64("doc_id", "h", "start", "end").alias("key"), F.struct(F.col("bytes").alias("text")).alias("row"), "h", "start")
    more = _round(rest, None, total // 4, NOTHING, length, SECOND, [F.col("h"), F.col("start").alias("base")])
    spans = found.mapInArrow(lean(_pick(False)), FOUND).unionByName(more)
    whole = spans.select("doc_id", "h", "start", "end").unionByName(copies).groupBy("doc_id").agg(F.collect_list(F.struct("h", "start", "end")).alias("spans"))
    return texts.join(whole, "doc_id", "left").select("doc_id", "key", "row", "spans").unionByName(unnamed)


def removal_digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The columns of op8, one row for each row of ``docs``.

    Null texts are empty. Documents with equal texts: all but the smallest lose everything, if there are ``length`` bytes.
    Rows with a null id neither lose bytes nor take them from others; rows that share an id don't take from each other,
    whether their texts are equal or not.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, key, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).field("text"), batch.column(3).to_pylist(), strict=True):
                raw = bytes(text.as_buffer() or b"")
                runs = _runs(spans, key)
                kept = _kept(raw, runs) if runs else raw
                rows.append((doc, len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
            if rows:
                types = (*[pa.int64()] * 4, pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = repeated_spans(docs.select("doc_id", "text"), length)
    return found.mapInArrow(lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with their texts as left (bytes of a cut character go with it) and n_chars anew; emptied ones go.

    Null and short texts, and rows with a null id, stay as they are. Other columns stay.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(2)
            texts, keep, chars = row.field("text").to_pylist(), [], row.field("n_chars").to_pylist()
            for i, (key, spans) in enumerate(zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                runs = _runs(spans, key)
                if runs:
                    texts[i] = _kept(texts[i].encode(), runs).decode("utf-8", "ignore")
                    chars[i] = len(texts[i])
                keep.append(not runs or texts[i] != "")
            columns = [pa.array(texts, row.field(c).type) if c == "text" else pa.array(chars, row.field(c).type) if c == "n_chars" else row.field(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    return repeated_spans(docs, length).mapInArrow(lean(run), docs.schema)
