"""Exact n-gram Jaccard join by signature trees.

A document's set are the hashes of its distinct word shingles. Equal sets are one class, worked on once, by its smallest
document. Sets that share enough of their elements share one of the rarest elements of each (a prefix of the set in an
order common to all; rare elements come first by a fixed-size table of counts over the whole corpus). All documents with a
prefix element in common go to the block of the smallest of them. In a block the sets hang in a signature tree: a node has
the OR of its sets' token bitmaps, their range of sizes and the most tokens that share a bit; two nodes are walked together
only while the sets under them could overlap enough. Surviving pairs are compared exactly, links make components.

Texts are the bulk of what travels, so a block first gets sketches of its sets: bit b is the parity of the elements that fall
on b. Sketches differ in at most as many bits as the sets differ in elements, so a set whose sketch is too far from all others
of its block links with none there, and its text isn't sent.

A block too large for one task is dealt to tiles. First the sets of a tile meet each other and a few pivots that all tiles
get, which makes near copies one component. Then only the sets outside the block's largest component go to every tile: what
is connected needn't meet again, so a cluster that holds a third of all documents costs its size, not its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import lean, shuffle_width, staged
from pagemill.llm.components import components

#: Words of a shingle; the least Jaccard similarity as a fraction; bits of the table of counts; shingles of a tile; sets that all tiles of a block get.
WORDS, NUM, DEN, TABLE_BITS, TILE, PIVOTS = 4, 85, 100, 17, 2_000_000, 32
#: Bytes that are hashed at once; bits of a signature; children of a tree node.
SLICE, SIGNATURE, FANOUT = 1_000_000, 1024, 8

_RNG = np.random.Generator(np.random.PCG64(20240229))
_LETTERS = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words `[^\\x20\\x09-\\x0D]+` of some bytes, A-Z taken as a-z."""
    solid = np.flatnonzero((data != 32) & ((data < 9) | (data > 13)))
    if not len(solid):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    fresh = np.r_[True, np.diff(solid) > 1]
    first = np.flatnonzero(fresh)
    place = np.arange(len(solid)) - np.repeat(first, np.diff(np.r_[first, len(solid)]))
    power = np.cumprod(np.r_[np.uint64(1), np.full(int(place.max()), _BASE, np.uint64)])
    letters = data[solid]
    letters = np.where((letters >= 65) & (letters <= 90), letters + 32, letters)
    return _mix(np.add.reduceat(_LETTERS[letters] * power[place], first)), solid[first]


def _shingle(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of one run of words; of fewer words, the whole run as one."""
    if not len(words):
        return words
    n = min(k, len(words))
    out = words[: len(words) - n + 1].copy()
    for i in range(1, n):
        out = out * _STEP + words[i : len(words) - n + 1 + i]
    return _mix(out + np.uint64(n))


def shingle_sets(texts: pa.Array, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted within it, and the bounds of each text's part (n + 1 numbers)."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    hashes, owners, i = [], [], 0
    while i < len(texts):
        j = i + 1
        while j < len(texts) and offsets[j + 1] - offsets[i] <= SLICE:
            j += 1
        if j == i + 1:
            part = [(h := _shingle(_words_of_one(data[offsets[i] : offsets[j]]), k))]
            owner = np.zeros(len(h), np.int64)
        else:  # several texts at once, a space between any two
            cut = offsets[i : j + 1] - offsets[i]
            lengths = np.diff(cut)
            joined = np.full(int(cut[-1]) + len(lengths), 32, np.uint8)
            joined[np.arange(cut[-1]) + np.repeat(np.arange(len(lengths)), lengths)] = data[offsets[i] : offsets[j]]
            words, starts = _word_hashes(joined)
            of = np.searchsorted(cut[1:] + np.arange(1, len(lengths) + 1), starts, side="right")
            bounds = np.searchsorted(of, np.arange(len(lengths) + 1))
            count = np.diff(bounds)
            whole = np.zeros(0, np.uint64)
            if len(words) >= k:
                whole = words[: len(words) - k + 1].copy()
                for s in range(1, k):
                    whole = whole * _STEP + words[s : len(words) - k + 1 + s]
                same = of[: len(whole)] == of[k - 1 :]
                whole, owner = _mix(whole[same] + np.uint64(k)), of[: len(same)][same]
            else:
                owner = np.zeros(0, np.int64)
            few = np.flatnonzero((count > 0) & (count < k))
            short = [_shingle(words[bounds[d] : bounds[d + 1]], k) for d in few]
            part, owner = [whole, *short], np.concatenate([owner, few])
        hashes.append(np.concatenate(part))
        owners.append(owner + i)
        i = j
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    o = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    keep = np.r_[True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])] if len(h) else np.zeros(0, bool)
    h, o = h[keep], o[keep]
    return h, np.searchsorted(o, np.arange(len(texts) + 1))


def _words_of_one(data: np.ndarray) -> np.ndarray:
    """The word hashes of one long text, SLICE bytes at a time, cut at white space."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + SLICE)
        while end < len(data):  # up to the next white space
            space = np.flatnonzero((data[end : end + SLICE] == 32) | ((data[end : end + SLICE] >= 9) & (data[end : end + SLICE] <= 13)))
            end = min(len(data), end + (int(space[0]) if len(space) else SLICE))
            if len(space):
                break
        out.append(_word_hashes(data[at:end])[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _sliced(batch: pa.RecordBatch, column: int, most: int = 3_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about so many bytes of text, so that memory doesn't follow the batch's rows."""
    if not batch.num_rows:
        return
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    part = np.cumsum(lengths) // most
    cuts = [*np.flatnonzero(np.r_[True, np.diff(part) > 0]), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def _plain(texts: pa.Array) -> pa.Array:
    return texts.fill_null("") if texts.null_count else texts


def rarity_table(docs: DataFrame, k: int = WORDS, bits: int = TABLE_BITS) -> np.ndarray:
    """For each value of a shingle hash's low bits, how far its count over all documents stands out (0: not at all).

    The table's size is fixed. It only orders elements, so any table gives the same links; a good one keeps common
    passages out of the prefixes. An element of level 0 has at most about 2 ** -bits of all elements for its count.
    """
    low = np.uint64((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for part in _sliced(batch, 0):
                total += np.bincount((shingle_sets(_plain(part.column(0)), k)[0] & low).astype(np.int64), minlength=1 << bits)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["slot", "n"])

    counted = docs.select("text").mapInArrow(lean(run), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    found = np.zeros(1 << bits)
    for r in counted.toLocalIterator():
        found[r["slot"]] = r["n"]
    mean = found.mean()
    over = (found - mean) / max(1.0, np.sqrt(mean))
    return np.where(over > 8, np.log2(np.maximum(over, 8)) - 2, 0).astype(np.uint8)


def sketches(h: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Of each set the parities of its elements by their low bits: as many bits as elements at least, a power of two."""
    n = np.diff(bounds)
    width = np.int64(1) << np.ceil(np.log2(np.maximum(n, 64))).astype(np.int64)
    starts = np.r_[0, np.cumsum(width)]
    low = h & np.repeat((width - 1).astype(np.uint64), n)
    odd = np.bincount(low.astype(np.int64) + np.repeat(starts[:-1], n), minlength=int(starts[-1])) & 1
    packed = np.packbits(odd.astype(np.uint8), bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((starts // 8).astype(np.int32)), pa.py_buffer(packed)])


def digests(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """doc_id, n (size of the set), k1, k2 (its digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _sliced(batch, 1):
                h, bounds = shingle_sets(_plain(part.column(1)), k)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(bounds)), *map(pa.array, _digest(h, bounds))], names=["doc_id", "n", "k1", "k2"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, n long, k1 long, k2 long")


def _digest(h: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    sums = [np.r_[np.uint64(0), np.cumsum(_mix(h ^ np.uint64(salt)))] for salt in (0x51ED2701A3C5E7F1, 0x2545F4914F6CDD1D)]
    return [(total[bounds[1:]] - total[bounds[:-1]]).view(np.int64) for total in sums]


def described(docs: DataFrame, levels: np.ndarray, k: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """The columns of digests(); least (the least hash) and sketch; cold and hot: the prefix elements of level 0 and above."""
    low = np.uint64(len(levels) - 1)

    def describe(part: pa.RecordBatch) -> pa.RecordBatch:
        h, bounds = shingle_sets(_plain(part.column(1)), k)
        n = np.diff(bounds)
        least = np.r_[h, np.uint64(0)][bounds[:-1]].view(np.int64)  # of an empty set any
        level = levels[(h & low).astype(np.int64)]
        owner = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((h, level, owner))
        rank = np.arange(len(h)) - np.repeat(bounds[:-1], n)
        chosen = order[rank < np.repeat(n - (num * n + den - 1) // den + 1, n)]
        lists = []
        for hot in (False, True):  # cold elements come first, so their places in the order are 0, 1, 2, ...
            own = chosen[(level[chosen] > 0) == hot]
            sizes = np.bincount(owner[own], minlength=len(n))
            lists.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(h[own].view(np.int64))))
        return pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(n.astype(np.int64)), *map(pa.array, _digest(h, bounds)), pa.array(least), sketches(h, bounds), *lists],
            names=["doc_id", "n", "k1", "k2", "least", "sketch", "cold", "hot"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from map(describe, _sliced(batch, 1))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, n long, k1 long, k2 long, least long, sketch binary, cold array<long>, hot array<long>")


def _leaders(num: int, den: int):
    """(rep, leader, n) for every element that several of a partition's rows share, run by run of sets that may link.

    Two sets whose first common element this is can't overlap in more than what follows it in either, which bounds the size of
    a partner: ``most``. Sets that no other fits in this way are left out, and where all sets up to a place have bounds under
    the sizes from there on, a new run begins. leader is the smallest rep of a run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [tuple(b.column(c).to_numpy() for c in range(4)) for b in batches if b.num_rows]
        if not parts:
            return
        h, rep, n, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((n, h))
        h, rep, n, place = h[order], rep[order], n[order], place[order]
        most = np.maximum((den + num) * (n - place) // num - n, 0)  # the largest set that this one may link with at this element
        fresh = np.r_[True, h[1:] != h[:-1]]
        # A base for each element keeps running maxima and look-ups inside it.
        base = np.cumsum(fresh) * (max(int(n.max()), int(most.max())) + 1)
        keep = _partnered(base, n, most, np.flatnonzero(fresh)[np.cumsum(fresh) - 1])
        base, rep, n, most = base[keep], rep[keep], n[keep], most[keep]
        if not len(n):
            return
        first = np.flatnonzero(np.r_[True, np.maximum.accumulate(base + most)[:-1] < (base + n)[1:]])
        leader = np.repeat(np.minimum.reduceat(rep, first), np.diff(np.r_[first, len(n)]))
        pair = np.unique(np.stack([rep, leader, n], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pair[:, i]) for i in range(3)], names=["rep", "leader", "n"])

    return run


def _partnered(base: np.ndarray, n: np.ndarray, most: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether another row of the same base has n <= this row's most and most >= this row's n. Sorted by base and n."""
    bound = base + most
    high = np.maximum.accumulate(bound)
    second = np.maximum.accumulate(np.minimum(np.r_[-1, high[:-1]], bound))
    end = np.searchsorted(base + n, bound, side="right")  # rows small enough end here
    last = np.maximum(end - 1, 0)
    own = (end > np.arange(len(n))) & (bound == high[last])  # the largest bound among them is this row's
    return (end > first) & (np.where(own, second[last], high[last]) >= base + n)


def without_contained(pairs: DataFrame) -> DataFrame:
    """The pairs (rep, leader) of blocks that aren't wholly inside the block of a smaller leader."""
    size = pairs.groupBy("leader").agg(F.count("*").alias("size"))
    own = pairs.select("rep", F.col("leader").alias("inner"))
    wider = pairs.select("rep", F.col("leader").alias("outer"))
    met = own.join(wider, "rep").filter("outer < inner").groupBy("inner", "outer").agg(F.count("*").alias("common"))
    inside = met.join(size, F.col("inner") == F.col("leader")).filter("common = size").select(F.col("inner").alias("leader")).distinct()
    return pairs.join(inside, "leader", "left_anti")


def may_link(n: np.ndarray, own: list[bytes], num: int, den: int, root: np.ndarray | None = None, ask: np.ndarray | None = None) -> np.ndarray:
    """Whether some other set of a block may link with this one, by sizes (n) and sketches. Exact: no link is lost.

    Sets of one ``root`` are connected already and needn't meet. With ``ask`` only pairs that have such a set count.

    Sets that link have sketches of one width or of neighbouring ones; the wider is folded. Neighbours are tried first, so near
    copies, side by side in the block, cost one comparison each; only sets still alone are compared with all of fitting size.
    """
    found = np.zeros(len(n), bool)
    root = np.arange(len(n)) if root is None else root
    ask = np.ones(len(n), bool) if ask is None else ask
    width = np.array([len(x) for x in own])
    for w in np.unique(width):
        at = np.flatnonzero((width == w) | (width == 2 * w))
        words = np.stack([x[: w // 8] ^ x[w // 8 :] if len(x) > w // 8 else x for x in (np.frombuffer(own[i], np.uint64) for i in at)])
        size, of, asks = n[at], root[at], ask[at]

        def near(x: np.ndarray, y: np.ndarray, words: np.ndarray = words, size: np.ndarray = size, of: np.ndarray = of, asks: np.ndarray = asks) -> np.ndarray:
            differ = np.bitwise_count(words[x] ^ words[y]).sum(axis=-1, dtype=np.int64)
            fits = (of[x] != of[y]) & (asks[x] | asks[y]) & (den * np.minimum(size[x], size[y]) >= num * np.maximum(size[x], size[y]))
            return fits & ((den + num) * differ <= (den - num) * (size[x] + size[y]))

        i = np.arange(len(at) - 1)
        beside = near(i, i + 1)
        found[at[:-1][beside]] = found[at[1:][beside]] = True
        by_size = np.argsort(size, kind="stable")
        # Who asks looks through all of fitting size, unless a neighbour was found and all ask: then whom it meets has been sent.
        ordered, alone = size[by_size], by_size[asks[by_size] & ~(found[at[by_size]] & asks.all())]
        step = max(1, 4_000_000 // (len(at) * int(w)))
        for s in range(0, len(alone), step):
            x = alone[s : s + step]
            lo = np.searchsorted(ordered, size[x[0]] * num // den)
            hi = np.searchsorted(ordered, -(-size[x[-1]] * den // num), side="right")
            y = by_size[lo:hi]
            a, b = np.nonzero(near(x[:, None], y[None, :]) & (x[:, None] != y[None, :]))
            found[at[x[a]]] = found[at[y[b]]] = True
    return found


def _send(num: int, den: int):
    """Over rows (leader, tile, rep, n, sketch, root, outside) sorted by block: the rows whose texts the block needs."""
    names, types = ["leader", "tile", "doc_id", "root"], (pa.int64(), pa.int32(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def result() -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                rep, n, sketch, root, outside = zip(*rows, strict=True)
                keep = may_link(np.array(n), list(sketch), num, den, np.array(root), np.array(outside))
                sent = [(*key, d, r) for d, r, k in zip(rep, root, keep, strict=True) if k]
                if sent:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*sent, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for *own, rep, n, sketch, root, outside in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != key:
                    yield from result()
                    key, rows = own, []
                rows.append((rep, n, sketch, root, outside))
        yield from result()

    return run


class SignatureTree:
    """Sets of a block in a tree of bitmaps. sets: sorted hash arrays."""

    def __init__(self, sets: list[np.ndarray]):
        # Near copies have the same least hashes, so this order puts them side by side, under the same nodes.
        self.order = sorted(range(len(sets)), key=lambda i: (sets[i][:2].tolist(), len(sets[i])))
        self.sets = [sets[i] for i in self.order]
        bits = np.zeros((len(sets), SIGNATURE), bool)
        for i, s in enumerate(self.sets):
            bits[i, (s % np.uint64(SIGNATURE)).astype(np.int64)] = True
        sizes = np.array([len(s) for s in self.sets], np.int64)
        #: Of each level, leaves first: bitmaps, least and largest size, most tokens beyond one a bit.
        self.levels = [(np.packbits(bits, axis=1).view(np.uint64), sizes, sizes, sizes - bits.sum(axis=1))]
        while len(self.levels[-1][1]) > 1:
            b, lo, hi, extra = self.levels[-1]
            at = np.arange(0, len(lo), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(b, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(extra, at)))

    def _may(self, level: int, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
        """Whether some sets under the nodes a and b may overlap enough: num * union <= den * overlap."""
        bits, lo, hi, extra = self.levels[level]
        common = np.bitwise_count(bits[a] & bits[b]).sum(axis=1).astype(np.int64)
        most = np.minimum(np.minimum(common + extra[a], common + extra[b]), np.minimum(hi[a], hi[b]))
        return (den + num) * most >= num * (np.maximum(lo[a], most) + np.maximum(lo[b], most))

    def links(self, num: int, den: int, known: list[int] | None = None) -> list[tuple[int, int]]:
        """Links that connect what belongs together: pairs that are connected already (``known``: components so far) aren't compared."""
        n = len(self.sets)
        root = np.unique([known[i] for i in self.order], return_inverse=True)[1].ravel() if known else np.arange(n)
        members: dict[int, list[int]] = {}
        for i, r in enumerate(root.tolist()):
            members.setdefault(r, []).append(i)
        out: list[tuple[int, int]] = []

        def verify(i: int, j: int) -> None:
            if root[i] == root[j]:
                return
            x, y = self.sets[i], self.sets[j]
            both = len(np.intersect1d(x, y, assume_unique=True))
            if den * both >= num * (len(x) + len(y) - both) and both:
                out.append((self.order[i], self.order[j]))
                into, of = sorted((int(root[i]), int(root[j])), key=lambda r: -len(members[r]))
                moved = members.pop(of)  # the smaller component takes the other's name
                root[moved] = into
                members[into] += moved

        for i in range(n - 1):  # neighbours first: most of a cluster is one component after this
            if root[i] != root[i + 1] and self._may(0, np.array([i]), np.array([i + 1]), num, den)[0]:
                verify(i, i + 1)
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        uniform: dict[int, tuple[int, np.ndarray]] = {}  # of each level: after how many links, whether a node's sets are one component
        while stack:
            level, a, b = stack.pop()
            if level == 0:
                keep = (a < b) & (root[a] != root[b])
                a, b = a[keep], b[keep]
                keep = self._may(level, a, b, num, den)
                for i, j in zip(a[keep].tolist(), b[keep].tolist(), strict=True):
                    verify(i, j)
                continue
            keep = self._may(level, a, b, num, den)
            a, b = a[keep], b[keep]
            width = FANOUT**level
            if level not in uniform or uniform[level][0] != len(out):
                at = np.arange(0, n, width)
                uniform[level] = len(out), np.minimum.reduceat(root, at) == np.maximum.reduceat(root, at)
            one = uniform[level][1]
            done = one[a] & one[b] & (root[a * width] == root[b * width])
            a, b = a[~done], b[~done]
            below = len(self.levels[level - 1][1])
            for s in range(0, len(a), 2048):
                x = (a[s : s + 2048, None] * FANOUT + np.arange(FANOUT)[None]).repeat(FANOUT, axis=1).ravel()
                y = np.tile(b[s : s + 2048, None] * FANOUT + np.arange(FANOUT)[None], (1, FANOUT)).ravel()
                fine = (x < below) & (y < below) & (x <= y)
                if fine.any():
                    stack.append((level - 1, x[fine], y[fine]))
        return out


def _block_links(k: int, num: int, den: int):
    """Over rows (leader, tile, doc_id, root, text) sorted by block: the links found in each block."""

    def links(ids: list[int], known: list[int], texts: list) -> list[tuple[int, int]]:
        if len(ids) < 2:
            return []
        h, bounds = shingle_sets(pa.array(texts, pa.large_string()), k)
        tree = SignatureTree([h[a:b] for a, b in zip(bounds, bounds[1:], strict=False)])
        return [(ids[x], ids[y]) for x, y in tree.links(num, den, known)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, known, texts, found = None, [], [], [], []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(2)), strict=True))
            for own, doc, root, text in zip(keys, *(batch.column(c).to_pylist() for c in range(2, 5)), strict=True):
                if own != key:
                    found += links(ids, known, texts)
                    key, ids, known, texts = own, [], [], []
                if not ids or ids[-1] != doc:
                    ids.append(doc)
                    known.append(root)
                    texts.append(text or "")
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])
                found = []
        found += links(ids, known, texts)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    return run


def _met(rows: DataFrame, classes: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links (a, b) in each block of rows (leader, tile, rep, root, outside). Pairs of one root, or both not outside, may be left out."""
    width = shuffle_width(docs.sparkSession)
    rows = rows.join(classes.select("rep", "n", "least", "sketch"), "rep").repartition(width, "leader", "tile").sortWithinPartitions("leader", "tile", "least", "n")
    sent = rows.select("leader", "tile", "rep", "n", "sketch", "root", "outside").mapInArrow(lean(_send(num, den)), "leader long, tile int, doc_id long, root long")
    texts = sent.join(docs, "doc_id").select("leader", "tile", "doc_id", "root", "text")
    texts = texts.repartition(width, "leader", "tile").sortWithinPartitions("leader", "tile", "doc_id")
    return texts.mapInArrow(lean(_block_links(k, num, den)), "a long, b long")


def _large_blocks(tiled: DataFrame, classes: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links of blocks dealt to tiles: rows (leader, members, tiles, tile, rep)."""
    every = lambda: F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile")
    pivot = F.pmod(F.xxhash64("rep", F.lit(1)), F.ceil(F.col("members") / PIVOTS)) == 0
    first = tiled.select("leader", "tile", "rep").union(tiled.filter(pivot).select("leader", every(), "rep")).distinct()
    near = staged(_met(first.select("leader", "tile", "rep", F.col("rep").alias("root"), F.lit(True).alias("outside")), classes, docs, k, num, den), "near")
    rooted = tiled.join(components(near), F.col("rep") == F.col("node"), "left").withColumn("root", F.coalesce("root", "rep"))
    rooted = staged(rooted.select("leader", "tiles", "tile", "rep", "root"), "rooted")
    top = rooted.groupBy("leader", "root").agg(F.count("*").alias("c")).groupBy("leader").agg(F.max(F.struct("c", "root"))["root"].alias("top"))
    rooted = rooted.join(top, "leader").withColumn("outside", F.col("root") != F.col("top"))
    away = rooted.filter("outside").select("leader", every(), "rep", "root", "outside")
    again = rooted.select("leader", "tile", "rep", "root", "outside").union(away).distinct()
    return near.union(_met(again, classes, docs, k, num, den))


def jaccard_components(docs: DataFrame, k: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: documents whose sets have num / den of their union in common link.

    Null, empty and blank texts have no shingles and link with nothing. Rows with the same doc_id are taken as one document's
    repeats if their texts are equal; ids are expected to name one text. A row with a null id has the component of the rows
    whose set equals its own (null where none has an id), and makes no link. Components are exact: no cap anywhere.
    """
    spark = docs.sparkSession
    width = shuffle_width(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    levels = rarity_table(docs, k)
    # The sets are made anew for the last join: that costs less than keeping the prefixes of all documents.
    same = [F.first(c).alias(c) for c in ("least", "sketch", "cold", "hot")]
    classes = described(docs, levels, k, num, den).filter("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), *same).filter("rep is not null")
    classes = staged(classes, "classes")
    cold = classes.select(F.posexplode("cold").alias("place", "h"), "rep", "n").select("h", "rep", "n", F.col("place").cast("long")).repartition(width, "h")
    pairs = cold.mapInArrow(lean(_leaders(num, den)), "rep long, leader long, n long")
    # Common elements: sizes in steps of num / den, each set with its step and the next, so sets that may link meet in one.
    step = F.floor(F.log(F.col("n")) / F.log(F.lit(den / num)) - 1e-9)
    hot = classes.select(F.posexplode("hot").alias("p", "h"), "rep", "n", F.size("cold").alias("ahead"), step.alias("b"))
    most = F.floor((den + num) * (F.col("n") - F.col("ahead") - F.col("p")) / num) - F.col("n")
    hot = hot.select("h", "rep", "n", most.alias("most"), F.explode(F.array(F.col("b"), F.col("b") + 1)).alias("b"))
    chief = hot.groupBy("h", "b").agg(F.min("rep").alias("leader"), F.min("n").alias("lo"), F.max("most").alias("hi"), F.count("*").alias("c")).filter("c > 1")
    fits = hot.join(chief, ["h", "b"]).filter("lo <= most and n <= hi").select("rep", "leader", "n")
    pairs = staged(pairs.union(fits).distinct(), "pairs")
    pairs = staged(without_contained(pairs), "blocks")
    sizes = pairs.groupBy("leader").agg(F.ceil(F.sum("n") / TILE).cast("int").alias("tiles"), F.count("*").alias("members"))
    small = pairs.join(sizes.filter("tiles = 1"), "leader").select("leader", F.lit(0).alias("tile"), "rep", F.col("rep").alias("root"), F.lit(True).alias("outside"))
    links = _met(small, classes, docs, k, num, den)
    large = sizes.filter("tiles > 1")
    if large.take(1):
        tiled = staged(pairs.join(large, "leader").select("leader", "members", "tiles", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int").alias("tile"), "rep"), "tiled")
        links = links.union(_large_blocks(tiled, classes, docs, k, num, den))
    roots = components(links)
    reps = digests(docs, k).join(classes.select("k1", "k2", "n", "rep"), ["k1", "k2", "n"], "left")
    out = reps.join(roots, F.col("rep") == F.col("node"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "rep", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents but those that have a smaller one in their component. Rows without an id stay."""
    rest = jaccard_components(docs, k, num, den).filter("doc_id != component_id").select(F.col("doc_id").alias("_pagemill_id")).distinct()
    return docs.join(rest, F.col("doc_id") == F.col("_pagemill_id"), "left_anti")
