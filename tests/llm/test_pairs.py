"""Fingerprints, joins, repeats and leaks against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import SCHEMA, clash, corpus, frame, sentence
from pyspark.sql import functions as F

from pagemill.llm import components, decontam, ngram_join, omh, suffix_dedup


def roots(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute_components(texts, k=4, num=85, den=100):
    sets = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    return [len(s) for s in sets], roots(len(sets), links)


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components(spark, seed):
    texts = corpus(seed)
    sizes, want = brute_components(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(clash(frame(spark, texts))).collect()}
    assert got == {i: (s, c) for i, (s, c) in enumerate(zip(sizes, want, strict=True))}


def test_large_blocks_meet_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 300)
    texts = corpus(3)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)[1]


def test_common_elements_come_last(spark, monkeypatch):
    """With every slot of the table taken for common, the other path finds the same links."""
    monkeypatch.setattr(ngram_join, "rarity_table", lambda docs, k: np.ones(16, np.uint8))
    texts = corpus(4)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)[1]


def test_join_of_odd_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ngram_join.jaccard_components(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (8, None)], "doc_id long, text string")
    rows = sorted(map(tuple, ngram_join.jaccard_components(odd).collect()), key=str)
    assert rows == sorted([(None, 2, 7), (7, 2, 7), (7, 2, 7), (8, 0, 8)], key=str)


def test_one_of_each_keeps_columns(spark):
    docs = clash(frame(spark, ["a b c d e f", "a b c d e f", "other words are here now ok"]))
    out = ngram_join.one_of_each(docs)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [0, 2]


def test_shingles_of_slices(monkeypatch):
    texts = pa.array([t or "" for t in corpus(5)])
    whole = ngram_join.shingle_sets(texts)
    monkeypatch.setattr(ngram_join, "SLICE", 64)
    parts = ngram_join.shingle_sets(texts)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_signature_tree():
    rng = np.random.default_rng(1)
    for _ in range(30):
        base = [np.unique(rng.integers(0, 2**63, rng.integers(1, 60), dtype=np.uint64)) for _ in range(4)]
        sets = [s[rng.random(len(s)) < rng.choice([1, 0.97, 0.9])] for s in (base[rng.integers(4)] for _ in range(rng.integers(2, 50)))]
        sets = [s for s in sets if len(s)]
        links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * (c := len(np.intersect1d(sets[i], sets[j]))) >= 85 * (len(sets[i]) + len(sets[j]) - c)]
        assert roots(len(sets), links) == roots(len(sets), ngram_join.SignatureTree(sets).links(85, 100))


def test_sketches_lose_no_link():
    rng = np.random.default_rng(5)
    for _ in range(30):
        base = [np.unique(rng.integers(0, 2**63, rng.integers(1, 400), dtype=np.uint64)) for _ in range(4)]
        sets = [s[rng.random(len(s)) < rng.choice([1, 0.97, 0.9, 0.5])] for s in (base[rng.integers(4)] for _ in range(rng.integers(2, 50)))]
        sets = [s for s in sets if len(s)]
        sets += [rng.integers(0, 2**63, 300, dtype=np.uint64)]
        made = ngram_join.sketches(np.concatenate(sets), np.r_[0, np.cumsum([len(s) for s in sets])]).to_pylist()
        found = ngram_join.may_link(np.array([len(s) for s in sets]), made, 85, 100)
        for i in range(len(sets)):
            for j in range(i):
                if 100 * (c := len(np.intersect1d(sets[i], sets[j]))) >= 85 * (len(sets[i]) + len(sets[j]) - c):
                    assert found[i] and found[j]
        assert not found[-1]


def test_partners_by_place():
    rng = np.random.default_rng(6)
    for _ in range(50):
        base, n, most = np.sort(rng.integers(1, 5, 40)) * 100, rng.integers(1, 30, 40), rng.integers(0, 36, 40)
        n = n[np.lexsort((n, base))]
        first = np.searchsorted(base, base)
        want = [any(i != j and base[i] == base[j] and n[j] <= most[i] and n[i] <= most[j] for j in range(40)) for i in range(40)]
        assert ngram_join._partnered(base, n, most, first).tolist() == want


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def brute_removed(docs, length=50):
    seen, out = set(), {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        own = {b[j : j + length] for j in range(len(b) - length + 1)}
        cover = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if b[j : j + length] in seen:
                cover[j : j + length] = b"\1" * length
        seen |= own
        spans = len(re.findall(rb"\x01+", bytes(cover)))
        out[i] = (len(b), sum(cover), spans, hashlib.sha256(bytes(c for c, k in zip(b, cover, strict=True) if not k)).hexdigest())
    return out


@pytest.mark.parametrize("slice_bytes", [suffix_dedup.SLICE, 900])
def test_removal(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(suffix_dedup, "SLICE", slice_bytes)
    texts = [*corpus(6), "ab" * 200, "ab" * 90, "é" * 120, "xé" + "é" * 60]
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.removal_digests(clash(frame(spark, texts))).collect()}
    assert got == brute_removed(list(enumerate(texts)))


def test_removal_of_frequent_passages(spark, monkeypatch):
    """Salted blocks, whose parts meet in a second round, lose nothing; nor do pieces of long texts."""
    for name, value in (("COMMON", 4), ("SLICE", 900), ("BUCKET", 300)):
        monkeypatch.setattr(suffix_dedup, name, value)
    texts = [*corpus(9, 150), *corpus(9, 30), "ab" * 300]
    docs = frame(spark, texts).repartition(3)
    plain = docs.selectExpr("doc_id", "xxhash64(text) key", "text").filter("text is not null")
    assert len(suffix_dedup.frequent_grams(plain, 50, suffix_dedup.GRAM)[0].grams) > 3
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.removal_digests(docs).collect()}
    assert got == brute_removed(list(enumerate(texts)))


def test_minimisers_of_pieces(monkeypatch):
    data = np.frombuffer(sentence(random.Random(3), 900).encode(), np.uint8)
    whole = suffix_dedup.minimisers(data)
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    parts = suffix_dedup.minimisers(data)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_removal_with_one_id_twice(spark):
    a, b = ("eine erste Stelle, die länger als fünfzig Bytes ist, steht hier", "a second passage of more than fifty bytes stands in two rows")
    rows = [(1, f"{a} x"), (7, f"y {a}"), (7, f"z {b}"), (8, f"{b} q"), (7, f"y {a}")]
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix_dedup.removal_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    n, m = len(a.encode()), len(b.encode())
    assert got == sorted([(1, n + 2, 0), (7, n + 2, n), (7, n + 2, n), (7, m + 2, 0), (8, m + 2, m)])


def test_removal_of_odd_rows(spark):
    assert suffix_dedup.removal_digests(spark.createDataFrame([], SCHEMA)).count() == 0
    t = "a passage that is longer than fifty bytes stands in each of these rows"
    odd = spark.createDataFrame([(None, t), (5, t), (5, t), (9, t), (3, None)], "doc_id long, text string")
    rows = sorted(((r["doc_id"], r["n_removed"]) for r in suffix_dedup.removal_digests(odd).collect()), key=str)
    assert rows == sorted([(None, 0), (5, 0), (5, 0), (9, len(t)), (3, 0)], key=str)


def test_texts_without_repeats(spark):
    t = "ein Absatz mit Ümläuten, länger als fünfzig Bytes, steht in zwei Texten gleich"
    docs = frame(spark, [t, f"vorn {t} hinten", t, None, "kurz"])
    out = {r["doc_id"]: (r["text"], r["n_chars"]) for r in suffix_dedup.without_repeats(docs).collect()}
    assert out == {0: (t, len(t)), 1: ("vorn  hinten", 12), 3: (None, 0), 4: ("kurz", 4)}


def test_suffix_order():
    rng = np.random.default_rng(2)
    for alphabet in (1, 2, 4, 256):
        for n in (1, 2, 60, 400):
            data = rng.integers(0, alphabet, n).astype(np.uint8)
            raw, order = data.tobytes(), suffix_dedup.suffix_order(data)
            assert sorted(order.tolist()) == list(range(n))
            keys = [raw[i : i + 50] for i in order]
            assert all(a <= b for a, b in zip(keys, keys[1:], strict=False))


def test_myers():
    rng = random.Random(1)
    for _ in range(500):
        p, t = ("".join(rng.choice("ab ") for _ in range(rng.randint(a, 12))) for a in (1, 0))
        prev = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            row = [i]
            for j, d in enumerate(t, 1):
                row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (c != d)))
            prev = row
        assert decontam.myers(p, t) == (min(prev), prev.index(min(prev)))


def test_leaks(spark):
    rng = random.Random(2)
    items = [sentence(rng, 20) for _ in range(5)]
    edited = [items[0][:40] + "XX" + items[0][43:], items[1].upper().replace(" ", "\n "), items[2][:60]]
    texts = [sentence(rng, 60), f"a {items[0]} b", f"c {edited[0]} d", edited[1], edited[2], None, "", f"{items[3]} {sentence(rng, 9)} {items[4]}"]
    docs = clash(frame(spark, texts))
    bench = spark.createDataFrame([*enumerate(items), (9, None), (10, " ")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontam.find_leaks(docs, bench).collect()}
    assert got == {(1, 0): 0, (2, 0): 3, (3, 1): 0, (7, 3): 0, (7, 4): 0}
    # items in blocks give the same
    assert decontam.find_leaks(docs, bench, block_chars=200).count() == len(got)
    assert decontam.find_leaks(docs, bench.limit(0)).count() == 0 and decontam.find_leaks(docs.limit(0), bench).count() == 0
    kept = decontam.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 4, 5, 6]


def test_short_items_and_odd_rows(spark):
    bench = spark.createDataFrame([(1, "Yes"), (1, "Yes"), (None, "a longer item without any id, to be found"), (3, "")], "item_id long, text string")
    rows = [(1, "yesterday was fine", "x"), (2, " YES ", "x"), (None, "say: A longer item without any id, to be fuond.", "x"), (None, "clean", "x"), (5, "long " * 100_000, "x"), (5, "long " * 100_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    assert sorted(((r["doc_id"], r["item_id"], r["distance"]) for r in decontam.find_leaks(docs, bench).collect()), key=str) == [(2, 1, 0), (None, -1, 2)]
    assert [(r["doc_id"], r["text"][:5]) for r in decontam.drop_leaks(docs, bench, block_chars=20).orderBy("text").collect()] == [(None, "clean"), (5, "long "), (5, "long "), (1, "yeste")]


def test_leaks_equal_brute_force(spark):
    rng = random.Random(3)
    items = [(i, sentence(rng, rng.randint(3, 8))) for i in range(6)]
    texts = []
    for _ in range(40):
        own = list(rng.choice(items)[1])
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(len(own))] = rng.choice("abc")
        texts.append(f"{sentence(rng, 3)} {''.join(own)} {sentence(rng, 3)}")
    want = {
        (d, i): decontam.myers(decontam.normal(t), decontam.normal(x))[0]
        for d, x in enumerate(texts)
        for i, t in items
        if decontam.myers(decontam.normal(t), decontam.normal(x))[0] <= decontam.budget(len(decontam.normal(t)))
    }
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]): r["distance"] for r in decontam.find_leaks(frame(spark, texts), bench).collect()} == want




def test_order_minhash(spark):
    rng = random.Random(4)
    words = sentence(rng, 400).split()
    swapped = words[200:] + words[:200]
    texts = [" ".join(words), " ".join(words), " ".join(swapped), " ".join(words[:390] + ["z"] * 10), sentence(rng, 400), None, "", "one", "In. " * 500]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", omh.order_minhash(F.col("t")).alias("c"))
    a, b = (rows.select(F.col("i").alias(x), F.col("c").alias(f"c{x}")) for x in "ab")
    near = {(r["a"], r["b"]): r["n"] for r in a.join(b, F.lit(True)).select("a", "b", omh.likeness(F.col("ca"), F.col("cb")).alias("n")).collect()}
    assert near[0, 1] == 1 and near[5, 6] == 1 and near[7, 7] == 1 and near[8, 8] == 1
    assert near[0, 3] > near[0, 2] > near[0, 4] == 0  # moving half a text costs order, unlike in a set
    assert near[0, 5] == 0


def brute_codes(text, k=omh.K, bits=omh.SLOT_BITS):
    """Order MinHash of a text in plain Python, with the hashes of Spark's xxhash64."""
    import struct

    import regex
    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def chain(*parts):
        h = 42
        for p in parts:
            if p is not None:
                h = xxhash.xxh64_intdigest(p, seed=h)
        return signed(h)

    units = regex.findall(regex.sub(r"\\x\{(\w+)\}", lambda m: f"\\U{int(m[1], 16):08X}", omh.UNIT), text or "")
    units = [u.encode() for u in units]
    ordered = sorted(chain(*(units[i + j] if i + j < len(units) else None for j in range(k))) & ~omh.PLACE | i for i in range(len(units)))
    first, ranked = {}, []
    for j, e in enumerate(ordered):
        kmer = e >> omh.PLACE_BITS
        first.setdefault(kmer, j)
        ranked.append(chain(struct.pack("<q", kmer), struct.pack("<i", j - first[kmer])) & ~omh.PLACE | e & omh.PLACE)
    by_slot = {}
    for e in sorted(ranked):
        by_slot.setdefault((e % (1 << 64)) >> (64 - bits), []).append(e)
    codes = set()
    for slot, own in by_slot.items():
        pair = [struct.pack("<q", e >> omh.PLACE_BITS) for e in sorted(own[:2], key=lambda e: e & omh.PLACE)]
        codes.add(slot << 16 | chain(*pair) % 65536)
    return codes


def test_fingerprints_equal_brute_force(spark):
    rng = random.Random(8)
    cjk = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(300))
    texts = [*corpus(10, 40), "x" * 900, cjk, "ภาษาไทย" * 9, "a b c a b c a b c " * 40, "Donaudampfschifffahrtsgesellschaft " * 3, "".join(rng.choice("abcdefgh0123+/") for _ in range(2000))]
    ids = [5 * i + 1 for i in range(len(texts))]
    got = {r["doc_id"]: r for r in omh.fingerprint_edits(frame(spark, texts, ids)).collect()}
    for i, t in zip(ids, texts, strict=True):
        t, following = t or "", texts[(i - 1) // 5 - 1] or ""
        half = len(t) // 2
        own, edited, other = brute_codes(t), brute_codes(t[: len(t) - half] + following[:half]), brute_codes(following)
        row = got[i]
        assert {int(row["fingerprint"][a : a + 6], 16) for a in range(0, len(row["fingerprint"]), 6)} == own
        assert {int(row["edited_fingerprint"][a : a + 6], 16) for a in range(0, len(row["edited_fingerprint"]), 6)} == edited
        for likeness, codes in ((row["near_edited"], edited), (row["near_next"], other)):
            slots = {c >> 16 for c in own | codes}
            assert likeness == (len(own & codes) / len(slots) if slots else 1.0)


def test_fingerprints_of_unspaced_texts(spark):
    rng = random.Random(9)
    cjk = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(2000))
    code = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789+/") for _ in range(4000))
    texts = [cjk, "一" + cjk, "x", code, "Q" + code]
    got = {r["doc_id"]: r["near_next"] for r in omh.fingerprint_edits(frame(spark, texts)).collect()}
    assert got[1] > 0.9 and got[4] > 0.9


def test_successors_over_many_ranges(spark):
    """More ranges than rows, equal ids and many null ones: each row is followed by the next one."""
    rng = random.Random(10)
    rows = [(rng.choice([*[None] * 20, *range(30)]), sentence(rng, 3)) for _ in range(120)]
    rows += rows[:4]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "700")
    try:
        dealt, order = omh.with_successor(spark.createDataFrame(rows, "doc_id long, text string"))
        parts = [r["_part"] for r in dealt.filter("doc_id is null").select("_part").distinct().collect()]
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        seen = dealt.withColumn("next", F.lead("text").over(order)).filter("not _guest").select("doc_id", "text", "next", F.xxhash64("text").alias("h")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(parts) > 10
    ordered = sorted(seen, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["h"]))
    assert Counter((r["text"], r["next"]) for r in seen) == Counter((a["text"], b["text"]) for a, b in zip(ordered, [*ordered[1:], ordered[0]], strict=True))


def test_fingerprint_edits(spark):
    texts = [t for t in corpus(7) if t is None or len(t) < 5000]
    got = {r["doc_id"]: r for r in omh.fingerprint_edits(clash(frame(spark, texts, [3 * i for i in range(len(texts))]))).collect()}
    for i, t in enumerate(texts):
        t, following = t or "", texts[i - 1] or ""  # descending ids, and after the last the first
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        assert got[3 * i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[3 * i]["n_chars"] == len(t)
        if edited == t:
            assert got[3 * i]["fingerprint"] == got[3 * i]["edited_fingerprint"]
    same = Counter((t or "", got[3 * i]["fingerprint"]) for i, t in enumerate(texts))
    assert len({t for t, _ in same}) == len(same)
    long = [got[3 * i] for i, t in enumerate(texts) if len((t or "").split()) >= 40]
    assert sum(r["near_edited"] for r in long) > sum(r["near_next"] for r in long)


def test_fingerprints_of_odd_rows(spark):
    assert omh.fingerprint_edits(spark.createDataFrame([], SCHEMA)).count() == 0
    one = omh.fingerprint_edits(frame(spark, ["abcd"])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one["near_next"] == 1
    odd = spark.createDataFrame([(None, "q"), (1, "r"), (1, "r"), (1, None)], "doc_id long, text string")
    assert omh.fingerprint_edits(odd).count() == 4
