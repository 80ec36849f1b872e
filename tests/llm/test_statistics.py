"""Clusters, tokeniser fertility and phrases, each against a plain version of its rules."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from compare import rows_of_frame, rows_of_sql
from helpers import SCHEMA, clash, corpus, frame

from pagemill.llm import ball_kmeans, fertility, phrases, queries

BYTES, PIECES = queries.tokenizer_path("byte_bpe_multi_50k.tiktoken"), queries.tokenizer_path("piece_bpe_32k.model")


def plain_kmeans(rows, k, rounds, seed=1):
    """Every vector against every centroid, in Python's integers."""
    kept = [(i, tuple(math.floor(64 * x) for x in v)) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    starts = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in starts[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda: [min((far(v, c), j) for j, c in enumerate(centroids)) for _, v in kept] if centroids else []
    for _ in range(rounds):
        at = nearest()
        for j in range(len(centroids)):
            if own := [v for (_, v), (_, c) in zip(kept, at, strict=True) if c == j]:
                centroids[j] = tuple(sum(x) // len(own) for x in zip(*own, strict=True))
    at = nearest()
    sums = Counter()
    for d, j in at:
        sums[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((str(i), j, d, sums[j], sum(sums.values()), digest[j]) for (i, _), (d, j) in zip(kept, at, strict=True))


def vectors(seed, n=120):
    """Coarse grids, so that distances tie, with copies, a very large group of one vector, and rows that don't count."""
    rng = random.Random(seed)
    grid = lambda: [rng.choice([-0.04, 0.0, 0.02, 0.5]) if rng.random() < 0.15 else 0.0 for _ in range(64)]
    rows = [(i, grid()) for i in range(n)] + [(n + i, [0.25] * 64) for i in range(n // 2)]
    rows += [(3, rows[3][1]), (3, rows[3][1]), (None, grid()), (7000, [0.1] * 63), (7001, [0.1] * 65), (7002, None), (7003, [])]
    return [*rows, (7004, [None, *[0.0] * 63]), (7005, [float("nan"), *[0.0] * 63]), (7006, [float("-inf"), *[0.0] * 63]), (7007, [-3.7] * 64)]


@pytest.mark.parametrize(("seed", "k", "rounds"), [(1, 16, 3), (2, 5, 4), (3, 40, 2), (4, 1, 3)])
def test_clusters_equal_plain_rounds(spark, seed, k, rounds):
    rows = vectors(seed)
    df = clash(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).repartition(5)
    got = [(str(r["vec_id"]), *r[1:]) for r in ball_kmeans.ball_kmeans(df, k, rounds).collect()]
    assert sorted(got) == plain_kmeans(rows, k, rounds)


def test_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert ball_kmeans.ball_kmeans(spark.createDataFrame([], schema)).count() == 0
    assert ball_kmeans.ball_kmeans(spark.createDataFrame([(1, [0.0] * 3), (None, [0.0] * 64)], schema)).count() == 0
    got = ball_kmeans.ball_kmeans(spark.createDataFrame([(1, [0.0] * 64), (2, [1.0] * 64), (None, [1.0] * 64)], schema)).collect()
    assert sorted((str(r["vec_id"]), r["distance"]) for r in got) == [("1", 0), ("2", 0), ("None", 0)] and len({r["cluster"] for r in got}) == 2


def test_most_members_are_compared_with_few_centroids():
    rng = np.random.default_rng(1)
    centres = rng.integers(-400, 400, (8, 64))
    x = np.repeat(centres, 50, axis=0) + rng.integers(-3, 4, (400, 64))
    before = np.repeat(np.arange(8), 50)
    balls = ball_kmeans.Balls.of(centres, [40] * 8)
    assert not any(balls.neighbours)  # far balls have no neighbour: nothing is compared
    cluster, _ = ball_kmeans.move(x, before, balls)
    assert (cluster == before).all()


@pytest.mark.parametrize("name", ["op11_ball_kmeans", "op13_phrase_collocations"])
def test_query_equals_its_sql(spark, sf_dir, name):
    assert rows_of_frame(queries.queries()[name](spark, sf_dir)) == rows_of_sql(queries.oracle_sql()[name], sf_dir)


def plain_base(text):
    """The base counts, one character and one word at a time."""
    words, word = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] * bool(word)
            word = ""
        else:
            word += c
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = text.split("\n")
    again = sum(1 for i, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r") and x in lines[:i])
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered)


def plain_measures(text):
    """Characters per token, byte share and evenness of the words encoded one by one."""
    quick, pieces, _ = fertility._vocabularies(BYTES, PIECES)
    words = text.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0.0, 0.0, 0.0
    ids = [i for w in words for i in pieces.encode(w)]
    share = Counter(ids)
    entropy = -sum(c / len(ids) * math.log2(c / len(ids)) for c in share.values())
    shown = sum(len(quick.encode_ordinary(" " + w)) for w in words)
    return sum(map(len, words)) / shown, sum(pieces.is_byte(i) for i in ids) / len(ids), entropy / max(1.0, math.log2(len(ids)))


ODD = ["a b c a b c a b c", "x\ny\nx\n x\nx\n\n\n", "日本語 の テキスト です", "Привет мир " * 30, "a b c", "ქართული ენა 𐍈𐍉 \U0001f600", "# * $ % & | < >", "\x00 \x1c\x1d z", "ab" * 9000]


def test_base_counts_and_measures(spark):
    texts = [*(t for t in corpus(5) if t is None or len(t) < 40_000), *ODD]
    rows = fertility.measures(clash(frame(spark, texts)), BYTES, PIECES).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_base(text)
        assert (r["chars_per_token"], r["byte_share"], r["evenness"]) == pytest.approx(plain_measures(text))
    script = {texts[r["doc_id"]]: r["script"] for r in rows}
    assert script[ODD[2]] in ("kana", "han") and script[ODD[3]] == "cyrillic" and script[ODD[5]] == "georgian" and script[ODD[6]] == script[None] == "none"



def fertility_corpus():
    rng = random.Random(4)
    words = "the of winter water light because morning people small between house river answer garden window letter music number".split()
    clean = [" ".join(rng.choice(words) + rng.choice(["", "s", "ing"]) for _ in range(rng.randint(60, 300))) for _ in range(60)]
    junk = [" ".join("".join(rng.choice("qxzjkvw0123456789") for _ in range(9)) for _ in range(120)) for _ in range(3)]
    spelt = [" ".join(rng.choice(words) + chr(0x1D000 + rng.randrange(200)) * 2 for _ in range(90)) for _ in range(2)]  # symbols spelt in bytes
    rows = [(i, t, "en", "s", 0) for i, t in enumerate([*clean, *junk, *spelt])]
    rows += [(500 + i, junk[0], "en", "s", 0) for i in range(200)]  # copies don't move the bands
    return [*rows, (900, junk[1], "xx", "s", 0), (901, None, None, None, None), (902, "", "en", "s", 0), (None, clean[0], "en", "s", 0), (0, clean[0], "en", "s", 0)], len(clean), len(junk) + len(spelt)


def test_bands_reject_odd_texts_and_keep_clean_ones(spark):
    rows, clean, odd = fertility_corpus()
    got = fertility.fertility_rules(clash(spark.createDataFrame(rows, SCHEMA)), BYTES, PIECES).collect()
    assert len(got) == len(rows)
    for r in got:
        i = r["doc_id"]
        if i is None or i < clean:
            assert r["kept"] and not r["base_failed"]
        elif i < clean + odd or 500 <= i < 900:
            assert not r["kept"] and not r["base_failed"]
        elif i == 900:  # a language with one text has no bands
            assert r["kept"]
        else:
            assert r["base_failed"] and not r["kept"]


def test_verdicts_follow_from_quartiles(spark):
    rows, *_ = fertility_corpus()
    got = [r.asDict() for r in fertility.fertility_rules(spark.createDataFrame(rows, SCHEMA), BYTES, PIECES).collect()]
    text = {(r[0], r[1]): r[1] for r in rows}
    lang = {r[0]: r[2] or "und" for r in rows}
    groups = {}
    for r in got:
        if not r["base_failed"]:
            t = next(t for (i, _), t in text.items() if i == r["doc_id"])
            groups.setdefault((lang[r["doc_id"]], r["script"]), {})[t] = [round(r[m] * 512 + 1e-12) for m in fertility.MEASURES]
    for r in got:
        values = list(groups.get((lang[r["doc_id"]], r["script"]), {}).values())
        bad = False
        if len(values) >= 20 and not r["base_failed"]:
            for (m, least), column in zip(fertility.LEAST_WIDTH.items(), np.array(values).T, strict=True):
                low, mid, high = np.quantile(column, [0.25, 0.5, 0.75]) / 512
                scale = mid if m == "chars_per_token" else 1.0
                room = max((high - low) * 6, scale * least) + scale * 1.5 / math.sqrt(max(r["tokens"], 1))
                bad |= r[m] > high + room or m != "byte_share" and r[m] < low - room
        assert r["kept"] == (not r["base_failed"] and not bad)


def test_fertility_of_an_empty_table(spark):
    assert fertility.fertility_rules(spark.createDataFrame([], SCHEMA), BYTES, PIECES).count() == 0


def plain_phrases(rows, least, longest, top):
    """All phrases counted in dictionaries, in Python's integers."""
    f, n = {}, Counter()
    for text, lang in rows:
        lang, text = lang or "und", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\x0b\x0c\r":
            text = text.replace(c, "\n")
        for piece in text.split("\n"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    k = lang, tuple(w[i : i + m])
                    f[k] = f.get(k, 0) + 1
    candidates = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    taken = {}
    for (lang, w), a in candidates.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                k = lang, w[i : i + m]
                taken[k] = max(taken.get(k, 0), a)
    found = {}
    for (lang, w), a in candidates.items():
        if 100 * taken.get((lang, w), 0) >= 80 * a:
            continue
        score, _, left, right = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, x in found.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:top], 1))


def phrase_rows(seed):
    rng = random.Random(seed)
    words = "Ab cd éf Gh ij kl mn ÄÖ x y".split()
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", "\n", " . ", "\x0c", "\x1c"]) for _ in range(rng.randint(0, 90))) for _ in range(60)]
    rows = [(t, rng.choice(["en", "en", "fr", None])) for t in texts] + [("one fixed line of copies", "en")] * 90 + [("same same same same same same", "de")] * 20
    return [*rows, (None, "en"), ("", None), ("  \t ", "en"), ("ab cd " * 3000, "en")]


@pytest.mark.parametrize(("seed", "least", "longest", "top", "bits"), [(1, 3, 4, 2000, 1 << 26), (2, 2, 4, 7, 64), (3, 5, 2, 2000, 1 << 26), (4, 2, 5, 2000, 1 << 10)])
def test_phrases_equal_plain_counts(spark, monkeypatch, seed, least, longest, top, bits):
    """A bitmap of 64 bits lets most pairs through; results don't change."""
    rows = phrase_rows(seed)
    df = clash(spark.createDataFrame([(i, t, lang, "s", 0) for i, (t, lang) in enumerate(rows)], SCHEMA)).repartition(5)
    got = phrases.collocations(df, least, longest, top, bits=bits).collect()
    assert sorted(tuple(r) for r in got) == plain_phrases(rows, least, longest, top)


def test_slices_of_few_words_count_the_same(spark):
    rows = phrase_rows(9)
    pieces = phrases.distinct_pieces(spark.createDataFrame([(t, lang) for t, lang in rows], "text string, lang string")).repartition(3).cache()
    sums = lambda size: sorted(map(tuple, phrases.partial_counts(pieces, (1, 2, 3, 4), None, slice_words=size).groupBy("lang", "phrase").sum("times").collect()))
    assert sums(1) == sums(500_000)


def test_scores_beyond_64_bits(spark):
    """Counts of 10^13 and more: 2,000,000 times them passes 64 bits."""
    a = 10**13
    row = spark.createDataFrame([(a, a + 7, a)], "a long, l1 long, r1 long")
    got = row.selectExpr(f"cast({phrases.FACTOR} * cast(a as decimal(20, 0)) div (cast(l1 as decimal(20, 0)) + r1) as bigint)").first()[0]
    assert got == 2_000_000 * a // (2 * a + 7)


def test_phrases_of_empty_tables(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert phrases.collocations(frame(spark, [None, "", "a b"])).count() == 0
