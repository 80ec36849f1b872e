"""The pipeline's rows against the stages worked out by brute force, over a small corpus with every kind of odd row."""

import random
import zlib

import numpy as np
from helpers import corpus, sentence
from test_pairs import brute_components, brute_removed

from pagemill.llm import decontam, queries, toxicity


def brute_cut(docs, length=50):
    """Texts as the repeats stage leaves them: (id, text) of rows in id order, ids unique."""
    seen, out = set(), []
    for i, t in sorted((x for x in docs if x[0] is not None), key=lambda x: x[0]):
        b = (t or "").encode()
        cover = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if b[j : j + length] in seen:
                cover[j : j + length] = b"\1" * length
        seen |= {b[j : j + length] for j in range(len(b) - length + 1)}
        if any(cover):
            t = bytes(c for c, k in zip(b, cover, strict=True) if not k).decode("utf-8", "ignore")
            if not t:
                continue
        out.append((i, t))
    assert brute_removed([x for x in docs if x[0] is not None])  # the same rule as there
    return out + [x for x in docs if x[0] is None]


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = random.Random(51)
    items = [(i, sentence(rng, 12)) for i in range(4)]
    texts = corpus(52, 120)[:-2] + [f"a {items[0][1]} b", f"{sentence(rng, 9)} {items[1][1][:30]}X{items[1][1][31:]}", sentence(rng, 2500)]
    for i in range(0, 240):
        words = sentence(rng, rng.randint(10, 40)).split()
        if i % 3 == 0:
            words[rng.randrange(len(words))] = rng.choice(["nastyword", "badterm"])
            words.insert(0, "nastyword")
        texts.append(" ".join(words))
    docs = list(enumerate(texts)) + [(None, texts[3]), (None, None), (None, f"x {items[2][1]}")]
    labels = [(i, int("nastyword" in (t or "")), 1) for i, t in docs if i is not None and i % 5]
    folder = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, toxic, quality) for i, toxic, quality in labels], "doc_id long, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    train = [(t, y) for i, y, _ in labels for t in [texts[i]] if zlib.crc32(str(i).encode()) % toxicity.FOLDS != toxicity.HELD]
    grammar = toxicity.learn(spark.createDataFrame(train, "text string, label int"))
    left = [(i, t) for i, t in docs if grammar.score(t) < toxicity.CUT]
    assert 0 < len(docs) - len(left) < 160
    named = [(i, t) for i, t in left if i is not None]
    roots = brute_components([t for _, t in named], 5, 80, 100)[1]
    left = [x for k, x in enumerate(named) if roots[k] == k] + [x for x in left if x[0] is None]
    left = brute_cut(left)
    normal = decontam.normal

    def leaks(t):
        return any(normal(t) and decontam.myers(normal(x), normal(t))[0] <= decontam.budget(len(normal(x))) for _, x in items)

    left = [(i, t) for i, t in left if not leaks(t)]
    exact = Tokenizer.from_file(queries.tokenizer_path())
    want = []
    for i, t in left:
        ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = (len(ids) - 1) % 1024 + 1
        for end in range(first, len(ids) + 1, 1024):
            start = 0 if end == first else end - 1024
            want.append((i, start, end - start, zlib.crc32(ids[start:end].tobytes())))
    rows = corpus_pipeline.run(spark, folder).collect()
    got = [(r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 1024
