import random

WORDS = "alpha beta gamma delta épsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def corpus(seed=1, n=60):
    """Texts with copies, near copies, shared passages, nulls, empty and blank ones, repeated rows and a very long one."""
    rng = random.Random(seed)
    base = [sentence(rng, rng.choice([1, 2, 3, 5, 40, 90])) for _ in range(n // 3)]
    passage = sentence(rng, 30)
    out = []
    for _ in range(n):
        t = rng.choice(base)
        kind = rng.random()
        if kind < 0.3:
            words = t.split()
            words[rng.randrange(len(words))] = "edited"
            t = " ".join(words)
        elif kind < 0.5:
            t = f"{sentence(rng, 20)}\n{passage} {sentence(rng, 5)}"
        out.append(t)
    return [*out, None, "", "  \n ", "x", sentence(rng, 30_000), sentence(rng, 3) * 400]


def frame(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def clash(df):
    """The rows with extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    for c in ("rank", "score", "label", "chunk", "leader", "sequence_id", "item_id", "n", "size", "kept"):
        df = df.withColumn(c, F.lit("other"))
    return df
