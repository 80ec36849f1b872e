"""Phrase collocation mining: counted phrases whose parts keep each other company.

1. Texts are cut into pieces; identical pieces of a language become one row and a multiplicity.
2. Tasks read distinct pieces in slices, number the words of a slice and count its phrases, weighted by the multiplicities,
   a word longer at a time. The partial counts go by hash of the phrase to buckets, and each bucket is summed by duckdb,
   streaming in and out, under a memory limit, spilling to the shared folder. Words and pairs are counted first; longer
   phrases only where every pair inside is frequent, which a bitmap of fixed size tells: what it lets through by chance is
   counted and found rare, so the counts are exact at every size.
3. Each candidate sends a look-up request for both parts of each cut; requests and counts meet by a shuffle on the part.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm.common import discard, shared_dir, shuffle_width, spread, staged

#: Fewest occurrences and most words of a candidate, rows a language, share (in percent) that a longer candidate takes over.
LEAST, LONGEST, TOP, SHARE, FACTOR = 30, 4, 2000, 80, 2_000_000
#: Words that a task counts at once, bits of the bitmap of frequent pairs, memory of a bucket's duckdb.
SLICE_WORDS, SIEVE_BITS, BUCKET_MEMORY = 500_000, 1 << 26, "256MB"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GRAMS = "lang string, phrase string, size int, times long"
COUNTS = "lang string, phrase string, size int, f long, place long"
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def distinct_pieces(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang (null: und), piece (lower-case words with one space between) and times, how often it stands; no empty pieces."""
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    cut = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.explode(F.split(text, "[.,;:!?\\x0A-\\x0D]")).alias("piece"))
    # Spaces at the ends and in runs, tabs anywhere.
    cut = cut.select("lang", F.trim(F.regexp_replace("piece", "[ \\t]{2,}|\\t", " ")).alias("piece")).filter("piece != ''")
    return cut.groupBy("lang", "piece").agg(F.count("*").alias("times"))


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * _B
        return h ^ (h >> np.uint64(29))


def _joined(left: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase that goes on with a word."""
    with np.errstate(over="ignore"):
        return _mixed(left * _A + word)


def _hashes(texts: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in texts), np.uint64, len(texts))


def _place(h: np.ndarray, bits: int) -> np.ndarray:
    return (h % np.uint64(bits)).astype(np.int64)


def pair_places(langs: list[str], phrases: list[str], bits: int) -> np.ndarray:
    """The bits of two-word phrases."""
    words = [p.split(" ") for p in phrases]
    h = _joined(_mixed(_hashes(langs)), _hashes([w[0] for w in words]))
    return _place(_joined(h, _hashes([w[1] for w in words])), bits)


def slice_counts(langs: pa.Array, pieces: pa.Array, times: np.ndarray, sizes: tuple[int, ...], sieve: np.ndarray | None, bits: int) -> Iterator[pa.RecordBatch]:
    """Weighted counts of the phrases of some pieces, for each size wanted; with a sieve, those whose pairs all have their bit."""
    words = pc.split_pattern(pieces, " ")
    ends = np.asarray(words.offsets)[1:].astype(np.int64)
    starts = np.asarray(words.offsets)[:-1].astype(np.int64)
    coded = words.values.dictionary_encode()
    vocabulary, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    tongue = langs.dictionary_encode()
    piece = np.repeat(np.arange(len(pieces)), ends - starts)
    lang_of, weight = tongue.indices.to_numpy(zero_copy_only=False).astype(np.int64)[piece], times[piece].astype(np.float64)
    end = ends[piece]  # behind a word's piece
    word_hash = _hashes(vocabulary.to_pylist()) if sieve is not None else None
    key, at, hashed, passed = lang_of, np.arange(len(code)), None, None
    known = _mixed(_hashes(tongue.dictionary.to_pylist()))[lang_of] if sieve is not None else None
    n = len(vocabulary)
    for size in range(1, max(sizes) + 1):
        go_on = at + size - 1 < end[at]
        key, at = key[go_on], at[go_on]
        last = code[at + size - 1]
        if sieve is not None and size <= 2:
            hashed = known if size == 1 else hashed[go_on]
            hashed = _joined(hashed, word_hash[last])
        if sieve is not None and size == 2:
            bit = _place(hashed, bits)
            good = (sieve[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1
            passed = np.zeros(len(code), bool)
            passed[at] = good.astype(bool)
            key, at, last = key[passed[at]], at[passed[at]], last[passed[at]]
        elif passed is not None:
            fine = passed[at + size - 2]
            key, at, last = key[fine], at[fine], last[fine]
        _, first, key = np.unique(key * n + last, return_index=True, return_inverse=True)
        if size in sizes and len(first):
            where = at[first]
            parts = [vocabulary.take(pa.array(code[where + k])) for k in range(size)]
            phrase = pc.binary_join_element_wise(*parts, " ") if size > 1 else parts[0]
            count = np.bincount(key, weight[at], len(first)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [tongue.dictionary.take(pa.array(lang_of[where])), phrase, pa.array(np.full(len(first), size, np.int32)), pa.array(count)], names=["lang", "phrase", "size", "times"]
            )


def partial_counts(pieces: DataFrame, sizes: tuple[int, ...], sieve: bytes | None = None, bits: int = SIEVE_BITS, slice_words: int = SLICE_WORDS) -> DataFrame:
    """A row for each phrase of each slice of the pieces."""
    sent = pieces.sparkSession.sparkContext.broadcast(sieve) if sieve is not None else None  # bits / 8 bytes, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        seen = np.frombuffer(sent.value, np.uint8) if sent is not None else None

        def counted() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            langs, texts = (t.column(c).combine_chunks() for c in ("lang", "piece"))
            for batch in slice_counts(langs, texts, t.column("times").to_numpy(), sizes, seen, bits):
                for a in range(0, batch.num_rows, 50_000):
                    yield batch.slice(a, 50_000)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.column(1).nbytes
                if size >= 7 * slice_words:
                    yield from counted()
                    held, size = [], 0
        if held:
            yield from counted()

    return pieces.select("lang", "piece", "times").mapInArrow(run, GRAMS)


def spill_root(spark: SparkSession) -> str | None:
    """A new folder for spilling under the shared folder, or None where that isn't a path of a file system."""
    base = shared_dir(spark)
    if base.startswith("file:"):
        base = "/" + base[5:].lstrip("/")
    return f"{base}/spill-{uuid.uuid4().hex}" if base.startswith("/") else None


def bucket_counts(grams: DataFrame, least: int, buckets: int, bits: int = SIEVE_BITS, memory: str = BUCKET_MEMORY) -> DataFrame:
    """lang, phrase, size, f and (of pairs) the bit, of every phrase with f >= least, summed by duckdb a hash bucket at a time.

    Spilled data go to a folder that the caller's run names and each task empties; where the shared folder is no plain path,
    duckdb gets none and a bucket has to fit ``memory``, so choose more buckets there.
    """
    spill = spill_root(grams.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import contextlib
        import os

        import duckdb

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return

        def rest() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        if spill:
            os.makedirs(spill, exist_ok=True)
        with tempfile.TemporaryDirectory(dir=spill) if spill else contextlib.nullcontext("") as folder, duckdb.connect() as con:
            con.execute(f"set threads = 1; set memory_limit = '{memory}'; set preserve_insertion_order = false; set temp_directory = '{folder}'")
            con.register("grams", pa.RecordBatchReader.from_batches(first.schema, rest()))
            found = con.sql(f"select lang, phrase, any_value(size)::int as size, sum(times)::bigint as f from grams group by lang, phrase having sum(times) >= {least}")
            for batch in found.to_arrow_reader(20_000):
                place = np.full(batch.num_rows, -1, np.int64)
                pairs = np.flatnonzero(batch.column(2).to_numpy(zero_copy_only=False) == 2)
                if len(pairs):
                    place[pairs] = pair_places(batch.column(0).take(pa.array(pairs)).to_pylist(), batch.column(1).take(pa.array(pairs)).to_pylist(), bits)
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(place)], names=["lang", "phrase", "size", "f", "place"])

    return grams.repartition(buckets, "lang", "phrase").mapInArrow(run, COUNTS)


def pair_sieve(counts: DataFrame, bits: int = SIEVE_BITS) -> bytes:
    """The bitmap of the frequent pairs' bits: bits / 8 bytes, gathered as blocks of 4 kB."""
    place = counts.filter("place >= 0").select((F.col("place") + 1).alias("p"))
    blocks = place.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
    out = np.zeros(-(-bits // 8), np.uint8)
    for r in blocks.collect():
        block = np.frombuffer(bytes(r["m"]), np.uint8)
        a = (r["b"] - 1) * len(block)
        out[a : a + len(block)] = block[: len(out) - a]
    return out.tobytes()


def phrase_counts(pieces: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int = SIEVE_BITS) -> DataFrame:
    """lang, phrase, size and f of all phrases of at most ``longest`` words that occur ``least`` times, exactly."""
    n = shuffle_width(pieces.sparkSession)
    short = staged(bucket_counts(partial_counts(pieces, (1, 2), None, bits), least, n, bits), "phrases")
    if longest <= 2:
        return short.filter(F.col("size") <= longest).drop("place")
    sizes = tuple(range(3, longest + 1))
    long = staged(bucket_counts(partial_counts(pieces, sizes, pair_sieve(short, bits), bits), least, n, bits), "phrases")
    return short.unionByName(long).drop("place")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, share: int = SHARE, bits: int = SIEVE_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases by their weakest cut.

    A null text is empty, a null language ``und``; repeated rows count as often as they stand. Ties of the score go to the
    higher count, then to the smaller phrase in UTF-8 byte order, so ranks are unique. Without candidates the result is empty.
    """
    pieces = staged(distinct_pieces(docs), "pieces")
    words = F.length("piece") - F.length(F.replace("piece", F.lit(" "), F.lit(""))) + 1
    totals = pieces.groupBy("lang").agg(F.sum(words * F.col("times")).alias("n"))
    counts = phrase_counts(pieces, least, longest, bits)
    candidates = counts.filter("size >= 2").withColumnRenamed("f", "a")

    cuts = candidates.select("lang", "phrase", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    head, tail = F.expr("substring_index(phrase, ' ', k)"), F.expr("substring_index(phrase, ' ', k - size)")
    requests = cuts.select("lang", "phrase", "size", "a", F.explode(F.array(*[F.struct(p.alias("part"), F.col("k").alias("k"), F.lit(s).alias("side")) for p, s in ((head, "l"), (tail, "r"))])).alias("q"))
    requests = requests.select("lang", "phrase", "size", "a", "q.*")
    met = requests.join(counts.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    sides = [F.max(F.when((F.col("k") == k) & (F.col("side") == s), F.col("f"))).alias(f"{s}{k}") for k in range(1, longest) for s in "lr"]
    told = met.groupBy("lang", "phrase", "size", "a").agg(*sides)
    score = lambda k: F.expr(f"cast({FACTOR} * cast(a as decimal(20, 0)) div (cast(l{k} as decimal(20, 0)) + r{k}) as bigint)")
    options = [F.when(F.col("size") > k, F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, longest)]
    scored = told.select("lang", "phrase", "a", F.array_min(F.filter(F.array(*options), lambda x: x.isNotNull())).alias("best"))

    inner = [(k, m) for m in range(2, longest) for k in range(longest)]
    part = lambda k, m: F.expr(f"case when {k} + {m} <= size and {m} < size then substring_index(substring_index(phrase, ' ', {k + m}), ' ', -{m}) end")
    inside = candidates.filter("size >= 3").select("lang", "a", F.explode(F.array(*[part(k, m) for k, m in inner])).alias("phrase")).filter("phrase is not null")
    longer = inside.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = scored.join(longer, ["lang", "phrase"], "left").filter(f"most is null or 100 * cast(most as decimal(20, 0)) < {share} * cast(a as decimal(20, 0))")

    rows = kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score").withColumn("salt", spread("phrase", n=max(64, shuffle_width(docs.sparkSession))))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations_sql(least: int = LEAST, longest: int = LONGEST, top: int = TOP, share: int = SHARE) -> str:
    """The same by plain counting of all phrases."""
    parts = [
        f"""pieces as (select row_number() over () as id, * from (select coalesce(lang, 'und') as lang,
            unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents))""",
        "worded as (select id, lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') as w from pieces)",
        "totals as (select lang, sum(len(w)) as n from worded group by lang)",
    ]
    grams = " union all ".join(
        f"select lang, {m} as size, unnest(list_transform(range(1, len(w) - {m - 2}), lambda i: array_to_string(list_slice(w, i, i + {m - 1}), ' '))) as phrase from worded where len(w) >= {m}" for m in range(1, longest + 1)
    )
    parts += [
        f"counts as (select lang, phrase, any_value(size) as size, count(*)::hugeint as f from ({grams}) group by lang, phrase having count(*) >= {least})",
        "split as (select lang, phrase, size, f as a, string_split(phrase, ' ') as w, unnest(range(1, size)) as k from counts where size >= 2)",
        f"""cuts as (select s.lang, s.phrase, s.a, s.k, l.f as l, r.f as r, {FACTOR} * s.a // (l.f + r.f) as score from split s
            join counts l on l.lang = s.lang and l.phrase = array_to_string(s.w[1:s.k], ' ') join counts r on r.lang = s.lang and r.phrase = array_to_string(s.w[s.k + 1:], ' '))""",
        "best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1)",
        f"""kept as (select b.* from best b where not exists (select 1 from counts c where c.lang = b.lang and c.size > len(string_split(b.phrase, ' '))
            and contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ') and 100 * c.f >= {share} * b.a))""",
        f"ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept qualify rank <= {top})",
    ]
    body = ",\n".join(parts)
    return f"""with {body}
        select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from ranked join totals using (lang)"""
