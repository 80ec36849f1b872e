"""Order MinHash fingerprints, with DataFrame functions alone.

A text is cut into units: words, single characters of scripts that put no spaces between words, and pieces of over-long
words, which end where their characters say, not at fixed places; so an edit changes the units near it only. Its k-mers of
units are numbered by occurrence, so that a k-mer's second copy is another element than its first. One hash ranks all elements; its top bits
deal them to 2 ** ``slot_bits`` slots, and each slot keeps its two minimal elements. Those are put back in text order
and the ordered pair is hashed: a slot agrees between two texts when they share the elements and their order, which
follows edit distance rather than set overlap. Every slot uses the one hash, so a text is hashed once, not once a slot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql.window import WindowSpec
from pyspark.sql import functions as F

from pagemill.llm.common import shuffle_width

# Code points of scripts written without spaces (Thai to Lao, Myanmar, Khmer, kana, CJK ideographs).
UNSPACED = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\x{20000}-\x{323AF}"
WITHIN = rf"[^\s{UNSPACED}]"
#: A character of an unspaced script; a word of at most 16 characters; a piece of a longer one, up to a vowel, digit or sign.
UNIT = rf"[{UNSPACED}]|{WITHIN}{{1,16}}+(?!{WITHIN})|{WITHIN}{{1,15}}?[aeiouAEIOU0-9+/=_-]|{WITHIN}{{1,16}}"
K, SLOT_BITS = 3, 6
PLACE_BITS = 24
PLACE = (1 << PLACE_BITS) - 1


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _first_index(ordered: Column, element: Column) -> Column:
    """The first place of an element's hash in the ordered array, by bisection (only asked for repeated k-mers)."""
    floor = element.bitwiseAND(F.lit(~PLACE))
    step = lambda a, _: _let(
        F.shiftright(a["lo"] + a["hi"], 1),
        lambda mid: F.when(a["lo"] >= a["hi"], a)
        .when(F.get(ordered, mid) < floor, F.struct((mid + 1).alias("lo"), a["hi"].alias("hi")))
        .otherwise(F.struct(a["lo"].alias("lo"), mid.alias("hi"))),
    )
    start = F.struct(F.lit(0).alias("lo"), F.size(ordered).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(26)), start, step)["lo"]


def order_minhash(text: Column, k: int = K, slot_bits: int = SLOT_BITS) -> Column:
    """The codes (slot * 65536 + 16 bits of the ordered tuple's hash) of the slots that have elements; null or blank: none.

    An element is one number, 40 bits of hash above 24 bits of place, so that sorting is on plain numbers; the order of
    words more than 16 million apart is not told. The last k - 1 k-mers of a text are shorter, so texts of fewer than k
    words have elements as well.
    """
    slot = lambda e: F.shiftrightunsigned(e, 64 - slot_bits)
    place = lambda e: e.bitwiseAND(F.lit(PLACE))
    element = lambda hashed, at: hashed.bitwiseAND(F.lit(~PLACE)).bitwiseOR(at)

    def elements(units: Column) -> Column:
        one = lambda u, i: element(F.xxhash64(u, *[F.get(units, i + j) for j in range(1, k)]), place(i.cast("long")))
        return F.sort_array(F.transform(units, one))

    def numbered(ordered: Column) -> Column:
        def one(e: Column, j: Column) -> Column:
            kmer = F.shiftright(e, PLACE_BITS)
            again = F.shiftright(F.get(ordered, j - 1), PLACE_BITS) == kmer
            occurrence = F.when(again, j - _first_index(ordered, e)).otherwise(F.lit(0))
            return element(F.xxhash64(kmer, occurrence), place(e))

        return F.sort_array(F.transform(ordered, one))

    def minimal(ranked: Column) -> Column:
        return F.filter(ranked, lambda e, j: F.coalesce(slot(F.get(ranked, j - 2)) != slot(e), F.lit(True)))

    def tuples(least: Column) -> Column:
        def one(e: Column, j: Column) -> Column:
            mate = F.get(least, j + 1)
            own = lambda x: F.shiftright(x, PLACE_BITS)
            pair = (
                F.when(F.coalesce(slot(mate) != slot(e), F.lit(True)), F.xxhash64(own(e)))
                .when(place(mate) > place(e), F.xxhash64(own(e), own(mate)))
                .otherwise(F.xxhash64(own(mate), own(e)))
            )
            code = F.shiftleft(slot(e).cast("int"), 16) + F.pmod(pair, F.lit(65536)).cast("int")
            return F.when(slot(F.get(least, j - 1)) == slot(e), F.lit(None)).otherwise(code)

        return F.filter(F.transform(least, one), lambda c: c.isNotNull())

    units = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(UNIT), F.lit(0))
    return _let(units, lambda u: _let(elements(u), lambda o: _let(numbered(o), lambda r: _let(minimal(r), tuples))))


def as_string(codes: Column) -> Column:
    return F.array_join(F.transform(codes, lambda c: F.lpad(F.lower(F.hex(c)), 6, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of the slots used by either text that agree; two texts without words are alike."""
    slots = lambda c: F.transform(c, lambda x: F.shiftright(x, 16))
    either = F.size(F.array_union(slots(a), slots(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def with_successor(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, WindowSpec]:
    """Rows dealt to ranges (column _part), each range followed by the next one's first row (_guest).

    Rows stand in descending order of the key, rows with the same key by their texts' hashes, null keys last; the row after
    the last is the first. Ranges follow the key's quantiles, and for null keys even shares of the hashes, so only their
    bounds and first rows, as many as shuffle partitions, reach the driver. Returns the rows and the window in which lead()
    finds a row's successor.
    """
    spark = docs.sparkSession
    width = shuffle_width(spark)
    at = [i / width for i in range(1, width)]
    found = docs.agg(F.percentile_approx(key, at, 10000)).first()[0] if at else None
    bounds = sorted(set(found or []))
    above = F.size(F.filter(F.lit(bounds), lambda b: b < F.col(key))) if bounds else F.lit(0)
    hashed = docs.withColumn("_h", F.xxhash64(text))
    share = F.shiftrightunsigned(F.col("_h").bitwiseXOR(F.lit(-(1 << 63))), 32) * F.lit(width) / F.lit(1 << 32)
    rows = hashed.withColumn("_own", F.when(F.col(key).isNull(), -1 - F.floor(share)).otherwise(above).cast("int"))
    # A range's first row: the largest key, of those the least hash (bitwise not turns the order of hashes round).
    first = F.max(F.struct(F.col(key), F.bitwise_not("_h"))).alias("first")
    heads = {r["_own"]: r["first"] for r in rows.groupBy("_own").agg(first).collect()}
    down = sorted(heads, reverse=True)
    guests = [(before, heads[p][0], ~heads[p][1]) for p, before in zip(down, [*down[-1:], *down], strict=False)]
    columns = [F.lit([g[i] for g in guests]).cast("array<bigint>").alias(n) for i, n in enumerate(("_host", "_key", "_hash"))]
    hosts = F.broadcast(spark.range(1).select(F.inline(F.arrays_zip(*columns))))  # a row a range
    met = rows.join(hosts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_h") == F.col("_hash")), "left")
    place = lambda p, guest: F.struct(p.alias("_part"), F.lit(guest).alias("_guest"))
    both = F.when(F.col("_host").isNull(), F.array(place(F.col("_own"), False))).otherwise(
        F.array(place(F.col("_own"), False), place(F.col("_host").cast("int"), True))
    )
    dealt = met.withColumn("_place", F.explode(both)).select(*docs.columns, "_place.*", "_h")
    return dealt, Window.partitionBy("_part").orderBy("_guest", F.desc_nulls_last(key), "_h")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """The columns of op1: fingerprints of each text and its edited text, and their likeness.

    Null texts are empty. Rows with the same id follow each other by their texts' hashes, repeated rows included, each with a
    result; rows with a null id come last. A single row is its own successor; an empty table gives no rows.
    """
    rows, order = with_successor(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")))
    n = F.length("text")
    seen = rows.withColumn("_next", F.lead("text").over(order))
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("_next", F.lit(1), half))
    seen = seen.withColumn("n_chars", n.cast("long")).withColumn("edited", F.when(~F.col("_guest"), edited)).drop("_next")
    prints = seen.select(
        "doc_id", "_part", "_guest", "_h", "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        order_minhash(F.col("text")).alias("codes"),
        order_minhash(F.col("edited")).alias("edited_codes"),
    )
    near = prints.withColumn("_next", F.lead("codes").over(order)).filter(~F.col("_guest"))
    return near.select(
        "doc_id", "n_chars", "edited_sha256",
        as_string(F.col("codes")).alias("fingerprint"),
        as_string(F.col("edited_codes")).alias("edited_fingerprint"),
        likeness(F.col("codes"), F.col("edited_codes")).alias("near_edited"),
        likeness(F.col("codes"), F.col("_next")).alias("near_next"),
    )
