"""Record linkage and upkeep: the best record of a key, copies, differences between runs, carried rows, fuzzy evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows with an element that a task holds against all others with it.
MEETING = 1_000
#: Words of 64 bits of the signature that bounds what two rows can share.
WORDS = 4


def flag_losers(df: DataFrame, key: Sequence[str], order: Sequence[Column], flag: str = "is_duplicate") -> DataFrame:
    """Every row stays; all but the first of a key are flagged. End the order with something unique."""
    return df.withColumn(flag, F.row_number().over(Window.partitionBy(*key).orderBy(*order)) > 1)


def best_of_key(df: DataFrame, key: Sequence[str], rank: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """The row with the smallest rank of each key, by an aggregate: nothing is sorted, and tasks combine before the shuffle."""
    best = df.groupBy(*key).agg(F.min_by(F.struct(*keep), F.struct(*[c.alias(f"r{i}") for i, c in enumerate(rank)])).alias("_best"))
    return best.select(*key, "_best.*")


def diff_runs(old: DataFrame, new: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """key and status: new, removed, updated or unchanged. Each side has one row a key."""
    a = old.select(*key, F.col(value).alias("_old"), F.lit(1).alias("_in_old"))
    b = new.select(*key, F.col(value).alias("_new"), F.lit(1).alias("_in_new"))
    status = (
        F.when(F.col("_in_old").isNull(), "new").when(F.col("_in_new").isNull(), "removed")
        .when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("updated")
    )
    return a.join(b, list(key), "full_outer").select(*key, status.alias("status"))


def carry_forward(previous: DataFrame, current: DataFrame, key: Sequence[str], most: int = 3) -> DataFrame:
    """key, misses and origin: rows seen now have no misses; rows only known before stay for fewer than ``most`` runs."""
    p = previous.select(*key, "misses")
    c = current.select(*key, F.lit(True).alias("_seen"))
    both = p.join(c, list(key), "full_outer").withColumn("misses", F.when(F.col("_seen"), 0).otherwise(F.col("misses") + 1))
    return both.filter(F.col("misses") < most).select(*key, "misses", F.when(F.col("_seen"), "current").otherwise("carried").alias("origin"))


def dice_join(names: DataFrame, key: str, grams: str, least: float) -> DataFrame:
    """a, b and dice of the pairs of rows whose bigrams, counted as multisets, have a Dice similarity of ``least`` or more.

    Give each name once, under a unique key. A gram's second copy is another element than its first. Pairs that similar share
    one of the rarest elements of each (as many as may be missing, and one), so they meet on rare elements only and never
    as all pairs of a group; sizes too far apart don't meet. Where too few elements are left, or signatures tell that too many are
    lacking, nothing is compared. A pair counts where it meets first, so no pairs are gathered; what meets on one element is
    dealt to several tasks.
    """
    width = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The outer form lets no filter on the grams slip below what made the names different, where every row would pay for it.
    each = names.select(key, F.size(grams).alias("n"), F.explode_outer(grams).alias("g")).filter("g is not null").groupBy(key, "n", "g").agg(F.count("*").alias("c"))
    each = each.select(key, "n", F.explode(F.transform(F.sequence(F.lit(1), F.col("c").cast("int")), lambda i: F.concat_ws("\0", "g", i.cast("string")))).alias("e"))
    rarity = each.groupBy("e").agg(F.count("*").alias("df"))
    bit = F.pmod(F.xxhash64("e"), F.lit(64 * WORDS))
    each = each.join(rarity, "e").withColumn("word", F.floor(bit / 64)).withColumn("bit", (bit % 64).cast("int")).withColumn("bit", F.expr("shiftleft(1L, bit)"))
    bits = [F.bit_or(F.when(F.col("word") == w, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"bits{w}") for w in range(WORDS)]
    sets = each.groupBy(key, "n").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("es"), *bits)
    need = F.ceil(F.lit(least) / (2 - F.lit(least)) * F.col("n") - 1e-9)
    words = [f"bits{w}" for w in range(WORDS)]
    met = sets.select(key, "n", *words, F.transform("es", lambda x: x["e"]).alias("es"), F.posexplode(F.slice("es", F.lit(1), (F.col("n") - need + 1).cast("int"))).alias("at", "x"))
    met = met.select(key, "n", "es", *words, F.col("x.e").alias("e"), (F.col("n") - F.col("at")).alias("left"), F.ceil(F.col("x.df") / MEETING).cast("int").alias("tasks"))
    side = lambda k, salt: met.select("e", salt.alias("salt"), *[F.col(c).alias(f"{c}_{k}") for c in (key, "n", "es", "left", *words)]).repartition(width, "e", "salt")
    a, b = side("a", F.pmod(F.xxhash64(key), F.col("tasks")).cast("int")), side("b", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
    likeness = lambda shared: 2 * shared / (F.col("n_a") + F.col("n_b"))
    lacks = lambda x, y: sum((F.bit_count(F.col(f"{w}_{x}").bitwiseAND(F.bitwise_not(f"{w}_{y}"))) for w in words), F.lit(0))
    most = F.least("left_a", "left_b", F.col("n_a") - lacks("a", "b"), F.col("n_b") - lacks("b", "a"))
    pairs = a.join(b, ["e", "salt"]).filter(F.col(f"{key}_a") < F.col(f"{key}_b"))
    rows = pairs.withColumn("shared", F.when(likeness(most) >= least, F.array_intersect("es_a", "es_b"))).filter(F.get("shared", F.lit(0)) == F.col("e"))
    return rows.select(F.col(f"{key}_a").alias("a"), F.col(f"{key}_b").alias("b"), likeness(F.size("shared")).alias("dice")).filter(F.col("dice") >= least)
