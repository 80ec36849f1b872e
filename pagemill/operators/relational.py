"""Relational operators: dynamic filters, pages by cursor, top rows of a group, recounts, rates, summaries."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contains_text(col: str, needle: str) -> Column:
    """Case-insensitive containment; % and _ in the needle are plain characters."""
    safe = needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return F.col(col).ilike(f"%{safe}%")


def where(df: DataFrame, equals: dict | None = None, at_least: dict | None = None, at_most: dict | None = None, search: tuple[Sequence[str], str] | None = None) -> DataFrame:
    """Rows that meet every given condition; a condition whose value is None isn't one."""
    found = [F.col(k) == v for k, v in (equals or {}).items() if v is not None]
    found += [F.col(k) >= v for k, v in (at_least or {}).items() if v is not None]
    found += [F.col(k) <= v for k, v in (at_most or {}).items() if v is not None]
    if search and search[1]:
        found.append(functools.reduce(operator.or_, [contains_text(c, search[1]) for c in search[0]]))
    return df.filter(functools.reduce(operator.and_, found)) if found else df


def keyset_page(df: DataFrame, keys: Sequence[str], after: Sequence | None, take: int) -> DataFrame:
    """The next ``take`` rows in descending order of the keys, and one more that tells whether others follow.

    The last key must be unique, or rows with equal keys get lost between pages.
    """
    if after is not None:
        cond, same = F.lit(False), F.lit(True)
        for k, v in zip(keys, after, strict=True):
            cond, same = cond | (same & (F.col(k) < v)), same & (F.col(k) == v)
        df = df.filter(cond)
    return df.orderBy(*[F.desc(k) for k in keys]).limit(take + 1)


def first_of_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group; end the order with something unique."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")


def with_total(df: DataFrame, by: str, aggs: Sequence[Column], total: str = "TOTAL") -> DataFrame:
    """One row a group and one for all of them."""
    rows = df.rollup(by).agg(F.grouping(by).alias("_all"), *aggs)
    return rows.withColumn(by, F.when(F.col("_all") == 1, total).otherwise(F.col(by))).drop("_all")


def trailing(df: DataFrame, ts: str, interval: str) -> DataFrame:
    """The rows of the last interval before the newest time stamp."""
    newest = df.agg(F.max(ts).alias("_newest"))
    return df.join(F.broadcast(newest), F.col(ts) > F.col("_newest") - F.expr(f"interval {interval}")).drop("_newest")


def missing_from(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(other, list(keys), "left_anti")


def insert_new(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """old, and those rows of new whose key it lacks; of new rows with one key the first."""
    return old.unionByName(missing_from(first_of_group(new, keys, order), old, keys))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], update: Sequence[str]) -> DataFrame:
    """old with the named columns replaced where new has the key, and the rest of new appended. new has one row a key."""
    marked = new.select(*keys, *[F.col(c).alias(f"_{c}") for c in new.columns if c not in keys], F.lit(True).alias("_new"))
    both = old.withColumn("_old", F.lit(True)).join(marked, list(keys), "full_outer")
    out = []
    for c in old.columns:
        if c in keys:
            out.append(F.col(c))
        elif c in update:
            out.append(F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"_{c}") if f"_{c}" in marked.columns else F.lit(None)).alias(c))
    return both.select(*out)


def dataset_hash(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: a hash of the rows' values, whatever their order. Nulls are empty.

    Each row is hashed, and the hashes are hashed by the prefix of their value before they meet, so one task holds a few
    hundred strings, not all rows.
    """
    line = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    rows = df.select(F.sha2(line, 256).alias("h"))
    parts = rows.groupBy(F.substring("h", 1, 2).alias("p")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), "\n"), 256).alias("h"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "h"))), lambda s: s["h"]), "\n"), 256).alias("dataset_hash"))
