"""Labelled samples for the trained operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n)).cast("int")


def training_ids(labels: DataFrame, label: str, folds: int, held: int, most: int) -> DataFrame:
    """doc_id and label of labelled rows outside the held-out fold; above ``most`` rows, an even share of them by hash.

    Null ids and labels other than 0 and 1 are left out; of a document's several labels the largest counts.
    """
    rows = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), folds) != held))
    rows = rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    n = rows.count()
    if n > most:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * most / n))
    return rows


def labelled_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, text and label of the chosen documents. ``ids`` is bounded by training_ids, so it may be broadcast.

    An id gives one row, however often it stands: of several texts under it the smallest by its digest. So repeated rows
    count once, and what trains is bounded in rows as it is in ids.
    """
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    # Digests decide, so that a text travels once: rows of an id are put together within tasks first.
    return rows.groupBy("doc_id").agg(F.min(F.struct(F.md5("text").alias("digest"), "text", "label")).alias("first")).select("doc_id", "first.text", "first.label")
