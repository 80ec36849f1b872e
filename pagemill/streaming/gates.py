"""The gate of yearly editions as keyed state of a stream: of pages that differ only by a year, a newer edition passes.

The state of a family is the newest year seen. A family whose state isn't renewed for as long as it is to live is forgotten,
so that the state doesn't grow with all families ever seen.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagemill.functions import urls

#: A whole segment that can be the year of an edition.
YEAR_SEGMENT = r"/(199[0-9]|20[0-3][0-9])(?=/|$)"
ADMITTED = "family string, year int, page_id long, url string"


def editions(pages: DataFrame, year_of: Callable[[Column], Column] = F.array_max) -> DataFrame:
    """page_id, url, family and year of the pages (page_id, url) that have a year; several years count as the newest, or as ``year_of`` says."""
    path = urls.path(F.col("url"))
    years = F.transform(F.regexp_extract_all(path, F.lit(YEAR_SEGMENT), F.lit(1)), lambda y: y.cast("int"))
    family: Column = F.concat(urls.host(F.col("url")), F.lower(F.regexp_replace(path, YEAR_SEGMENT, "/~year~")))
    return pages.select("page_id", "url", family.alias("family"), year_of(years).alias("year")).filter("year is not null")


def admitted(pages: DataFrame, year_of: Callable[[Column], Column] = F.array_max) -> DataFrame:
    """The batch gate over editions in the order of their ids: a page passes if its year is above all before it in its family."""
    before = Window.partitionBy("family").orderBy("page_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = editions(pages, year_of).withColumn("newest", F.max("year").over(before))
    return rows.filter("newest is null or year > newest").select("family", "year", "page_id", "url")


class EditionGate(StatefulProcessor):
    """A row of a family and micro-batch passes if its year is above all that the family has shown."""

    def __init__(self, forget_after_ms: int | None = None):
        self.forget_after_ms = forget_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "year int", self.forget_after_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = self.newest.get()[0] if self.newest.exists() else None
        # Only the first row of each year can pass, so that is all that a family's frames leave in memory.
        first = None
        for frame in rows:
            part = frame.sort_values("page_id").drop_duplicates("year")
            first = part if first is None else pd.concat([first, part]).sort_values("page_id").drop_duplicates("year")
        passed = []
        for row in first.itertuples(index=False) if first is not None else ():
            if newest is None or row.year > newest:
                newest = int(row.year)
                passed.append((key[0], newest, row.page_id, row.url))
        if newest is not None:
            self.newest.update((newest,))
        if passed:
            yield pd.DataFrame(passed, columns=["family", "year", "page_id", "url"])

    def close(self) -> None:
        pass


def keyed_state(spark: SparkSession) -> None:
    """The state store that keyed processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def admitted_stream(pages: DataFrame, forget_after_ms: int | None = None, year_of: Callable[[Column], Column] = F.array_max) -> DataFrame:
    """The gate over a stream of pages (page_id, url), in the order in which its micro-batches bring them.

    A stream that forgets goes by the clock, so that it always has another batch to run: give it a trigger by processing time.
    """
    keyed_state(pages.sparkSession)
    mode = "none" if forget_after_ms is None else "processingTime"
    return editions(pages, year_of).groupBy("family").transformWithStateInPandas(EditionGate(forget_after_ms), ADMITTED, "append", mode)
