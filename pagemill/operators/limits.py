"""Greedy choices along a key's time line, which no window frame can say: whether a row is let through depends on those before it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def limited(events: DataFrame, key: str, at: str, order: str, gap: int, most: int, window: int) -> DataFrame:
    """key, order and allowed of the events: an attempt is allowed if ``gap`` seconds have gone by since the last allowed one and
    fewer than ``most`` were allowed in the running window.

    A key's first window opens with its first event; an event more than ``window`` seconds after the opening opens the next.
    Events go by time, ties by ``order``; null keys are a key of their own, events without a time are not allowed and change
    nothing. A key is one sorted stream that a task reads through in batches, with a few numbers of memory.
    """
    rows = events.select(F.col(key).cast("long").alias("k"), F.col(order).cast("long").alias("o"), F.col(at).cast("double").alias("t"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, last, opened, used = object(), None, None, 0
        for frame in frames:
            allowed = []
            for k, t in zip(frame["k"].astype(object), frame["t"], strict=True):
                k = None if pd.isna(k) else int(k)
                if k != own:
                    own, last, opened, used = k, None, None, 0
                if pd.isna(t):
                    allowed.append(False)
                    continue
                if opened is None or t - opened > window:
                    opened, used = t, 0
                fine = used < most and (last is None or t - last >= gap)
                if fine:
                    last, used = t, used + 1
                allowed.append(fine)
            yield frame.assign(allowed=allowed)[["k", "o", "allowed"]]

    found = rows.repartition("k").sortWithinPartitions("k", "t", "o").mapInPandas(run, "k long, o long, allowed boolean")
    return found.select(F.col("k").alias(key), F.col("o").alias(order), "allowed")
