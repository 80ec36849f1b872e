"""State machines replayed in the order of a key's events, with one key's state in memory at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass
class Throttle:
    """Delay and concurrency towards a host, by the outcomes of its requests."""

    base: int = 1000
    most_delay: int = 30_000
    most: int = 4
    least: int = 1
    decay_after: int = 5
    recover_after: int = 10
    delay: float = 0
    concurrency: int = 4
    healthy: int = 0
    errors: int = 0

    def note(self, signal: str) -> None:
        if signal == "ok":
            self.errors = 0
            self.healthy += 1
            if self.delay > 0 and self.healthy >= self.decay_after:
                half = self.delay // 2
                self.delay, self.healthy = (0 if half <= 50 else half), 0
            elif self.concurrency < self.most and self.healthy >= self.recover_after:
                self.concurrency, self.healthy = self.concurrency + 1, 0
            return
        self.errors += 1
        self.healthy = 0
        if signal == "limited":
            self.delay, self.concurrency = min(self.most_delay, max(self.base, self.delay * 2)), self.least
        elif self.errors >= 3:
            self.delay, self.concurrency = min(self.most_delay, max(self.base / 2, self.delay * 1.5)), max(self.least, self.concurrency - 1)

    def result(self) -> tuple:
        return float(self.delay), self.concurrency


@dataclass
class Governor:
    """Whether a host is worth the slow lane: failures weigh 2, recoveries 1."""

    score: int = 0

    def note(self, signal: str) -> None:
        self.score = max(0, self.score - 1) if signal == "ok" else self.score + 2

    def result(self) -> tuple:
        return self.score, "disabled" if self.score >= 8 else "slow" if self.score >= 4 else "normal"


def replay(events: DataFrame, key: str, order: list[str], signal: str, machine: Callable, schema: str) -> DataFrame:
    """The final state of ``machine()`` for each key. Rows are dealt by key and sorted in Spark; Python reads them as a stream."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, out = None, None, []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

        for batch in batches:
            for k, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if state is None or k != current:
                    if state is not None:
                        out.append((current, *state.result()))
                    current, state = k, machine()
                state.note(s)
            if len(out) > 10_000:
                yield flush()
        if state is not None:
            out.append((current, *state.result()))
        if out:
            yield flush()

    dealt = events.repartition(key).sortWithinPartitions(key, *order)
    return dealt.select(key, signal).mapInArrow(run, schema)
