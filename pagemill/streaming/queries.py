"""Structured Streaming twins of batch queries. The same function shapes both; a finite run ends with all input read."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from pagemill.operators.replay import Throttle


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream, whether the table is one file or a folder of them."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")


def finished(stream: DataFrame, mode: str) -> DataFrame:
    """What the stream has given once all its input is read: every micro-batch is Parquet in the shared folder.

    In complete mode the last batch is the result, else all of them are. Nothing of it passes through the driver.
    """
    from pagemill.plans.source_queries import _place

    spark = stream.sparkSession
    path = _place(spark)

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batches/batch={batch}")  # a batch that is tried again replaces itself

    run = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    if run.lastProgress is None:
        return spark.createDataFrame([], stream.schema)
    found = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(f"{path}/batches")
    if mode == "complete":
        found = found.join(F.broadcast(found.agg(F.max("batch").alias("batch"))), "batch")
    return found.select(*stream.columns)


def half_hour_rates(events: DataFrame) -> DataFrame:
    """Events in tumbling windows of 30 minutes; late rows count for 10 minutes."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("at", "10 minutes")
    return rows.groupBy(F.window("at", "30 minutes").alias("w"), "event_type").agg(F.count("*").alias("n"))


def first_seen(pages: DataFrame) -> DataFrame:
    """The hosts seen, each once."""
    from pagemill.functions import urls

    return pages.select(urls.host(F.col("url")).alias("host")).dropDuplicates(["host"])


def throttle_states(events: DataFrame) -> DataFrame:
    """The throttle of each user's host after every batch of its events, kept as keyed state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        throttle = Throttle(delay=state.get[0], concurrency=state.get[1], healthy=state.get[2], errors=state.get[3]) if state.exists else Throttle()
        for signal in pd.concat(frames).sort_values(["ts", "event_id"])["signal"]:
            throttle.note(signal)
        state.update((float(throttle.delay), throttle.concurrency, throttle.healthy, throttle.errors))
        yield pd.DataFrame({"user_id": [key[0]], "delay": [float(throttle.delay)], "concurrency": [throttle.concurrency]})

    rows = events.select("user_id", "ts", "event_id", signal_of(F.col("event_type"), F.col("event_id")).alias("signal"))
    return rows.groupBy("user_id").applyInPandasWithState(
        step, "user_id long, delay double, concurrency int", "delay double, concurrency int, healthy int, errors int", "update", GroupStateTimeout.NoTimeout
    )


def signal_of(kind, event_id):
    """The outcome of a request, made from an event."""
    return F.when((kind == "error") & (event_id % 5 == 0), "limited").when(kind == "error", "failed").otherwise("ok")
