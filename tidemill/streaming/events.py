"""Structured Streaming over event files: exactly-once intake, windows, order timeouts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, schema, at: str = "ts") -> DataFrame:
    """A stream of Parquet files; event time as a timestamp, which watermarks ask for."""
    return spark.readStream.schema(schema).parquet(path).withColumn(at, F.col(at).cast("timestamp"))


def deduplicated(events: DataFrame, key: str, at: str, delay: str = "24 hours") -> DataFrame:
    """Each message once, however often it is sent again within the delay."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def dead_letters(events: DataFrame, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Messages to handle, and those that were tried too often."""
    tried = F.col("retry_count") >= most
    return events.where(~tried), events.where(tried)


def windowed(events: DataFrame, at: str, size: str = "30 minutes", delay: str = "1 hour", *, by: str, value: str) -> DataFrame:
    """Counts and sums by window and kind; late rows count until the watermark passes."""
    return events.withWatermark(at, delay).groupBy(F.window(at, size).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def user_sessions(events: DataFrame, at: str, user: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of a user: events with no longer gap."""
    return events.withWatermark(at, delay).groupBy(F.session_window(at, gap).alias("w"), user).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def negative_streaks(events: DataFrame, user: str, at: str, kind: str, bad: str, least: int = 3) -> DataFrame:
    """(user, at, length) whenever a user's run of bad events reaches `least`; a run lives across batches."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState):
        run = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(at)
        out = []
        for when, what in zip(rows[at], rows[kind]):
            run = run + 1 if what == bad else 0
            if run == least:
                out.append((key[0], when, run))
        state.update((run,))
        yield pd.DataFrame(out, columns=["user", "at", "length"])

    return events.groupBy(user).applyInPandasWithState(step, "user long, at timestamp, length int", "run int", "append", GroupStateTimeout.NoTimeout)


def collect_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is into an in-memory table; for tests and small reports."""
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)
