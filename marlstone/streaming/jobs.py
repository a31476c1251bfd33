"""Structured Streaming: the poll loop, windowed counters, stability of files over polls."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marlstone.operators.incremental import VersionedTable, run_once

# Poll interval and batch of events.
POLL, BATCH = "5 seconds", 100


def poll(spark: SparkSession, cycle: Callable[[int], None], interval: str = POLL, checkpoint: str | None = None) -> StreamingQuery:
    """Run ``cycle`` every interval. A streaming file source shows new files only, not rewritten or deleted ones, so a poll is a
    tick on which the cycle compares whole snapshots; ticks never overlap."""
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
    writer = ticks.writeStream.foreachBatch(lambda _, n: cycle(n)).trigger(processingTime=interval)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def windowed_counts(events: DataFrame, labels: list[str], width: str = "5 minutes", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Counts by event time; rows later than the watermark are dropped, windows come out once it has passed them."""
    timed = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    grouped = timed.groupBy(F.window("__ts", width), *labels).agg(F.count("*").alias("total"))
    return grouped.select(F.col("window.start").alias("window_start"), *labels, "total")


def distinct_events(events: DataFrame, key: str, late: str = "1 day", ts: str = "detected_at") -> DataFrame:
    """Events without those delivered again under the same key, within the watermark."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def ingest_stream(events: DataFrame, table: VersionedTable, name: str, checkpoint: str) -> StreamingQuery:
    """Append micro-batches to a versioned table, each exactly once: the batch's number is committed with its rows, and a batch that
    was committed before a failure is passed over when it is run again."""

    def write(batch: DataFrame, number: int) -> None:
        if table.manifest().processed.get(name, 0) >= number + 1:
            return
        table.append(batch, {name: number + 1})

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow(source: VersionedTable, sink: VersionedTable, transform: Callable[[DataFrame], DataFrame]) -> Callable[[int], None]:
    """A cycle for ``poll`` that brings the sink up to the source's latest version."""
    return lambda _: run_once(source, sink, transform)


def stable_files(observed: DataFrame) -> DataFrame:
    """(user_id, path, content_hash) of files seen twice in a row with one hash, once per content. ``observed`` streams (user_id,
    path, content_hash); the state of a file is its last and its last reported hash."""

    def look(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, told = state.get if state.exists else (None, None)
        out = []
        for frame in frames:
            for h in frame["content_hash"]:
                if h is not None and h == last and h != told:
                    told = h
                    out.append(h)
                last = h
        state.update((last, told))
        yield pd.DataFrame({"user_id": [key[0]] * len(out), "path": [key[1]] * len(out), "content_hash": out})

    return observed.groupBy("user_id", "path").applyInPandasWithState(look, "user_id string, path string, content_hash string", "last string, told string", "append", GroupStateTimeout.NoTimeout)
