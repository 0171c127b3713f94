"""Structured streaming over event tables: windows, sessions, late data, keyed state, recoverable ledgers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lakeloom.sources.sinks import append_once

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Closed windows per type; events later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sliding_counts(events: DataFrame, width: str = "6 hours", step: str = "2 hours", late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def session_counts(events: DataFrame, gap: str = "12 hours", late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def without_repeats(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each event_id once, as far back as the watermark reaches."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def lane_cursors(events: DataFrame) -> DataFrame:
    """(lane, rows, epoch) after each batch: a cursor per lane over a pool of 100, kept as keyed state."""
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = (state.getOption or (0,))[0] + sum(len(f) for f in frames)
        state.update((seen,))
        yield pd.DataFrame({"lane": [key[0]], "rows": [seen], "epoch": [seen // 100]})

    return events.groupBy("event_type").applyInPandasWithState(step, "lane string, rows long, epoch long", "seen long", "update", GroupStateTimeout.NoTimeout)


def ledger_sink(events: DataFrame, path: str, checkpoint: str):
    """Append events to a ledger; a restart from the checkpoint neither loses nor repeats a batch."""
    return events.writeStream.foreachBatch(lambda df, i: append_once(df, i, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(df: DataFrame, name: str, mode: str = "append"):
    """Run a stream over what is there now into a memory table; for tests and small reports."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
