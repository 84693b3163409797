"""Streaming twins of the line analytics: windows with watermarks, and runs with carried state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def stream(spark: SparkSession, path: str) -> DataFrame:
    """Events as a stream of files."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(path)


def windowed(events: DataFrame, *, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums by window and kind; rows later than the watermark are left out."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def summaries(events: DataFrame, gap: float) -> DataFrame:
    """Running totals by line, state carried from batch to batch: n, runs, length.

    Within a batch a line's samples are ordered; across batches they must arrive in order.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, runs, length, last = state.get if state.exists else (0, 0, 0.0, None)
        rows = pd.concat(frames).sort_values(["ts", "event_id"])
        for v in rows["value"]:
            d = None if last is None else abs(v - last)
            if d is None or d > gap:
                runs += 1
            else:
                length += d
            n, last = n + 1, float(v)
        state.update((n, runs, length, last))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "runs": [runs], "length": [length]})

    out = "user_id long, n long, runs long, length double"
    return events.groupBy("user_id").applyInPandasWithState(step, out, "n long, runs long, length double, last double", "update", GroupStateTimeout.NoTimeout)
