"""Live events: windowed counts with late data, and the health of sources as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factloom.session import ship

EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, per_trigger: int = 1) -> DataFrame:
    """The event log of a folder of parquet files: what is there is replayed, what arrives is tailed."""
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def progress(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type and window; events later than ``late`` behind the newest are dropped with their window."""
    windowed = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return windowed.select(F.col("window.start").alias("start"), "event_type", "n")


def cooldown(failures: int, base: int = 60, most: int = 3600) -> int:
    """Seconds to wait after so many failures in a row: doubled each time, capped; 0 without a failure."""
    return 0 if failures <= 0 else min(most, base * 2 ** (min(failures, 30) - 1))


def source_health(events: DataFrame, key: str = "user_id") -> DataFrame:
    """(key, failures, cooldown) after each batch: failures in a row by event time, reset by any success.

    Only the counter is kept as state; events of a batch are folded in order of time and id. A source
    that is silent keeps its last row."""
    ship(events.sparkSession)

    def fold(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures = state.get[0] if state.exists else 0
        batch = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        for kind in batch["event_type"]:
            failures = failures + 1 if kind == "error" else 0
        state.update((int(failures),))
        yield pd.DataFrame({key: [group[0]], "failures": [int(failures)], "cooldown": [cooldown(int(failures))]})

    return events.groupBy(key).applyInPandasWithState(fold, f"{key} long, failures long, cooldown long", "failures long", "update", GroupStateTimeout.NoTimeout)
