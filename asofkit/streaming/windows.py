"""Event-time windows and keyed state on streams; the same functions take batch frames where no state is kept."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, time: str, width: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Counts a window and key; `late` is how long a stream waits for late events."""
    rows = events.withWatermark(time, late) if late and events.isStreaming else events
    return rows.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sliding(events: DataFrame, time: str, width: str, step: str, keys: list[str], late: str | None = None) -> DataFrame:
    rows = events.withWatermark(time, late) if late and events.isStreaming else events
    return rows.groupBy(F.window(time, width, step).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def running_state(events: DataFrame, key: str, time: str) -> DataFrame:
    """(key, t, prior): for each group of events of one key and second, how many came strictly before it, kept across batches."""
    kind = events.schema[key].dataType.simpleString()

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches))
        out = []
        for t, n in rows.groupby(time).size().sort_index().items():
            out.append((k[0], t, seen))
            seen += int(n)
        state.update((seen,))
        yield pd.DataFrame(out, columns=[key, "t", "prior"])

    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, t bigint, prior bigint", "seen bigint", "append", GroupStateTimeout.NoTimeout)
