"""History of an entity strictly before a moment: events of one time are one group, so peers never see each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def per_time(events: DataFrame, keys: list[str], time: str, aggregates: dict[str, Column]) -> DataFrame:
    """One row a key and time."""
    return events.groupBy(*keys, time).agg(*[c.alias(n) for n, c in aggregates.items()])


def strict_prior(grouped: DataFrame, keys: list[str], time: str, columns: dict[str, str]) -> DataFrame:
    """Cumulative sums before the row's time, 0 if none: columns new -> old. grouped: unique by key and time."""
    w = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    return grouped.withColumns({new: F.coalesce(F.sum(old).over(w), F.lit(0)) for new, old in columns.items()})


def rolling(grouped: DataFrame, keys: list[str], time: str, column: str, horizons: dict[str, int]) -> DataFrame:
    """Sums over [t - n, t), 0 if empty; time in whole seconds."""
    w = Window.partitionBy(*keys).orderBy(time)
    return grouped.withColumns({new: F.coalesce(F.sum(column).over(w.rangeBetween(-n, -1)), F.lit(0)) for new, n in horizons.items()})


def recency(grouped: DataFrame, keys: list[str], time: str, name: str = "recency") -> DataFrame:
    """Seconds since the key's previous time, null for the first."""
    return grouped.withColumn(name, F.col(time) - F.lag(time).over(Window.partitionBy(*keys).orderBy(time)))


def cumulative(grouped: DataFrame, keys: list[str], time: str, columns: dict[str, Column]) -> DataFrame:
    """Aggregates (sum, max, min of a column) over all rows up to and with this one."""
    w = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return grouped.withColumns({n: c.over(w) for n, c in columns.items()})
