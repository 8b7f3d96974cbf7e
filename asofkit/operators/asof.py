"""Strict as-of joins: the latest state before a moment, equality excluded.

Both sides are unioned, dealt by key and sorted by time once; the last state of a range frame that ends before the moment is
taken, so a state of its own time never reaches it. One shuffle, no range join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(probes: DataFrame, states: DataFrame, on: list[str], probe_time: str, state_time: str, values: list[str], lag: int = 0, prefix: str = "") -> DataFrame:
    """Left join of probes with the latest state of their key where state_time < probe_time - lag; keys that are null match nothing.

    A state must be unique by key and time: collapse ties first (history.per_time).
    """
    return asof_horizons(probes, states, on, probe_time, state_time, values, {prefix: lag})


def asof_horizons(probes: DataFrame, states: DataFrame, on: list[str], probe_time: str, state_time: str, values: list[str], horizons: dict[str, int]) -> DataFrame:
    """One pass of as-of joins at several lags: columns <prefix><value> for each prefix -> lag.

    Every horizon is a frame over the same partitions and order, so all of them share one shuffle and one sort. Times are whole
    numbers. Probes with a null key match nothing and are dealt by a hash of the row, so they don't meet in one task.
    """
    carried = F.struct(F.col(state_time).alias("_at"), *values)
    lost = F.expr(" or ".join(f"`{k}` is null" for k in on))
    deal = F.when(lost, F.xxhash64(F.struct(*probes.columns))).otherwise(F.lit(0).cast("long"))
    state = states.where(~lost & F.col(state_time).isNotNull()).select(*on, F.lit(0).cast("long").alias("_deal"), F.col(state_time).cast("long").alias("_t"), carried.alias("_s"))
    probe = probes.select(*on, deal.alias("_deal"), F.col(probe_time).cast("long").alias("_t"), F.struct(*probes.columns).alias("_row"))
    part = Window.partitionBy(*on, "_deal").orderBy("_t")
    seen = probe.unionByName(state, allowMissingColumns=True)
    seen = seen.withColumns({f"_{i}": F.last("_s", ignorenulls=True).over(part.rangeBetween(Window.unboundedPreceding, -lag - 1)) for i, lag in enumerate(horizons.values())}).where("_row is not null")
    label = lambda n, f: f"{n}{state_time if f == '_at' else f}"
    return seen.select("_row.*", *[F.col(f"_{i}.{f}").alias(label(n, f)) for i, n in enumerate(horizons) for f in ["_at", *values]])
