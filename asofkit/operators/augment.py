"""Joins that add columns under a contract: keyed augmentation, dictionary lookups, sources chosen by flags, state onto state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.operators.asof import asof_join
from asofkit.operators.ledger import require_unique


def augment(df: DataFrame, extra: DataFrame, key: list[str], what: str) -> DataFrame:
    """df with the columns of extra, row for row: extra's key must be unique (else the job fails), and no row is lost or added."""
    return df.join(require_unique(extra, key, what), key, "left")


def look_up(df: DataFrame, entries: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """df with the entry of its key; of several the last by order holds."""
    return df.join(entries.groupBy(key).agg(F.max_by(value, order).alias(value)), key, "left")


def from_sources(df: DataFrame, key: list[str], sources: dict[str, DataFrame], use: dict[str, bool]) -> DataFrame:
    """df with the columns of every source whose flag is set; unknown flags are an error."""
    if unknown := set(use) - set(sources):
        raise ValueError(f"no such source: {sorted(unknown)}")
    for name, source in sources.items():
        if use.get(name):
            df = augment(df, source, key, name)
    return df


def state_onto_state(states: DataFrame, others: DataFrame, on: list[str], time: str, values: list[str], prefix: str) -> DataFrame:
    """Each state with the latest other state of its key strictly before it, and how long before: a state for later as-of joins."""
    got = asof_join(states, others.withColumnRenamed(time, "_t2"), on, time, "_t2", values, prefix=prefix)
    return got.withColumn(f"{prefix}age", F.col(time) - F.col(f"{prefix}_t2")).drop(f"{prefix}_t2")
