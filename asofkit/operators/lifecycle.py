"""Lifecycles with outcomes that count only once they have matured."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_outcome(starts: DataFrame, outcomes: DataFrame, key: list[str], start: str, at: str) -> DataFrame:
    """starts with the first outcome of their key; where that is not after the start, it is taken as none."""
    first = outcomes.groupBy(*key).agg(F.min(at).alias("_first"), F.count("*").alias("_n"))
    late = F.col("_first") > F.col(start)
    return starts.join(first, key, "left").withColumns({"outcome_time": F.when(late, F.col("_first")), "outcomes": F.when(late, F.col("_n")).otherwise(F.lit(0))}).drop("_first", "_n")


def maturity_updates(lifecycle: DataFrame, entity: str, start: str, outcome: str, horizon: int) -> DataFrame:
    """State changes (entity, t, started, matured, succeeded): a start at once, its verdict at start + horizon."""
    rows = lifecycle.select(entity, start, outcome)
    zero, one = F.lit(0), F.lit(1)
    success = F.coalesce((F.col(outcome) <= F.col(start) + horizon).cast("int"), zero)
    begin = rows.select(entity, F.col(start).alias("t"), one.alias("started"), zero.alias("matured"), zero.alias("succeeded"))
    end = rows.select(entity, (F.col(start) + horizon).alias("t"), zero.alias("started"), one.alias("matured"), success.alias("succeeded"))
    return begin.union(end).groupBy(entity, "t").agg(*[F.sum(c).alias(c) for c in ("started", "matured", "succeeded")])


def outcomes_within(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, seconds: int, name: str) -> DataFrame:
    """Number of right rows of the key in (t, t + seconds], 0 if none; left rows are unique."""
    joined = left.alias("l").join(right.select(*[F.col(c).alias(f"_{c}") for c in on], F.col(right_time).alias("_rt")).alias("r"), [F.col(f"l.{c}") == F.col(f"r._{c}") for c in on] + [F.col("_rt") > F.col(left_time), F.col("_rt") <= F.col(left_time) + seconds], "left")
    return joined.groupBy(*[F.col(f"l.{c}") for c in left.columns]).agg(F.count("_rt").alias(name))


def tied_group_features(members: DataFrame, key: list[str], at: str, now: str, outcome: str, window: int) -> DataFrame:
    """For starts of one key and time, as of `now`: size, shares observed, matured without, pending, and median delay of those observed."""
    seen = (F.col(outcome) < F.col(now)) & (F.col(outcome) <= F.col(at) + window)
    matured = F.col(at) + window < F.col(now)
    delay = F.when(seen, F.col(outcome) - F.col(at))
    mean = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    seen_ = F.coalesce(seen, F.lit(False))
    return members.groupBy(*key, at, now).agg(F.count("*").alias("group_size"), mean(seen_).alias("observed"), mean(matured & ~seen_).alias("matured_without"), mean(~matured & ~seen_).alias("pending"), F.median(delay).alias("median_delay"))
