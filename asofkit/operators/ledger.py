"""Ledgers: charges once a transaction, positions, equity and drawdown, exact money."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofkit.operators.ranking import in_ranges


def exact_sum(text: Column, precision: int = 18, scale: int = 9) -> Column:
    """Sum of decimal strings, the same in any order; what does not parse is skipped."""
    return F.sum(text.try_cast(f"decimal({precision},{scale})"))


def require_unique(df: DataFrame, key: list[str], what: str) -> DataFrame:
    """df, failing while it runs if a key comes twice."""
    w = Window.partitionBy(*key)
    return df.withColumn("_n", F.count("*").over(w)).where(F.when(F.col("_n") > 1, F.raise_error(F.lit(f"duplicate {what}")).cast("boolean")).otherwise(True)).drop("_n")


def charge_once(events: DataFrame, transaction: str, charge: str, name: str) -> DataFrame:
    """The charge of a transaction, stated on any of its rows: the largest, once."""
    return events.groupBy(transaction).agg(F.max(charge).alias(name))


def route_fee(reported: Column, amount: Column, rate: float) -> tuple[Column, Column, Column]:
    """(reported part, rest, total) of a fee that is rate * amount, the reported part bounded by it."""
    total = amount * rate
    part = F.least(F.coalesce(reported, F.lit(0.0)), total)
    return part, total - part, total


def drawdown(outcomes: DataFrame, order: list[str], pnl: str) -> DataFrame:
    """Equity, its peak (at least 0) and the fall from it, in order; the first column of the order is a number.

    Ranges of that column are totalled apart; each starts from the equity and the peak of those before it.
    """
    ranged = in_ranges(outcomes, order[0], "_r")
    w = Window.partitionBy("_r").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.withColumn("_e", F.sum(pnl).over(w)).withColumn("_m", F.max("_e").over(w))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    ends = local.groupBy("_r").agg(F.sum(pnl).alias("_s"), F.max("_m").alias("_top")).withColumn("_base", F.coalesce(F.sum("_s").over(before), F.lit(0.0)))
    ends = ends.withColumn("_was", F.greatest(F.lit(0.0), F.max(F.col("_base") + F.col("_top")).over(before))).select("_r", "_base", "_was")
    out = local.join(F.broadcast(ends), "_r").withColumn("equity", F.col("_base") + F.col("_e")).withColumn("peak", F.greatest("_was", F.col("_base") + F.col("_m")))
    return out.withColumn("drawdown", F.col("peak") - F.col("equity")).drop("_r", "_e", "_m", "_base", "_was")


def outcome_pnl(gross_roi: Column, forced: Column, stake: float, cost: float, slippage: float = 0.0) -> Column:
    """Profit of one entry: (1 + roi) * (1 - s) / (1 + s) - 1 on the stake less cost; a forced loss loses stake and cost."""
    roi = (1 + gross_roi) * ((1 - slippage) / (1 + slippage)) - 1
    return F.when(forced == 1, F.lit(-stake - cost)).otherwise(roi * stake - cost)
