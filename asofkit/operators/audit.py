"""Checks that raise, and summaries that compare tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row: how many rows break each rule (null counts as kept), and how many rows there are."""
    return df.agg(F.count("*").alias("rows"), *[F.count_if(~F.coalesce(c, F.lit(True))).alias(n) for n, c in checks.items()])


def require(df: DataFrame, checks: dict[str, Column]) -> None:
    broken = {n: v for n, v in counts(df, checks).first().asDict().items() if n != "rows" and v}
    if broken:
        raise ValueError(f"rows that break a rule: {broken}")


def checksum(df: DataFrame, columns: list[str]) -> DataFrame:
    """A sum over rows of 15 hex digits of sha-256: the same in any order and engine."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
    digits = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.sum(digits).alias("checksum"))


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """One row: rows, distinct keys (a null part counts as a value) and the difference."""
    return df.agg(F.count("*").alias("rows"), F.countDistinct(F.struct(*key)).alias("keys")).withColumn("surplus", F.col("rows") - F.col("keys"))


def require_columns(df: DataFrame, columns: set[str]) -> DataFrame:
    missing = columns - set(df.columns)
    if missing:
        raise ValueError(f"columns that are missing: {sorted(missing)}")
    return df


def set_difference(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Keys of one side only, with the side."""
    left, right = a.select(*key).distinct(), b.select(*key).distinct()
    return left.subtract(right).withColumn("side", F.lit("left")).union(right.subtract(left).withColumn("side", F.lit("right")))


def reconcile(parts: DataFrame, whole: DataFrame, key: list[str], part: str, total: str, tolerance: float) -> DataFrame:
    """One row: keys of one side only, and keys whose parts do not add up to the total within tolerance. Keys of whole are unique."""
    sums = parts.groupBy(*key).agg(F.sum(part).alias("_s"), F.lit(True).alias("_l"))
    both = sums.join(whole.select(*key, F.col(total).alias("_t"), F.lit(True).alias("_r")), key, "full")
    off = F.abs(F.coalesce("_s", F.lit(0)) - F.coalesce("_t", F.lit(0))) > tolerance
    return both.agg(F.count_if(F.col("_r").isNull()).alias("parts_only"), F.count_if(F.col("_l").isNull()).alias("whole_only"), F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull() & off).alias("unequal"))
