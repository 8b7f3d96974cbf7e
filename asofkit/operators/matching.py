"""First and nearest matches as aggregates, so no join result is sorted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_match(left: DataFrame, events: DataFrame, on: list[str], condition: Column, order: list[Column], values: list[str], prefix: str, how: str = "left") -> DataFrame:
    """Each left row (unique) with the least event by order among those of its key that meet the condition: one join, one aggregate."""
    first = F.min(F.when(condition, F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], *values))).alias("_b")
    best = left.withColumn("_id", F.struct(*left.columns)).join(events, on, how).groupBy("_id").agg(first)
    best = best.where("_b is not null") if how == "inner" else best
    return best.select("_id.*", *[F.col(f"_b.{v}").alias(prefix + v) for v in values])


def nearest_match(left: DataFrame, right: DataFrame, on: list[str], key: list[str], distances: list[Column]) -> DataFrame:
    """Left join that keeps, for each key, the right row of least distances, null last."""
    both = left.join(right, on, "left")
    least = F.struct(*[c for i, d in enumerate(distances) for c in (d.isNull().alias(f"n{i}"), d.alias(f"d{i}"))])
    return both.groupBy(*key).agg(F.min_by(F.struct(*both.columns), least).alias("_b")).select("_b.*")


def count_below(left: DataFrame, key: str, value: str, right: DataFrame, other: str, name: str, parts: int = 64) -> DataFrame:
    """How many right rows lie strictly below each left key's value, summed over the rows of a key; 0 for a null value.

    Both sides shrink to counts a distinct value, which are dealt over ranges of about equal numbers of values; each range
    starts from the rows of those before it. So no pair is made, and nothing is sorted in one task.
    """
    counts = right.where(F.col(other).isNotNull()).groupBy(F.col(other).alias("_v")).agg(F.count("*").alias("_n"))
    asked = left.where(F.col(value).isNotNull()).select(F.col(value).alias("_v"), F.lit(0).cast("long").alias("_n"))
    values = counts.union(asked.distinct()).groupBy("_v").agg(F.sum("_n").alias("_n"))
    edges = values.agg(F.percentile_approx("_v", [i / parts for i in range(1, parts)])).first()[0] or []
    # the range is the number of edges below or at the value
    ranged = values.withColumn("_r", F.size(F.filter(F.array(*[F.lit(e) for e in sorted(set(edges))]), lambda e: e <= F.col("_v"))) if edges else F.lit(0))
    first = ranged.groupBy("_r").agg(F.sum("_n").alias("_t")).withColumn("_b", F.coalesce(F.sum("_t").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_t")
    before = Window.partitionBy("_r").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    below = ranged.withColumn("_w", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(F.broadcast(first), "_r").select("_v", (F.col("_b") + F.col("_w")).alias("_c"))
    return left.join(below, left[value] == F.col("_v"), "left").groupBy(key).agg(F.coalesce(F.sum("_c"), F.lit(0)).alias(name))
