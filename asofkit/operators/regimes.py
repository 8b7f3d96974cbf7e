"""How a score holds up by period, threshold and feature bin. Each reads the scored rows once and carries one row a period and distinct score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from asofkit.operators.ranking import average_rank, bin_by, quantile_edges


def curves(df: DataFrame, by: str, label: str, score: str) -> DataFrame:
    """(by, score, n, pos, tp, taken, positives): a cumulative curve a period, from counts per period and distinct score."""
    groups = df.groupBy(by, F.col(score).alias("score")).agg(F.count("*").alias("n"), F.sum(label).cast("long").alias("pos"))
    part = Window.partitionBy(by)
    w = part.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return groups.withColumns({"tp": F.sum("pos").over(w), "taken": F.sum("n").over(w), "positives": F.sum("pos").over(part)})


def average_precision_by(df: DataFrame, by: str, label: str, score: str) -> DataFrame:
    """Average precision a period; a period without positives has 0."""
    share = F.col("pos") / F.greatest(F.col("positives"), F.lit(1))
    return curves(df, by, label, score).groupBy(by).agg(F.sum("n").alias("n"), F.sum("pos").alias("positives"), F.sum(share * F.col("tp") / F.col("taken")).alias("average_precision"))


def regimes(df: DataFrame, by: str, label: str, score: str, frozen: float) -> DataFrame:
    """A period's figures at a threshold fixed beforehand, beside the threshold of largest f1 found in hindsight (ties to the larger)."""
    c = curves(df, by, label, score).withColumn("f1", F.round(2 * F.col("tp") / F.greatest(F.col("taken") + F.col("positives"), F.lit(1)), 12))
    held = F.col("score") >= frozen
    z = lambda x: F.coalesce(F.sum(F.when(held, x)), F.lit(0))
    out = c.groupBy(by).agg(F.sum("n").alias("n"), F.sum("pos").alias("positives"), z(F.col("n")).alias("selected"), z(F.col("pos")).alias("hits"), F.max(F.struct("f1", "score")).alias("own"))
    hits = F.col("hits")
    return out.select(
        by, "n", "positives", "selected", "hits",
        (hits / F.greatest("selected", F.lit(1))).alias("precision"), (hits / F.greatest("positives", F.lit(1))).alias("recall"), (2 * hits / F.greatest(F.col("selected") + F.col("positives"), F.lit(1))).alias("f1"),
        F.col("own.score").alias("own_threshold"), F.col("own.f1").alias("own_f1"),
    )


def threshold_sensitivity(df: DataFrame, by: str, label: str, score: str, threshold: float, factors: list[float]) -> DataFrame:
    """Selections and hits at multiples of a threshold, all in one aggregate."""
    at = lambda f: F.col(score) >= threshold * f
    aggs = [F.struct(F.lit(f).alias("factor"), F.count_if(at(f)).alias("selected"), F.coalesce(F.sum(F.when(at(f), F.col(label))), F.lit(0)).cast("long").alias("hits")) for f in factors]
    rows = df.groupBy(by).agg(F.sum(label).cast("long").alias("positives"), *[a.alias(f"_{i}") for i, a in enumerate(aggs)])
    rows = rows.select(by, "positives", F.inline(F.array(*[F.col(f"_{i}") for i in range(len(factors))])))
    return rows.withColumns({"precision": F.col("hits") / F.greatest("selected", F.lit(1)), "recall": F.col("hits") / F.greatest("positives", F.lit(1))})


def feature_effects(df: DataFrame, feature: str, label: str, prediction: str, bins: int = 10, strength: float = 0.3) -> DataFrame:
    """Rows, label rate and mean prediction a quantile bin, with the direction in which predictions move along the bins.

    The direction is increasing or decreasing where the rank correlation of bin and mean prediction is beyond strength, else
    mixed (also with a single bin). Rows whose feature is null have no bin.
    """
    edges = quantile_edges(df, feature, bins)
    rows = df.withColumn("bin", bin_by(F.col(feature), edges)).where("bin is not null").groupBy("bin")
    rows = rows.agg(F.count("*").alias("n"), F.avg(label).alias("rate"), F.avg(prediction).alias("mean_prediction"))
    ranked = average_rank(rows, "mean_prediction", "_r").agg(F.corr(F.col("bin").cast("double"), "_r").alias("_c"))
    way = F.when(F.col("_c") > strength, "increasing").when(F.col("_c") < -strength, "decreasing").otherwise("mixed")
    return rows.crossJoin(F.broadcast(ranked)).select(F.lit(feature).alias("feature"), "bin", "n", "rate", "mean_prediction", way.alias("direction"))
