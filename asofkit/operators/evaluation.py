"""Ranking metrics by tie groups: one row a distinct score carries the cumulative counts all of them need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.operators.ranking import bin_by, quantile_edges, running_totals


def curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """(score, n, pos, tp, fp, total, positives) with tp, fp over scores >= this one; rows are distinct scores."""
    groups = df.groupBy(F.col(score).alias("score")).agg(F.count("*").alias("n"), F.sum(label).cast("long").alias("pos"))
    totals = groups.agg(F.sum("n").alias("total"), F.sum("pos").alias("positives"))
    return running_totals(groups, "score", {"tp": F.col("pos"), "fp": F.col("n") - F.col("pos")}, descending=True).crossJoin(F.broadcast(totals))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    c = curve(df, label, score)
    return c.agg(F.sum(F.col("pos") / F.greatest(F.col("positives"), F.lit(1)) * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("average_precision"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Share of (positive, negative) pairs in order, ties counting half."""
    c = curve(df, label, score)
    above = F.col("fp") - (F.col("n") - F.col("pos")) / 2
    negatives = F.col("total") - F.col("positives")
    return c.agg((1 - F.sum(F.col("pos") * above) / F.greatest(F.max(F.col("positives") * negatives), F.lit(1))).alias("roc_auc"))


def thresholds(df: DataFrame, label: str, score: str) -> DataFrame:
    """precision, recall and f1 at every distinct score."""
    c = curve(df, label, score)
    p, r = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / F.greatest(F.col("positives"), F.lit(1))
    return c.withColumns({"precision": p, "recall": r}).withColumn("f1", F.when(F.col("tp") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def best_threshold(df: DataFrame, label: str, score: str, floors: list[float]) -> DataFrame:
    """The threshold of largest f1, and for each floor that of largest recall at precision >= floor; ties to the larger score.

    A floor that no threshold reaches has no row.
    """
    t = thresholds(df, label, score)
    pick = lambda name, key, where: t.where(where).agg(F.max(F.struct(*key, "score", "precision", "recall")).alias("b")).where("b is not null").select(F.lit(name).alias("rule"), F.col("b.score").alias("threshold"), F.col("b.precision").alias("precision"), F.col("b.recall").alias("recall"))
    out = pick("max_f1", [F.col("f1").alias("k")], F.lit(True))
    for f in floors:
        out = out.union(pick(f"recall_at_{f}", [F.col("recall").alias("k")], F.col("precision") >= f))
    return out


def calibration(df: DataFrame, label: str, score: str, bins: int) -> DataFrame:
    """Mean score and label rate of right-closed quantile bins, equal edges merged."""
    edges = quantile_edges(df, score, bins)
    return df.withColumn("bin", bin_by(F.col(score), edges)).groupBy("bin").agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(label).alias("rate"))


def precision_at_k(df: DataFrame, label: str, score: str, tie: str, k: int) -> DataFrame:
    top = df.orderBy(F.desc(score), F.asc(tie)).limit(k)
    return top.agg(F.avg(label).alias("precision"), F.sum(label).cast("long").alias("hits"))
