"""Metrics of a score and of a selection, samples and splits, gates and fingerprints of scores."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofkit.operators import evaluation as E
from asofkit.operators.ranking import running_totals


def metric_bundle(df: DataFrame, label: str, score: str, threshold: float) -> DataFrame:
    """One row: counts, prevalence, average precision, ROC area, precision, recall and F1 at the threshold, and their lifts."""
    ap, auc = E.average_precision(df, label, score), E.roc_auc(df, label, score)
    return _shares(df, label, F.col(score) >= threshold).crossJoin(F.broadcast(ap)).crossJoin(F.broadcast(auc)).withColumn("average_precision_lift", _lift(F.col("average_precision")))


def _lift(x: Column) -> Column:
    return F.when(F.col("prevalence") > 0, x / F.col("prevalence")).otherwise(0.0)


def _shares(df: DataFrame, label: str, taken: Column, keys: list[str] | None = None) -> DataFrame:
    one, y = F.lit(1), F.col(label)
    rows = df.groupBy(*(keys or [])).agg(F.count("*").alias("rows"), F.sum(y).cast("long").alias("positives"), F.count_if(taken).alias("selected"), F.count_if(taken & (y == 1)).alias("true_positives"))
    hits = F.col("true_positives")
    rows = rows.withColumns({"prevalence": F.col("positives") / F.greatest("rows", one), "selected_rate": F.col("selected") / F.greatest("rows", one), "precision": hits / F.greatest("selected", one), "recall": hits / F.greatest("positives", one)})
    return rows.withColumns({"f1": 2 * hits / F.greatest(F.col("selected") + F.col("positives"), one), "precision_lift": _lift(F.col("precision"))})


def selection_metrics(df: DataFrame, label: str, taken: Column, keys: list[str] | None = None) -> DataFrame:
    """The same shares of any selection, in all or a group."""
    return _shares(df, label, taken, keys)


def at_positives(df: DataFrame, label: str, score: str, tie: str) -> DataFrame:
    """Precision, recall and lift of the k best, k being the number of positives; ties go to the smaller `tie`."""
    ranked = running_totals(df, score, {"_n": F.lit(1)}, [tie], descending=True)
    k = df.agg(F.sum(label).cast("long").alias("k"), F.avg(label).alias("prevalence"))
    got = ranked.crossJoin(F.broadcast(k)).where("_n <= k").groupBy("k", "prevalence").agg(F.sum(label).cast("long").alias("positives_at_k"))
    p = F.col("positives_at_k") / F.col("k")
    return got.select("k", "positives_at_k", p.alias("precision_at_k"), p.alias("recall_at_k"), (p / F.col("prevalence")).alias("lift_at_k"))


def exact_sample(df: DataFrame, key: str, n: int, salt: str) -> DataFrame:
    """Exactly n rows (all, if fewer), the same each time: those whose salted hash of the key is least."""
    return df.orderBy(F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")), 256), key).limit(n)


def keep_positives(df: DataFrame, label: str, picked: Column) -> DataFrame:
    """All positives and the negatives that are picked."""
    return df.where((F.col(label) == 1) | picked)


def split(df: DataFrame, time: str, start: int | None, end: int | None, columns: list[str], groups: Mapping[str, list[str]], use: list[str]) -> DataFrame:
    """Rows of [start, end) with the key columns and those features of the groups in use that are there."""
    rows = df if start is None else df.where(F.col(time) >= start)
    rows = rows if end is None else rows.where(F.col(time) < end)
    return rows.select(*columns, *available(df, groups, use))


def available(df: DataFrame, groups: Mapping[str, list[str]], use: list[str]) -> list[str]:
    """Features of the groups in use that are columns of df, each once, in the groups' order."""
    return [c for c in dict.fromkeys(f for g in use for f in groups[g]) if c in df.columns]


def hardest(df: DataFrame, label: str, score: str, tie: str, factor: int = 5) -> DataFrame:
    """The negatives of largest score, factor times as many as there are positives (all, if fewer)."""
    k = df.agg(F.sum(label).cast("long").alias("k"))
    ranked = running_totals(df.where(F.col(label) == 0), score, {"_n": F.lit(1)}, [tie], descending=True)
    return ranked.crossJoin(F.broadcast(k)).where(F.col("_n") <= factor * F.col("k")).drop("_n", "k")


def feature_gate(full: Mapping[str, float], without: Mapping[str, float], least: float) -> dict[str, str]:
    """KEEP a feature set whose removal costs at least so much, else DROP."""
    return {name: "KEEP" if full["score"] - value >= least else "DROP" for name, value in without.items()}


def quantized(score: Column, digits: int = 11) -> Column:
    """A score as a whole number of 10 ** -digits, rounded half to even."""
    return F.bround(score * 10**digits).cast("long")


def score_fingerprint(df: DataFrame, key: str, score: str, taken: Column) -> DataFrame:
    """One row: rows, members, and sums over rows of hashes of (key, quantised score) and of the members' keys, in no order."""
    digits = lambda c: F.conv(F.substring(F.sha2(c, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    text = F.concat_ws("|", F.col(key).cast("string"), quantized(F.col(score)).cast("string"))
    return df.agg(F.count("*").alias("rows"), F.count_if(taken).alias("members"), F.sum(digits(text)).alias("scores"), F.sum(F.when(taken, digits(F.col(key).cast("string")))).alias("membership"))
