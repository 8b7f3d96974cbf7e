"""Identity marks of messages: several fingerprints a message, their history strictly before it, a column for each kind and measure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MEASURES = ("prior", "recent", "successes", "rate", "age", "senders")


def marks(messages: DataFrame, keep: list[str], kinds: dict[str, Column], time: str, cutoff: int | None = None) -> DataFrame:
    """(keep..., kind, value): a row for each message and mark that is not null, of messages before the cutoff."""
    rows = messages if cutoff is None else messages.where(F.col(time) < cutoff)
    each = F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("string").alias("value")) for k, v in kinds.items()])
    return rows.select(*keep, F.explode(F.filter(each, lambda m: m["value"].isNotNull())).alias("_m")).select(*keep, "_m.kind", "_m.value")


def history(marked: DataFrame, time: str, sender: str, success: str, window: int, strength: float) -> DataFrame:
    """(kind, value, time, MEASURES) of what was seen of a mark strictly before a moment: how often, how often within the window,
    successes, their shrunk rate, time since the last, and different senders. Marks of one second are one group."""
    first = marked.groupBy("kind", "value", sender).agg(F.min(time).alias(time)).groupBy("kind", "value", time).agg(F.count("*").alias("_new"))
    by = marked.groupBy("kind", "value", time).agg(F.count("*").alias("_n"), F.sum(success).alias("_y")).join(first, ["kind", "value", time], "left")
    part = Window.partitionBy("kind", "value").orderBy(time)
    before = part.rowsBetween(Window.unboundedPreceding, -1)
    z = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    got = by.withColumns({"prior": z("_n", before), "recent": z("_n", part.rangeBetween(-window, -1)), "successes": z("_y", before), "senders": z("_new", before), "age": F.col(time) - F.lag(time).over(part)})
    return got.withColumn("rate", F.col("successes") / (F.col("prior") + strength)).select("kind", "value", time, *MEASURES)


def features(marked: DataFrame, past: DataFrame, key: str, time: str, kinds: list[str]) -> DataFrame:
    """One row a message: <kind>_<measure> for every kind, null where a message has no mark of that kind."""
    rows = marked.join(past, ["kind", "value", time])
    return rows.groupBy(key).agg(*[F.max(F.when(F.col("kind") == k, F.col(m))).alias(f"{k}_{m}") for k in kinds for m in MEASURES])
