"""Ranks, bins, caps, samples and top-k with explicit ties."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_pick(key: Column, modulus: int, take: int = 0) -> Column:
    """True for keys whose sha-256, by its first 15 hex digits, leaves `take`: the same in every engine."""
    return F.pmod(F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 15), 16, 10).cast("long"), F.lit(modulus)) == take


def in_ranges(df: DataFrame, by: str, name: str, parts: int = 64) -> DataFrame:
    """df with the index of the range of about equal numbers of rows that a numeric column lies in; nulls and NaN have range -1."""
    plain = F.col(by).isNotNull() & ~F.isnan(F.col(by).cast("double"))
    edges = df.where(plain).agg(F.percentile_approx(by, [i / parts for i in range(1, parts)], 1000)).first()[0] or []
    below = F.size(F.filter(F.array(*[F.lit(e) for e in sorted(set(edges))]), lambda e: e <= F.col(by))) if edges else F.lit(0)
    return df.withColumn(name, F.when(plain, below).otherwise(-1))


def running_totals(df: DataFrame, by: str, sums: dict[str, Column], tie: list[str] | None = None, descending: bool = False, parts: int = 64) -> DataFrame:
    """Sums over all rows up to and with this one in the order of a numeric column, then of tie; nulls come first, or last if descending.

    Ranges are totalled apart and each starts from the sum of those before it, of which there are at most parts + 1, so that no
    task orders all rows.
    """
    way = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    ranged = in_ranges(df, by, "_r", parts)
    w = Window.partitionBy("_r").orderBy(way(by), *(tie or [])).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy(way("_r")).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_r").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    totals = totals.select("_r", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_t_{n}") for n in sums])
    out = ranged.withColumns({n: F.coalesce(F.sum(c).over(w), F.lit(0)) for n, c in sums.items()}).join(F.broadcast(totals), "_r")
    return out.withColumns({n: F.col(n) + F.col(f"_t_{n}") for n in sums}).drop("_r", *[f"_t_{n}" for n in sums])


def average_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """Rank from 1 of a numeric column, ties sharing their mean rank: running totals of the counts per value."""
    counts = df.groupBy(column).agg(F.count("*").alias("_c"))
    ranks = running_totals(counts, column, {"_u": F.col("_c")}).select(column, (F.col("_u") - (F.col("_c") - 1) / 2).alias(name))
    return df.join(ranks, column)


def percent_rank_average(df: DataFrame, column: str, name: str) -> DataFrame:
    n = df.agg(F.count(column).alias("_n"))
    return average_rank(df, column, "_r").crossJoin(F.broadcast(n)).withColumn(name, F.col("_r") / F.col("_n")).drop("_r", "_n")


def quantile_edges(df: DataFrame, column: str, q: int) -> list[float]:
    found = df.agg(F.percentile(column, [i / q for i in range(q + 1)])).first()[0] or []
    return sorted(set(found))


def bin_by(column: Column, edges: list[float]) -> Column:
    """Index of the right-closed bin, the first one closed on both sides; null outside."""
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        low = column >= edges[i] if i == 0 else column > edges[i]
        out = F.when(low & (column <= edges[i + 1]), F.lit(i)).otherwise(out)
    return out


def winsorize(df: DataFrame, column: str, low: float, high: float, name: str) -> DataFrame:
    caps = df.agg(F.percentile(column, low).alias("_lo"), F.percentile(column, high).alias("_hi"))
    return df.crossJoin(F.broadcast(caps)).withColumn(name, F.least(F.greatest(column, "_lo"), "_hi")).drop("_lo", "_hi")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the correlation of average ranks."""
    ranked = average_rank(average_rank(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, "_ra"), b, "_rb")
    return ranked.agg(F.corr("_ra", "_rb").alias("spearman"))


def first_component_share(df: DataFrame, columns: list[str]) -> float:
    """Share of the variance of the columns' average ranks that their first principal component has.

    Each column is ranked and standardised over its own values and a null stands at the mean; columns of one value are left
    out, and with fewer than two others the share is 1.
    """
    rows = df.select(*columns)
    for c in columns:
        ranks = average_rank(rows.where(F.col(c).isNotNull()).select(c), c, f"_r{c}").distinct()
        rows = rows.join(ranks, c, "left")
    n = len(columns)
    found = rows.agg(*[F.avg(f"_r{c}") for c in columns], *[F.stddev_pop(f"_r{c}") for c in columns]).first()
    mean, spread = dict(zip(columns, found[:n], strict=True)), dict(zip(columns, found[n:], strict=True))
    kept = [c for c in columns if spread[c]]
    if len(kept) < 2:
        return 1.0
    z = {c: F.coalesce((F.col(f"_r{c}") - mean[c]) / spread[c], F.lit(0.0)) for c in kept}
    pairs = [(i, j) for i in range(len(kept)) for j in range(i)]
    m = np.eye(len(kept))
    for (i, j), r in zip(pairs, rows.agg(*[F.corr(z[kept[i]], z[kept[j]]) for i, j in pairs]).first(), strict=True):
        m[i, j] = m[j, i] = r
    return float(np.linalg.eigvalsh(m)[-1] / len(kept))


def list_jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct members of two lists; null if either is null, 0 if both are empty."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)) + F.when(a.isNull() | b.isNull(), F.lit(None)).otherwise(0.0)


def top_k(df: DataFrame, score: str, tie: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(score), F.asc(tie)).limit(k)


def top_share_per_bucket(df: DataFrame, bucket: str, score: str, tie: str, rate: float) -> DataFrame:
    """The best max(1, half-even round of rate * n) rows of each bucket."""
    sizes = df.groupBy(bucket).agg(F.greatest(F.lit(1), F.bround(F.count("*") * rate)).alias("_n"))
    order = Window.partitionBy(bucket).orderBy(F.desc(score), F.asc(tie))
    # within a bucket, ranges of the score are counted first: only the range that holds the last place is ranked row by row
    ranged = in_ranges(df, score, "_p")
    held = ranged.groupBy(bucket, "_p").agg(F.count("*").alias("_c"))
    above = F.coalesce(F.sum("_c").over(Window.partitionBy(bucket).orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.withColumn("_a", above).join(sizes, bucket).where("_a < _n").select(bucket, "_p", "_n", "_a", (F.col("_a") + F.col("_c") <= F.col("_n")).alias("_w"))
    near = ranged.join(held, [bucket, "_p"])
    edge = near.where("not _w").withColumn("_r", F.row_number().over(order)).where("_r + _a <= _n")
    return near.where("_w").select(*df.columns).unionByName(edge.select(*df.columns))


def spearman_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, spearman) of every two columns, over the rows in which none is null: all correlations in one aggregate of the ranks."""
    rows = df.select(*columns).dropna()
    for c in columns:
        rows = average_rank(rows, c, f"_r{c}")
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = rows.agg(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(f"_r{a}", f"_r{b}").alias("spearman")).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[F.col(f"_{i}") for i in range(len(pairs))])))


def describe(df: DataFrame, column: str) -> DataFrame:
    """(measure, value) of a numeric column: count, mean, sample deviation, ends and quartiles."""
    q = F.percentile(column, [0.25, 0.5, 0.75])
    one = df.agg(F.count(column).cast("double").alias("count"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).cast("double").alias("min"), q[0].alias("25%"), q[1].alias("50%"), q[2].alias("75%"), F.max(column).cast("double").alias("max"))
    return one.unpivot([], one.columns, "measure", "value")
