"""Approximate nearest neighbours by cross-polytope hashing.

A table turns a unit vector by a fast pseudo-rotation (three rounds of random signs and a Hadamard transform) and hashes it
to the nearest signed axis. A query probes the cells of its largest axes in every table, the same ones at every input size. Vectors and probes meet by cell; each cell, in blocks of at most CELL_ROWS
vectors, gives every probe its own nearest by exact cosine in double precision, so that what is shuffled grows with
probes and not with pairs. The nearest of all cells are merged a query.

Nulls and edge cases: vectors that are null, empty, zero, of another length than most or hold null or non-finite components take no part;
identical vectors all count; ties go to the smaller id; with fewer candidates than k all are returned; rows that repeat an
id count once (the first by vector); a query never finds its own id. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from asofkit.llm.common import lean

#: Tables, cells probed in each, and vectors that a block of a cell may hold.
TABLES, PROBES, CELL_ROWS = 10, 12, 20_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of every row; the width is a power of two."""
    n, w, h = x.shape[0], x.shape[1], 1
    while h < w:
        x = x.reshape(n, w // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(n, w)
        h *= 2
    return x


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """Three rounds of random signs and a Hadamard transform, on vectors padded to a power of two."""
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    signs = np.random.Generator(np.random.PCG64(seed)).choice([-1.0, 1.0], (3, width))
    for s in signs:
        x = hadamard(x * s) / np.sqrt(width)
    return x


def cells(x: np.ndarray, seed: int, probes: int) -> np.ndarray:
    """The signed axes nearest to each turned vector, nearest first: axis a as a, its opposite as a + width."""
    y = rotate(x, seed)
    both = np.concatenate([y, -y], 1)
    if probes == 1:
        return np.argmax(both, 1)[:, None]
    probes = min(probes, both.shape[1])
    top = np.argpartition(-both, probes - 1, 1)[:, :probes]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(both, top, 1), 1, kind="stable"), 1)


def search(vectors: DataFrame, queries, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """query_id, rank, id and score of the k nearest found; queries: a condition on the rows that ask."""
    v = F.col(vec_col).cast("array<double>")
    good = F.col(vec_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & good).select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.groupBy("id").agg(F.min(F.struct("v", "asks")).alias("s")).select("id", "s.v", "s.asks")
    widths = {r["w"]: r["count"] for r in rows.groupBy(F.size("v").alias("w")).count().collect()}
    if not widths:
        return vectors.sparkSession.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    width = min(widths, key=lambda w: (-widths[w], w))
    rows = rows.where(F.size("v") == width)

    def place(batches):
        for b in batches:
            ids, asks = b.column(0).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)
            flat = b.column(1)
            x = flat.flatten().to_numpy().reshape(len(ids), width)
            scale = np.abs(x).max(1, keepdims=True)
            x = x / scale
            x /= np.sqrt((x * x).sum(1, keepdims=True))
            blobs = pa.array([r.tobytes() for r in x], pa.binary())
            for t in range(tables):
                for want, who in ((False, np.arange(len(ids))), (True, np.flatnonzero(asks))):
                    if not len(who):
                        continue
                    found = cells(x[who], 2 * t, probes if want else 1)
                    at = np.repeat(who, found.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(found.ravel().astype(np.int64)), pa.array(ids[at]), blobs.take(pa.array(at)), pa.array(np.full(len(at), want))], ["t", "cell", "id", "v", "probe"])

    placed = rows.mapInArrow(lean(place), "t int, cell long, id long, v binary, probe boolean")
    # a cell with many vectors is dealt over blocks; its probes go to each of them
    sizes = placed.where("not probe").groupBy("t", "cell").count().withColumn("blocks", F.ceil(F.col("count") / CELL_ROWS).cast("int")).where("blocks > 1").select("t", "cell", "blocks")
    dealt = placed.join(sizes, ["t", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.array(F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("block", F.explode(F.when(F.col("probe"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(own)))

    def nearest(key, group: pd.DataFrame) -> pd.DataFrame:
        mine, asks = group[~group.probe], group[group.probe]
        out = []
        if len(mine) and len(asks):
            x = np.frombuffer(b"".join(mine.v), np.float64).reshape(len(mine), -1)
            ids = mine.id.to_numpy()
            for at in range(0, len(asks), 256):
                part = asks.iloc[at : at + 256]
                q = np.frombuffer(b"".join(part.v), np.float64).reshape(len(part), -1)
                s = q @ x.T
                qid = part.id.to_numpy()
                s[qid[:, None] == ids[None, :]] = -np.inf
                keep = min(k, len(ids))
                # all that tie with the k-th within rounding stay, for exact scores decide
                edge = np.partition(s, len(ids) - keep, 1)[:, len(ids) - keep][:, None] - 1e-12
                r, c = np.nonzero((s >= edge) & np.isfinite(s))
                order = np.lexsort((ids[c], -np.round(s[r, c], 12), r))
                r, c = r[order], c[order]
                nth = np.arange(len(r)) - np.searchsorted(r, r)
                r, c = r[nth < 4 * k], c[nth < 4 * k]
                out.append(pd.DataFrame({"query_id": qid[r], "id": ids[c]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64)})

    found = dealt.select("t", "cell", "block", "id", "v", "probe").groupBy("t", "cell", "block").applyInPandas(nearest, "query_id long, id long").distinct()
    # exact scores on the vectors as given, summed in order in double precision
    a = rows.select(F.col("id").alias("query_id"), F.col("v").alias("qv"))
    both = found.join(a, "query_id").join(rows.select("id", "v"), "id")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    score = dot("qv", "v") / (F.sqrt(dot("qv", "qv")) * F.sqrt(dot("v", "v")))
    scored = both.select("query_id", "id", score.alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
