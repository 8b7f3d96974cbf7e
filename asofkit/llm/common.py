"""Shared pieces of the corpus operators: reading tables, materialising, hashing words, connected components.

Word hashing works on the UTF-8 bytes of an Arrow column with numpy, so no Python object is made for a word.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids a broadcast may hold (8 bytes each); beyond it a shuffle join is used instead.
BROADCAST_IDS = 2_000_000
#: Bytes of text hashed at once; just under a power of two, which the tables of powers double up to.
CHUNK = (1 << 20) - 16
WORD = r"[^\x20\x09-\x0D]+"


def release() -> None:
    """Give freed memory back to the system: Python workers wait for later tasks, and what they hold counts as used."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(f):
    """A function from batches to batches that gives its memory back at the end of a task."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            release()

    return run


class Numbers(dict):
    """Numbers words as they are met."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Fewer rows in an Arrow batch than Spark's 10,000: texts are long, and every batch is held on both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a temporary one in local mode; on a cluster it raises."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="asofkit-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write df to the shared folder, or another that all executors share, and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark) + '/asofkit'}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialized(df: DataFrame) -> None:
    """Delete the files behind a frame that materialize() returned."""
    spark = df.sparkSession
    for f in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def keep_ids(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Semi- or anti-join by ids, with a broadcast only while their number is within BROADCAST_IDS."""
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if small else ids, key, how)


def most_counted(counts: DataFrame, column: str, limit: int) -> DataFrame:
    """The rows of largest count, at most limit of them: those above a threshold read off a histogram of 64 steps an octave.

    The histogram has a few thousand rows whatever the input, so nothing is sorted or gathered to find the threshold.
    """
    step = F.floor(F.log2(F.col(column)) * 64)
    sizes = sorted(((r["s"], r["count"]) for r in counts.where(F.col(column) > 0).groupBy(step.alias("s")).count().collect()), reverse=True)
    held, least = 0, None
    for s, n in sizes:
        if held + n > limit:
            break
        held, least = held + n, s
    return counts.where(F.lit(False) if least is None else (F.col(column) > 0) & (step >= least))


# ---------------------------------------------------------------- hashing

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_LANE = _rng.integers(1, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_STEP = 0x9E3779B97F4A7C17 | 3
_STEP_INVERSE = pow(_STEP, -1, 2**64)
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    """Powers 0..n-1 of the step and of its inverse, modulo 2**64."""
    for i, base in enumerate((_STEP, _STEP_INVERSE)):
        while len(_powers[i]) < n:
            have = _powers[i]
            _powers[i] = np.concatenate([have, have * np.uint64(pow(base, len(have), 2**64))])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the murmur finaliser)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def text_chunks(column: pa.Array, limit: int = CHUNK):
    """Yield (first row, bytes, offsets) over runs of whole texts of about limit bytes; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, n)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, index of each text's first word and the end); words are WORD matches."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SEP[data]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = np.zeros(n + 1, bool)
    last[offsets[1:]] = True
    ends = np.flatnonzero(inside & (~after | last[1:])) + 1
    power, inverse = _power(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[_LOWER[data] if lower else data] * power[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _LANE[63])
    return hashes, np.searchsorted(starts, offsets)


def string_hashes(column: pa.Array) -> np.ndarray:
    """Hash of every string of an Arrow column, taken whole."""
    out = [np.zeros(0, np.uint64)]
    for _, data, offsets in text_chunks(column):
        power, inverse = _power(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[: len(data)], out=total[1:])
        a, b = offsets[:-1], offsets[1:]
        out.append(mix((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64) * _LANE[63]))
    return np.concatenate(out)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words (k under 64); runs over text ends are the caller's to drop."""
    m = len(words) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = words[:m] * _LANE[0]
    for j in range(1, k):
        out = out + words[j : j + m] * _LANE[j]
    return mix(out + np.uint64(k))


def whole_hash(words: np.ndarray) -> int:
    """Hash of a short sequence taken whole."""
    return int(gram_hashes(words, len(words))[0])


# ---------------------------------------------------------------- bitmaps of hashes


def bitmap_of(hashes: DataFrame, bits: int) -> bytes:
    """A bitmap of 2**bits bits in which the top bits of every hash (column h) are set: of fixed size, built by parts."""

    def part(batches):
        seen = np.zeros(1 << bits, bool)
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            seen[h >> np.uint64(64 - bits)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(seen).tobytes()], pa.binary())], ["m"])

    def merge(batches):
        got = np.zeros((1 << bits) // 8, np.uint8)
        for b in batches:
            for m in b.column(0).to_pylist():
                got |= np.frombuffer(m, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([got.tobytes()], pa.binary())], ["m"])

    parts = hashes.select("h").coalesce(12).mapInArrow(lean(part), "m binary")
    out = parts.coalesce(1).mapInArrow(lean(merge), "m binary").collect()
    return bytes(out[0].m) if out else bytes((1 << bits) // 8)


def bitmap_bits(n: int, least: int = 16, most: int = 28) -> int:
    """Bits for about 8 places a hash, so that one other hash in eight is let through; at most 32 MB."""
    return int(min(most, max(least, np.ceil(np.log2(max(n, 1) * 8)))))


def in_bitmap(bitmap: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    at = (h >> np.uint64(64 - bits)).astype(np.int64)
    return (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


# ---------------------------------------------------------------- components


def components(edges: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """Smallest node of each node's component, as (node, root) for nodes that edges (a, b) touch.

    Alternating large-star and small-star steps; each step is an aggregate with map-side combine and a join that
    adaptive execution can split, and is written to the shared folder. A round's table goes when the next one is written;
    raises if the steps have not settled after so many rounds (they take about as many as the logarithm of the diameter).
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    was = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(low.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        nxt = materialize(small.where("u <> v").distinct(), name)
        drop_materialized(now)
        now_sum = tuple(nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        now = nxt
        if now_sum == was:
            break
        was = now_sum
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
