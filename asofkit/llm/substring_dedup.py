"""Incremental removal of repeated word windows with a log-structured index of window fingerprints.

The index holds, for the windows of all documents taken in so far, one fingerprint a stretch: the smallest of the k-gram
hashes that lie in the window. Equal windows have equal fingerprints, and neighbouring windows mostly share theirs, so
it is several times smaller than one hash a window. Every batch adds one immutable run of (fingerprint, smallest and
largest doc_id), hash-partitioned and sorted; it is merge-joined with the runs before it, and a level that has FANOUT
runs is compacted into one run of the next level.

A fingerprint met in more than one document only nominates windows. They are verified by the hash of their words and by
the smallest doc_id that holds each, so a removal never rests on the fingerprint. A bitmap of fixed size keeps windows
of other fingerprints from being looked at; where it lets one through, verification drops it.

Nulls and edge cases: a null text has no words; a text of fewer words than a window keeps all; windows are judged on the
input; rows that repeat a doc_id are one document to the index, so they don't remove each other's words; a row with a
null doc_id removes nothing and loses nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.llm.common import BROADCAST_IDS, WORD, bitmap_bits, bitmap_of, drop_materialized, gram_hashes, in_bitmap, lean, materialize, mix, text_chunks, word_hashes

#: Words of a window, and of the k-grams whose smallest hash is its fingerprint.
WINDOW, GRAM = 13, 4
FANOUT = 2


def _windows(column: pa.Array, window: int, gram: int):
    """Yield (row of each window, its first word, its hash, its fingerprint) over chunks of texts."""
    for first, data, offsets in text_chunks(column):
        words, at = word_hashes(data, offsets)
        n = len(words) - window + 1
        if n <= 0:
            continue
        low, have, want = gram_hashes(words, gram), 1, window - gram + 1
        while have < want:  # the smallest of want neighbours, by doubling
            step = min(have, want - have)
            low = np.minimum(low[: len(low) - step], low[step:])
            have += step
        rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
        whole = rows[:n] == rows[window - 1 :]
        start = np.flatnonzero(whole)
        rows = rows[start]
        yield first + rows, start - at[rows], gram_hashes(words, window)[start], mix(low[start] ^ np.uint64(0xA5A5A5A5A5A5A5A5))


def fingerprints(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(h, doc_id): the distinct fingerprints of each document's windows."""

    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for rows, _, _, h in _windows(b.column(1), window, gram):
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(ids[rows[new]])], ["h", "doc_id"])

    return docs.mapInArrow(lean(run), "h long, doc_id long")


class WindowIndex:
    """Sorted immutable runs of fingerprints; append() takes a batch and returns the fingerprints it repeats.

    With a folder, runs and the manifest that names them by level lie there and a later session goes on by WindowIndex.load();
    the manifest is put in place last, so a job that dies leaves the index as it was. Without one, runs lie in the shared folder.
    """

    def __init__(self, window: int = WINDOW, gram: int = GRAM, fanout: int = FANOUT, folder: str | None = None):
        self.window, self.gram, self.fanout, self.folder = window, gram, fanout, folder
        self.levels: list[list[DataFrame]] = [[]]
        self.paths: list[list[str]] = [[]]

    @classmethod
    def load(cls, spark, folder: str) -> WindowIndex:
        """The index in a folder as its last append left it."""
        said = spark.read.schema("version long, window int, gram int, fanout int, levels array<array<string>>").json(f"{folder}/manifests").orderBy(F.desc("version")).first()
        index = cls(said.window, said.gram, said.fanout, folder)
        index.paths = [list(level) for level in said.levels]
        index.levels = [[spark.read.schema("h long, first long, last long").parquet(p) for p in level] for level in index.paths]
        return index

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    @staticmethod
    def _merged(rows: DataFrame) -> DataFrame:
        return rows.groupBy("h").agg(F.min("first").alias("first"), F.max("last").alias("last")).sortWithinPartitions("h")

    def _written(self, rows: DataFrame, level: int) -> DataFrame:
        """A new run of a level; it counts from when _commit() names it."""
        run = materialize(self._merged(rows), "run", self.folder)
        self.levels[level].append(run)
        self.paths[level].append(run.inputFiles()[0].rsplit("/", 1)[0] if run.inputFiles() else "")
        return run

    def _commit(self, spark, old: list[DataFrame]) -> None:
        if self.folder:
            version = time.time_ns()
            one = spark.createDataFrame([(version, self.window, self.gram, self.fanout, [[p for p in level if p] for level in self.paths])], "version long, window int, gram int, fanout int, levels array<array<string>>")
            one.coalesce(1).write.mode("append").json(f"{self.folder}/manifests")
        for r in old:
            drop_materialized(r)

    def append(self, batch: DataFrame) -> DataFrame:
        """Index (doc_id, text) rows; returns (h) of fingerprints that now lie in two or more documents, one of them in the batch.

        Reads the batch and the runs, and no document of an earlier batch.
        """
        rows = fingerprints(batch.select("doc_id", "text"), self.window, self.gram).withColumns({"first": F.col("doc_id"), "last": F.col("doc_id")})
        history = self.runs()
        run = self._written(rows, 0)
        met = run.where("first <> last").select("h")
        for old in history:
            met = met.union(run.hint("merge").join(old.select("h", F.col("first").alias("f"), F.col("last").alias("l")), "h").where("first <> l or last <> f").select("h"))
        met = materialize(met.distinct(), "met")
        self._commit(batch.sparkSession, self._compact())
        return met

    def _compact(self) -> list[DataFrame]:
        """Merge full levels; returns the runs that are no longer needed."""
        at, gone = 0, []
        while at < len(self.levels) and len(self.levels[at]) >= self.fanout:
            runs, self.levels[at], self.paths[at] = self.levels[at], [], []
            both = runs[0]
            for r in runs[1:]:
                both = both.union(r)
            if at + 1 == len(self.levels):
                self.levels.append([])
                self.paths.append([])
            self._written(both, at + 1)
            gone += runs
            at += 1
        return gone


def repeated_windows(docs: DataFrame, met: list[DataFrame], window: int, gram: int) -> DataFrame:
    """(doc_id, starts) of windows that a document of smaller doc_id holds too, verified by window hash; docs: all documents."""
    h = met[0]
    for m in met[1:]:
        h = h.union(m)
    bits = bitmap_bits(sum(m.count() for m in met))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(h, bits))

    def run(batches):
        bitmap = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for rows, start, w, h in _windows(b.column(1), window, gram):
                hit = np.flatnonzero(in_bitmap(bitmap, bits, h))
                if len(hit):
                    yield pa.RecordBatch.from_arrays([pa.array(w[hit].view(np.int64)), pa.array(ids[rows[hit]]), pa.array(start[hit].astype(np.int32))], ["w", "doc_id", "at"])

    rows = docs.mapInArrow(lean(run), "w long, doc_id long, at int")
    first = rows.groupBy("w").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last").select("w", "first")
    # written, so that both sides of the join are plain shuffles, of which adaptive execution can split those of a hot window
    return rows.join(materialize(first, "first"), "w").where("doc_id > first").groupBy("doc_id").agg(F.collect_set("at").alias("starts"))


def remove_repeats(documents: DataFrame, batches: int = 2, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept (text of the kept words joined by one space; null text where nothing was removed is empty).

    The documents are taken in as batches of rising doc_id, each against the index of those before it. Column `text` of
    the input is returned too, with all other columns of the input.
    """
    spark = documents.sparkSession
    ids = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    keyed = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    index, met, low = WindowIndex(window, gram), [], None
    for high in [*dict.fromkeys(cuts), None]:
        batch = keyed
        if low is not None:
            batch = batch.where(F.col("doc_id") > low)
        if high is not None:
            batch = batch.where(F.col("doc_id") <= high)
        met.append(index.append(batch))
        low = high
    starts = materialize(repeated_windows(keyed, met, window, gram), "starts")
    for f in [*met, *index.runs()]:
        drop_materialized(f)
    changed = starts.select("doc_id")
    key = F.col("doc_id").cast("long")
    if starts.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:  # only changed texts are shuffled
        tagged = documents.join(F.broadcast(changed.select(F.col("doc_id").alias("_id"), F.lit(True).alias("_hit"))), key == F.col("_id"), "left").drop("_id")
        same = tagged.where("_hit is null").drop("_hit").withColumn("_starts", F.lit(None).cast("array<int>"))
        hit = tagged.where("_hit").drop("_hit").withColumn("_k", key).join(starts.select(F.col("doc_id").alias("_k"), F.col("starts").alias("_starts")), "_k").drop("_k")
        both = same.unionByName(hit)
    else:
        both = documents.withColumn("_k", key).join(starts.select(F.col("doc_id").alias("_k"), F.col("starts").alias("_starts")), "_k", "left").drop("_k")
    word = re.compile(WORD)

    def cut(batches):
        for b in batches:
            total, gone, kept = [], [], []
            for text, s in zip(b.column(b.schema.get_field_index("text")).to_pylist(), b.column(b.schema.get_field_index("_starts")).to_pylist(), strict=True):
                words = word.findall(text or "")
                total.append(len(words))
                if s:
                    keep = np.zeros(len(words) + 1, np.int64)
                    s = np.array(s)
                    np.add.at(keep, s, 1)
                    np.add.at(keep, s + window, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(keep)[:-1] == 0)]
                gone.append(total[-1] - len(words))
                kept.append(" ".join(words))
            cols = [b.column(i) for i in range(b.num_columns) if b.schema.names[i] != "_starts"]
            names = [x for x in b.schema.names if x != "_starts"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], [*names, "n_words", "n_removed", "kept"])

    clash = [c for c in ("n_words", "n_removed", "kept") if c in documents.columns]
    both = both.drop(*clash)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.schema.fields if f.name != "_starts")
    return both.mapInArrow(lean(cut), f"{schema}, n_words long, n_removed long, kept string")


def digest(kept: DataFrame) -> DataFrame:
    """The contract's columns."""
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def reference(rows: list[tuple[int, str | None]], window: int = WINDOW) -> dict[int, tuple[int, int, str]]:
    """Brute force over (doc_id, text), for tests."""
    word, first, docs = re.compile(WORD), {}, {}
    for i, t in rows:
        w = docs[i] = word.findall(t or "")
        for j in range(len(w) - window + 1):
            k = tuple(w[j : j + window])
            first[k] = min(first.get(k, i), i)
    out = {}
    for i, w in docs.items():
        gone = set()
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                gone.update(range(j, j + window))
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest())
    return out
