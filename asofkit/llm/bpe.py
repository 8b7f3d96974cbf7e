"""Byte-level BPE encoding and decoding with Spark higher-order functions.

Texts are split by the tokenizer's pattern into words, and distinct words are encoded in the JVM: an aggregate over a
word's byte array merges the neighbours of lowest rank until no merge is left. Bytes are held as Latin-1 strings, ranks as a
literal array of small maps picked by crc32, so a look-up costs the same for any vocabulary. The words met most in the
whole corpus, at most COMMON of them, are encoded once and broadcast by the order of their hashes, a hash that is found being
held against the word; the other distinct words of a block of documents are encoded where the block is, so that no text
or id is shuffled. Decoding concatenates the byte strings of the ids.

Words of over FOLD_BYTES bytes, for which a fold takes time that grows with the square, are merged exactly by a heap.

Nulls and edge cases: a null or empty text has no ids and decodes to nothing; special tokens in a text are ordinary text;
a null doc_id and repeated rows are kept as they are; a very long text makes a block of its own; other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofkit.llm.common import Numbers, drop_materialized, lean, materialize, most_counted, string_hashes
from asofkit.llm.splitting import Splitter

#: Longest word that the fold takes, characters of text in a block, and maps that the rank table is divided into.
FOLD_BYTES, BLOCK_CHARS, MAPS = 128, 4 << 20, 1 << 15
#: Words that are broadcast with their ids, as flat arrays: at most about 100 MB.
COMMON = 2_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


class RankTable:
    """Ranks of byte strings as a literal; rank() is null where there is none."""

    def __init__(self, ranks: dict[bytes, int]):
        maps: list[dict[str, int]] = [{} for _ in range(MAPS)]
        for piece, rank in ranks.items():
            s = piece.decode("latin-1")
            maps[zlib.crc32(s.encode()) % MAPS][s] = rank
        self.table = F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")

    @staticmethod
    def rank(table: Column, s: Column) -> Column:
        return F.get(table, F.pmod(F.crc32(s.cast("binary")), F.lit(MAPS)).cast("int")).getItem(s)

    def merge(self, s: Column) -> Column:
        """Ids of the byte string s (bytes as Latin-1): a fold that merges one pair of lowest rank a step, the leftmost first.

        The state holds the pieces, and for each piece the rank of the merge with the next one.
        """
        return _let(self.table, lambda table: self._merge(table, s))

    def _merge(self, table: Column, s: Column) -> Column:
        none = F.lit(2**31 - 1)
        rank = lambda a, b: _let(F.concat(a, b), lambda x: F.coalesce(self.rank(table, x), none))
        start = _let(F.split(s, ""), lambda p: F.struct(p.alias("p"), F.transform(p, lambda x, i: rank(x, F.get(p, i + 1))).alias("r")))

        def merged(acc: Column, k: Column) -> Column:
            p = acc["p"]
            without = lambda x, i: i != k + 1
            pieces = lambda pair: F.filter(F.transform(p, lambda x, i: F.when(i == k, pair).otherwise(x)), without)
            ranks = lambda pair: F.filter(
                F.transform(acc["r"], lambda x, i: F.when(i == k, rank(pair, F.get(p, k + 2))).when(i == k - 1, rank(F.get(p, i), pair)).otherwise(x)), without
            )
            return _let(F.concat(F.get(p, k), F.get(p, k + 1)), lambda pair: F.struct(pieces(pair).alias("p"), ranks(pair).alias("r")))

        def step(acc: Column, _: Column) -> Column:
            first = lambda m: F.array_position(acc["r"], m).cast("int") - 1
            return _let(F.array_min(acc["r"]), lambda m: F.when(m == none, acc).otherwise(_let(first(m), lambda k: merged(acc, k))))

        fold = F.aggregate(F.sequence(F.lit(2), F.length(s)), start, step, lambda acc: F.transform(acc["p"], lambda x: self.rank(table, x)))
        return _let(self.rank(table, s), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(fold))


def heap_merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a long byte string, in n log n."""
    if piece in ranks:
        return [ranks[piece]]
    part = [piece[i : i + 1] for i in range(len(piece))]
    prev, nxt, n = list(range(-1, len(part) - 1)), list(range(1, len(part) + 1)), len(part)
    heap = [(ranks[part[i] + part[i + 1]], i, part[i], part[i + 1]) for i in range(n - 1) if part[i] + part[i + 1] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = nxt[i]
        if part[i] != a or j >= n or part[j] != b:
            continue
        part[i], part[j], nxt[i] = a + b, b"", nxt[j]
        if nxt[i] < n:
            prev[nxt[i]] = i
        for x, y in ((prev[i], i), (i, nxt[i])):
            if x >= 0 and y < n and (r := ranks.get(part[x] + part[y])) is not None:
                heapq.heappush(heap, (r, x, part[x], part[y]))
    return [ranks[p] for p in part if p]


def encode(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) and decoded (binary) of each text."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranks = load_ranks(ranks_path)
    table = RankTable(ranks)
    bytes_of = lambda w: F.decode(w.cast("binary"), "ISO-8859-1")
    short = lambda w: F.octet_length(w) <= FOLD_BYTES

    def count(batches):
        split = Splitter(pattern)
        for b in batches:
            words: Counter[str] = Counter()
            for text in b.column(0):
                words.update(split(text.as_py() or ""))
                if len(words) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"])
                    words.clear()
            yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"])

    counts = docs.select("text").mapInArrow(lean(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialize(counts.where((F.col("n") > 1) & short(F.col("word"))), "counts")
    common = most_counted(counts, "n", COMMON).select("word", table.merge(bytes_of(F.col("word"))).alias("ids")).toArrow().combine_chunks()
    drop_materialized(counts)
    words, lists = (common.column(k).combine_chunks() if common.num_rows else pa.array([], t) for k, t in (("word", pa.string()), ("ids", pa.list_(pa.int32()))))
    hashes = string_hashes(words)
    order = np.argsort(hashes)
    spark = docs.sparkSession
    known_words, known_ids = spark.sparkContext.broadcast((hashes[order], words.take(pa.array(order)))), spark.sparkContext.broadcast((lists.take(pa.array(order)), ranks))
    del common, words, lists, hashes, order

    def block(batches):
        split, pack = Splitter(pattern), zstandard.ZstdCompressor(1).compress
        ids, codes, index, held = [], [], Numbers(), 0

        def row():
            own = pa.array(list(index), pa.string())
            at = positions(*known_words.value, own)
            kinds = (pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((ids, codes, at, own.filter(pa.array(at < 0))), kinds, strict=True)], ["doc_ids", "codes", "known", "rare"])

        for b in batches:
            for i, text in zip(b.column(0), b.column(1), strict=True):
                text = text.as_py() or ""
                if held and held + len(text) > BLOCK_CHARS:
                    yield row()
                    ids, codes, index, held = [], [], Numbers(), 0
                ids.append(i.as_py())
                codes.append(pack(np.array(list(map(index.__getitem__, split(text))), np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()))
                held += len(text) + 1
        if ids:
            yield row()

    def put(batches):
        lists, ranks = known_ids.value
        pieces = _kept(known_ids, "pieces", lambda v: {r: p for p, r in v[1].items()})
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for row in range(b.num_rows):
                doc_ids, codes, known, rare, merged = (b.column(k).slice(row, 1).flatten() for k in range(5))
                known = known.to_numpy(zero_copy_only=False)
                mine = _token_bytes(merged)
                for k in np.flatnonzero(merged.is_null().to_numpy(zero_copy_only=False)):
                    mine[k] = np.array(heap_merge(rare[int(k)].as_py().encode(), ranks), "<u4").tobytes()
                found, mine = iter(_token_bytes(lists.take(pa.array(known[known >= 0])))), iter(mine)
                token = [next(found if k >= 0 else mine) for k in known.tolist()]
                texts = [b"".join([pieces[x] for x in np.frombuffer(t, "<u4").tolist()]) for t in token]
                for a in range(0, len(doc_ids), 1000):
                    out_ids, out = [], []
                    for c in codes.slice(a, 1000).to_pylist():
                        raw = np.frombuffer(unpack(c), np.uint8)
                        code = np.ascontiguousarray(raw.reshape(4, -1).T).view(np.uint32).ravel().tolist() if len(raw) else []
                        out_ids.append(b"".join([token[k] for k in code]))
                        out.append(b"".join([texts[k] for k in code]))
                    yield pa.RecordBatch.from_arrays([doc_ids.slice(a, 1000), pa.array(out_ids, pa.binary()), pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])

    blocks = docs.mapInArrow(lean(block), "doc_ids array<long>, codes array<binary>, known array<int>, rare array<string>")
    # written, so that the workers that split and those that join need not be in memory together
    blocks = materialize(blocks.withColumn("merged", F.transform("rare", lambda w: F.when(short(w), table.merge(bytes_of(w))))), "blocks")
    known_words.unpersist()
    return blocks.mapInArrow(lean(put), "doc_id long, ids binary, decoded binary")


def positions(hashes: np.ndarray, words: pa.Array, asked: pa.Array) -> np.ndarray:
    """Place of each asked string among words, which lie by their sorted hashes; -1 for one that is not there."""
    if not len(hashes):
        return np.full(len(asked), -1, np.int32)
    at = np.minimum(np.searchsorted(hashes, string_hashes(asked)), len(hashes) - 1)
    return np.where(pc.equal(words.take(pa.array(at)), asked).to_numpy(zero_copy_only=False), at, -1).astype(np.int32)


def _token_bytes(lists: pa.ListArray) -> list[bytes]:
    """Each list of ids of an Arrow list array as little-endian unsigned 32-bit; a null list is empty."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes()
    ends = np.cumsum(4 * lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]


_held: dict[str, tuple[object, object]] = {}


def _kept(shared, name: str, make):
    """make(value of a broadcast), kept for later tasks of the same Python worker."""
    value = shared.value
    if name not in _held or _held[name][0] is not value:
        _held[name] = (value, make(value))
    return _held[name][1]


def digest(encoded: DataFrame) -> DataFrame:
    """The contract's columns."""

    def run(batches):
        import hashlib

        names: list[str] = []
        for b in batches:
            count, sha = [], []
            for x in b.column(1):
                ids = np.frombuffer(x.as_py(), "<u4")
                if len(ids) and ids.max() >= len(names):
                    names = [str(i) for i in range(int(ids.max()) + 1)]
                count.append(len(ids))
                sha.append(hashlib.sha256(" ".join([names[i] for i in ids.tolist()]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count, pa.int64()), pa.array(sha, pa.string()), b.column(2)], ["doc_id", "n_tokens", "ids_sha256", "d"])

    out = encoded.select("doc_id", "ids", F.sha2("decoded", 256).alias("d")).mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, d string")
    return out.withColumnRenamed("d", "decoded_sha256")
