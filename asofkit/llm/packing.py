"""Best-two-fit packing of token sequences.

Documents become pieces of at most LIMIT tokens; only longer ones are cut, the first piece being the shorter one. Pieces
are dealt by hash over shards of bounded size, each with the same mix of lengths, and packed a shard at a time: a bin opens
with the largest piece, is filled greedily with the largest that fits, and then its smallest piece gives way to two
unpacked ones that fit the gap so widened more tightly, as long as that helps.

Nulls and edge cases: a null or empty text is the end mark alone; a row with a null doc_id is packed too; repeated rows are
packed as often as they come; ties in length go in order of (doc_id, piece); other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.llm.common import lean

LIMIT, END = 2048, 0
#: Documents a shard.
SHARD_DOCS = 30_000


class Encoder:
    """Ids of a text under a byte-level `tokenizers` file, as that library gives them: an added token in a text is its id.

    The file's vocabulary lists merges by rank, so the tiktoken engine gives the same ids at a third of the time; the tests
    hold it against the `tokenizers` library.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # byte-level files write each byte as a printable character: itself where it is one, else from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", [])):
            raise ValueError("added tokens that take in their surroundings are not supported")
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.engine = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return np.array(self.engine.encode(text, allowed_special="all"), "<u4").tobytes()


def pieces(documents: DataFrame, encoder: Callable[[], Encoder], limit: int = LIMIT, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches):
        make = encoder()
        stop = np.array([end], "<u4").tobytes()
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for i, text in zip(b.column(0), b.column(1), strict=True):
                ids = memoryview(make.encode(text.as_py() or "") + stop)
                n = len(ids) // 4
                cuts = [0, *range(n % limit or limit, n + 1, limit)] if n > limit else [0, n]
                for p, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for c, v in zip(out, (i.as_py(), p, a, z - a, zlib.crc32(ids[4 * a : 4 * z])), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_two_fit(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item; lengths from 1 to limit.

    Which lengths are left is a bit set in one integer, so the largest that fits and the best pair for a gap are a few
    operations on whole words.
    """
    order = np.argsort(lengths, kind="stable")[::-1]
    left: list[list[int]] = [[] for _ in range(limit + 1)]
    for i in order:
        left[lengths[i]].append(int(i))
    have = back = 0  # bit n, and bit limit - n, for every length n that is left
    for n in range(1, limit + 1):
        if left[n]:
            have |= 1 << n
            back |= 1 << (limit - n)
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)

    def take(n: int) -> int:
        nonlocal have, back
        i = left[n].pop()
        if not left[n]:
            have &= ~(1 << n)
            back &= ~(1 << (limit - n))
        return i

    def pair(gap: int, least: int) -> tuple[int, int] | None:
        """Lengths of two items left whose sum is the largest up to gap and above least."""
        for total in range(gap, least, -1):
            # bit x: lengths x and total - x are both left
            both = have & (back >> (limit - total)) & ((1 << total) - 1)
            while both:
                x = both.bit_length() - 1
                if 2 * x != total or len(left[x]) > 1:
                    return x, total - x
                both &= ~(1 << x)
        return None

    n_bin = 0
    while have:
        n = have.bit_length() - 1
        mine, gap = [(n, take(n))], limit - n
        while True:
            while gap and (fits := have & ((1 << (gap + 1)) - 1)):
                n = fits.bit_length() - 1
                mine.append((n, take(n)))
                gap -= n
            if not gap or not have:
                break
            small = min(range(len(mine)), key=lambda k: (mine[k][0], k))
            n, i = mine[small]
            found = pair(gap + n, n)
            if not found:
                break
            mine.pop(small)
            for x in found:
                mine.append((x, take(x)))
            left[n].append(i)
            have |= 1 << n
            back |= 1 << (limit - n)
            gap += n - sum(found)
        at = 0
        for n, i in mine:
            where[i], offset[i] = n_bin, at
            at += n
        n_bin += 1
    return where, offset


def pack(items: DataFrame, n_docs: int, limit: int = LIMIT, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """The items (doc_id, piece, start, length, ...) with sequence_id and offset."""
    shards = max(1, -(-n_docs // shard_docs))
    base = items.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)))

    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "piece"], kind="stable").reset_index(drop=True)
        where, offset = best_two_fit(group.length.to_numpy(np.int64), limit)
        return group.drop(columns="_shard").assign(sequence_id=where * shards + int(key[0]), offset=offset)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    return base.groupBy("_shard").applyInPandas(run, f"{schema}, sequence_id long, offset long")
