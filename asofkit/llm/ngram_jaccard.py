"""N-gram Jaccard join by vertical partitioning, exact, with one class id a document.

The global order of n-grams puts rare ones first: n-grams that many documents hold, counted over all documents, come last, by
how many; all others come by their hash. The order is cut in fragments. The first fragment of a document, its prefix, holds
enough n-grams that two linked documents must share one of them; it yields candidate pairs. Each further fragment is
joined apart, yields a partial overlap a pair, and the sum a pair is held against the threshold in whole numbers.

Copies are not expanded into all pairs. First every document of a prefix bucket is held against the smallest document
of the bucket only, and the links found are contracted. Then pairs of one bucket that are not yet in one
component are held against each other, less those that the triangle inequality of the Jaccard distance excludes.

Nulls and edge cases: a null or empty text has no words, an empty set and no link; a null doc_id links with nothing and
gets a null component; rows that repeat a doc_id are one node; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.llm.common import bitmap_bits, bitmap_of, components, drop_materialized, gram_hashes, in_bitmap, keep_ids, lean, materialize, most_counted, text_chunks, whole_hash, word_hashes

#: Fragments of the order that verification counts apart.
FRAGMENTS = 8
#: Documents that hold an n-gram for it to count as frequent, and n-grams of a task that are counted before they are shuffled.
LEAST, COUNTED = 24, 1 << 21
#: Leading bits of a hash by which counted n-grams are dealt, packed.
CUT_BITS = 12
#: At most so many frequent n-grams are put last; the bound touches the order only, never the result.
FREQUENT = 1 << 18
#: Largest bucket whose pairs are joined row by row, and documents of a block for larger ones.
SMALL, BLOCK = 32, 1000


def sets_of(column: pa.Array, n: int):
    """Yield (row, sorted distinct n-gram hashes) for every text of an Arrow column."""
    for first, data, offsets in text_chunks(column):
        words, at = word_hashes(data, offsets, lower=True)
        grams = gram_hashes(words, n)
        for i in range(len(at) - 1):
            a, b = at[i], at[i + 1]
            if b - a >= n:
                yield first + i, np.unique(grams[a : b - n + 1])
            elif b > a:
                yield first + i, np.array([whole_hash(words[a:b])], np.uint64)
            else:
                yield first + i, np.zeros(0, np.uint64)


def packed_grams(docs: DataFrame, n: int) -> DataFrame:
    """(cut, grams, counts): the n-grams of all texts, counted by task, packed a row for each cut of the hashes instead of a row each."""
    cuts = np.arange(1 << CUT_BITS, dtype=np.uint64) << np.uint64(64 - CUT_BITS)

    def run(batches):
        held, rows = [], 0

        def blobs(flat, at):
            return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * flat.itemsize).astype(np.int32)), pa.py_buffer(flat)])

        def counted():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            at = np.append(np.searchsorted(h, cuts), len(h))
            full = np.flatnonzero(np.diff(at))
            at = np.append(at[full], len(h))
            out = pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), blobs(h, at), blobs(c.astype(np.uint32), at)], ["cut", "grams", "counts"])
            for a in range(0, out.num_rows, 512):
                yield out.slice(a, 512)

        for b in batches:
            for _, s in sets_of(b.column(0), n):
                held.append(s)
                rows += len(s)
                if rows >= COUNTED:
                    yield from counted()
                    held, rows = [], 0
        if rows:
            yield from counted()

    return docs.select("text").mapInArrow(lean(run), "cut int, grams binary, counts binary")


def frequent_grams(docs: DataFrame, n: int) -> np.ndarray:
    """Hashes of the n-grams that at least LEAST documents hold, rarest first; of more than FREQUENT those that most hold."""

    def add(batches):
        held, last = [], None

        def summed():
            h, c = (np.concatenate([np.frombuffer(x[k], t) for x in held]) for k, t in ((0, np.uint64), (1, np.uint32)))
            order = np.argsort(h)
            h = h[order]
            at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            total = np.add.reduceat(c[order].astype(np.int64), at)
            often = total >= LEAST
            return pa.RecordBatch.from_arrays([pa.array(h[at][often].view(np.int64)), pa.array(total[often])], ["h", "count"])

        for b in batches:
            for cut, grams, counts in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                if cut != last and held:
                    yield summed()
                    held = []
                last = cut
                held.append((grams.as_py(), counts.as_py()))
        if held:
            yield summed()

    dealt = packed_grams(docs, n).repartition("cut").sortWithinPartitions("cut")
    seen = materialize(dealt.mapInArrow(lean(add), "h long, count long"), "seen")
    often = sorted((r["count"], r["h"]) for r in most_counted(seen, "count", FREQUENT).collect())
    drop_materialized(seen)
    return np.array([h for _, h in often], np.int64).view(np.uint64)


def _signatures(docs: DataFrame, n: int, percent: int, often: np.ndarray) -> DataFrame:
    """doc_id, n_shingles, digest of the set (two words), and its prefix: the first n - ceil(percent n / 100) + 1 n-grams in the global order."""
    where = np.argsort(often)
    shared = docs.sparkSession.sparkContext.broadcast((often[where], where))

    def run(batches):
        known, rank = shared.value

        def prefix(s):
            take = len(s) - -(-percent * len(s) // 100) + 1
            if len(known):
                at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                hit = known[at] == s
                if hit.any():
                    rare = s[~hit]
                    if len(rare) >= take:
                        return rare[:take]
                    late = s[hit][np.argsort(rank[at[hit]], kind="stable")]
                    return np.concatenate([rare, late[: take - len(rare)]])
            return s[:take]

        for whole in batches:
            for a in range(0, whole.num_rows, 2000):
                b = whole.slice(a, 2000)
                sizes, one, two, heads = [], [], [], []
                for _, s in sets_of(b.column(1), n):
                    sizes.append(len(s))
                    one.append(int(np.bitwise_xor.reduce(s)) if len(s) else 0)
                    two.append(int((s * np.uint64(0x9E3779B97F4A7C15) ^ (s >> np.uint64(29))).sum(dtype=np.uint64)) if len(s) else 0)
                    heads.append(prefix(s).tobytes() if len(s) else b"")
                digests = [pa.array(np.array(d, np.uint64).view(np.int64)) for d in (one, two)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), *digests, pa.array(heads, pa.binary())], ["doc_id", "n_shingles", "d1", "d2", "head"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n_shingles long, d1 long, d2 long, head binary")


def _heads(signatures: DataFrame, only: tuple[bytes, int] | None = None) -> DataFrame:
    """(h, doc_id) for every n-gram of every prefix, or for those that a bitmap holds."""
    shared = signatures.sparkSession.sparkContext.broadcast(only)

    def run(batches):
        bitmap = (np.frombuffer(shared.value[0], np.uint8), shared.value[1]) if shared.value else None
        for whole in batches:
            for a in range(0, whole.num_rows, 1000):
                b = whole.slice(a, 1000)
                heads = b.column(1).to_pylist()
                h = np.frombuffer(b"".join(heads), np.uint64)
                ids = np.repeat(b.column(0).to_numpy(), [len(x) // 8 for x in heads])
                if bitmap:
                    hit = in_bitmap(*bitmap, h)
                    h, ids = h[hit], ids[hit]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids)], ["h", "doc_id"])

    return signatures.where("doc_id is not null").select("doc_id", "head").mapInArrow(lean(run), "h long, doc_id long")


def _fragments(docs: DataFrame, n: int, often: np.ndarray) -> DataFrame:
    """(doc_id, fragment, grams) for the parts of each document's set by the global order; 40 bits of each hash within its fragment.

    The n-grams that are not frequent stand in the order of their hashes, which FRAGMENTS cuts divide; the frequent ones,
    last in the order, are one fragment more.
    """
    bits, low40 = FRAGMENTS.bit_length() - 1, np.uint64((1 << 40) - 1)
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(often))

    def run(batches):
        known = shared.value
        for b in batches:
            ids, doc, part, blob = b.column(0).to_pylist(), [], [], []
            for i, s in sets_of(b.column(1), n):
                late = s[:0]
                if len(known):
                    hit = known[np.minimum(np.searchsorted(known, s), len(known) - 1)] == s
                    s, late = s[~hit], s[hit]
                cuts = np.searchsorted(s >> np.uint64(64 - bits), np.arange(FRAGMENTS + 1))
                pack = lambda h: h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                low = pack(s >> np.uint64(24 - bits) & low40)
                found = [(f, low[cuts[f] : cuts[f + 1]]) for f in range(FRAGMENTS)] + [(FRAGMENTS, pack(late >> np.uint64(24)))]
                for f, grams in found:
                    if len(grams):
                        doc.append(ids[i])
                        part.append(f)
                        blob.append(grams.tobytes())
                if len(doc) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(part, pa.int32()), pa.array(blob, pa.binary())], ["doc_id", "fragment", "grams"])
                    doc, part, blob = [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(part, pa.int32()), pa.array(blob, pa.binary())], ["doc_id", "fragment", "grams"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, fragment int, grams binary")


def overlaps(pairs: DataFrame, docs: DataFrame, n: int, often: np.ndarray) -> DataFrame:
    """(a, b, overlap) for candidate pairs (a, b): partial overlaps of every fragment, summed a pair."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    parts = _fragments(keep_ids(docs, materialize(ids, "ids"), "doc_id"), n, often)
    left = pairs.join(parts.select(F.col("doc_id").alias("b"), "fragment", F.col("grams").alias("gb")), "b")
    both = left.join(parts.select(F.col("doc_id").alias("a"), "fragment", F.col("grams").alias("ga")), ["a", "fragment"])

    def run(batches):
        def unpack(x):
            out = np.zeros((len(x) // 5, 8), np.uint8)
            out[:, :5] = np.frombuffer(x, np.uint8).reshape(-1, 5)
            return out.view("<u8").ravel()

        for b in batches:
            counts, last, mine = [], None, None
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = x.as_py(), y.as_py()
                if x != last:
                    last, mine = x, unpack(x)
                counts.append(len(mine) + len(z) - len(np.union1d(mine, z)) if x != y and len(z := unpack(y)) else len(mine))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64())], ["a", "b", "part"])

    return both.select("a", "b", "ga", "gb").mapInArrow(lean(run), "a long, b long, part long").groupBy("a", "b").agg(F.sum("part").alias("overlap"))


def _large(side: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) between different components among documents that share a large bucket, one for each two components and block pair.

    side: (family, doc_id, root) of the documents of large buckets; a family is the buckets whose smallest documents are of one
    component, so documents that share a bucket are of one family. A family is held against itself in blocks of at most
    BLOCK documents: fragment by fragment the n-grams in common are counted for all pairs of two blocks as a product of
    indicator matrices, and summed.
    """
    side = side.select("family", "doc_id", "root").distinct()
    blocks = side.groupBy("family").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks")).withColumnRenamed("family", "_f")
    dealt = side.join(blocks, F.col("family") == F.col("_f")).drop("_f")

    def whole(batches):
        for b in batches:
            for a in range(0, b.num_rows, 500):
                part = b.slice(a, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for _, s in sets_of(part.column(1), n)], pa.binary())], ["doc_id", "grams"])

    ids = materialize(side.select("doc_id").distinct(), "ids")
    sets = keep_ids(docs, ids, "doc_id").select("doc_id", "text").mapInArrow(lean(whole), "doc_id long, grams binary")
    dealt = dealt.join(sets, "doc_id").withColumn("mine", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")})

    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        sides = [group[group.mine == k] for k in key[1:]]
        grams = [[np.frombuffer(g, np.uint64) for g in x.grams] for x in sides]
        flat = [np.concatenate(g) for g in grams]
        rows = [np.repeat(np.arange(len(g)), [len(x) for x in g]) for g in grams]
        both = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
        shared = np.zeros((len(grams[0]), len(grams[1])), np.float32)
        for at in range(0, len(both), 4096):
            fragment, marks = both[at : at + 4096], []
            for g, r, f in zip(grams, rows, flat, strict=True):
                where = np.minimum(np.searchsorted(fragment, f), len(fragment) - 1)
                hit = fragment[where] == f
                mark = np.zeros((len(g), len(fragment)), np.float32)
                mark[r[hit], where[hit]] = 1
                marks.append(mark)
            shared += marks[0] @ marks[1].T
        size = [np.array([len(x) for x in g]) for g in grams]
        root = [x.root.to_numpy() for x in sides]
        union = size[0][:, None] + size[1][None, :] - shared
        r, c = np.nonzero((shared * 100 >= union * percent) & (root[0][:, None] != root[1][None, :]))
        out = pd.DataFrame({"a": sides[0].doc_id.to_numpy()[r], "b": sides[1].doc_id.to_numpy()[c], "ra": root[0][r], "rb": root[1][c]})
        return out.drop_duplicates(["ra", "rb"])[["a", "b"]]

    return dealt.select("family", "i", "j", "mine", "doc_id", "root", "grams").groupBy("family", "i", "j").applyInPandas(run, "a long, b long")


def link_documents(documents: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest linked doc_id) and copy_of (smallest doc_id with the same set)."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = docs.where("doc_id is not null")
    often = frequent_grams(keyed, n)
    signed = materialize(_signatures(docs, n, percent, often), "signatures")
    sizes = signed.select("doc_id", "n_shingles", "d1", "d2")
    first = sizes.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("copy_of"))
    # written, so that both sides of the join are plain shuffles, of which adaptive execution can split those of a set with many copies
    first = materialize(first, "first")
    nodes = materialize(sizes.join(first, ["d1", "d2", "n_shingles"], "left").select("doc_id", "n_shingles", F.coalesce("copy_of", "doc_id").alias("copy_of")), "nodes")
    reps = nodes.where("doc_id = copy_of").groupBy("doc_id").agg(F.max("n_shingles").alias("size"))

    heads = _heads(signed).groupBy("h").agg(F.count("*").alias("c"), F.min("doc_id").alias("hub")).where("c > 1").select("h", "hub")
    heads = materialize(heads, "heads")
    bits = bitmap_bits(heads.count())
    rows = _heads(signed, (bitmap_of(heads, bits), bits)).join(heads, "h")
    # copies share their representative's prefix, so only representatives take part
    others = nodes.where("doc_id is not null and doc_id <> copy_of").select("doc_id").distinct()
    rows = materialize(rows.join(others, "doc_id", "left_anti").select("h", "hub", "doc_id"), "rows")
    drop_materialized(signed)

    size = lambda c: reps.select(F.col("doc_id").alias(c), F.col("size").alias(f"n{c}"))
    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    star = rows.where("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    star = materialize(star.join(size("a"), "a").join(size("b"), "b"), "star")
    counted = overlaps(star.where(fits).select("a", "b"), keyed, n, often).withColumnRenamed("overlap", "o")
    linked = F.col("o") * 100 >= (F.col("na") + F.col("nb") - F.col("o")) * percent
    met = materialize(star.join(counted, ["a", "b"], "left").select("a", "b", "na", "nb", "o"), "met")
    edges = met.where(linked).select("a", "b")
    root = materialize(components(edges, "links"), "roots")

    # what the stars did not join: pairs of one bucket in different components
    tagged = rows.join(root.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    mixed = tagged.groupBy("h").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("members")).where("r0 <> r1").select("h", "members")
    dist = F.when(F.col("o").isNotNull(), 1 - F.col("o") / (F.col("na") + F.col("nb") - F.col("o")))
    side = tagged.where("doc_id <> hub").join(mixed, "h").join(reps, "doc_id").join(met.select(F.col("a").alias("hub"), F.col("b").alias("doc_id"), dist.alias("far")), ["hub", "doc_id"], "left")
    side = materialize(side.select("h", "members", "hub", "doc_id", "root", "size", "far"), "side")
    # all n-grams that a pair has in common up to the end of the shorter prefix lie in both prefixes, so it needs so many of
    # them; pairs that share a large bucket are counted apart
    x = side.where(F.col("members") <= SMALL).select("h", F.col("doc_id").alias("a"), F.col("root").alias("ra"), F.col("size").alias("na"), F.col("far").alias("fa"))
    y = x.select("h", F.col("a").alias("b"), F.col("ra").alias("rb"), F.col("na").alias("nb"), F.col("fa").alias("fb"))
    slack = 1 - percent / 100 + 1e-9
    near = F.col("fa").isNull() | F.col("fb").isNull() | (F.abs(F.col("fa") - F.col("fb")) <= slack)
    need = F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / F.lit(100 + percent) - 1e-9) - F.ceil(F.lit(percent) * F.greatest("na", "nb") / 100 - 1e-9) + 1
    both = x.join(y, "h").where((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & fits & near)
    more = both.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared")).where(F.col("shared") >= need).drop("shared")
    family = root.select(F.col("node").alias("hub"), F.col("root").alias("family"))
    large = side.where(F.col("members") > SMALL).join(family, "hub", "left").withColumn("family", F.coalesce("family", "hub"))
    more = materialize(more.join(met.select("a", "b"), ["a", "b"], "left_anti"), "more")
    found = overlaps(more.select("a", "b"), keyed, n, often).withColumnRenamed("overlap", "o")
    late = more.join(found, ["a", "b"]).where(linked).select("a", "b").union(_large(large, keyed, n, percent))
    final = components(root.select(F.col("node").alias("a"), F.col("root").alias("b")).union(late), "classes")
    final = final.select(F.col("node").alias("copy_of"), F.col("root").alias("component_id"))
    return nodes.join(final, "copy_of", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "copy_of").alias("component_id"), "copy_of")
