"""Document fingerprints: threshold-scaled sketches of word shingles, with DataFrame functions only.

A sketch keeps every shingle hash that lies below a fixed fraction of the hash range. What is kept depends on the hash
alone, so the sketch of a union is the union of the sketches, and the share of the smaller sketch found in the larger
estimates containment even between very unequal documents.

Nulls and edge cases: a null text is empty; a text of fewer words than a shingle is one shingle, one without words has
an empty sketch; where either sketch holds fewer than LEAST_KEPT hashes the likeness is taken over all shingles of both
texts, so short texts are compared exactly; where either text has no words it is 1 for equal texts and else 0. Documents are ordered by
doc_id descending, null last, rows that repeat a doc_id by text; a single document is followed by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of a shingle; one hash in SCALE is kept.
SHINGLE, SCALE = 5, 8
#: Kept hashes from which a sketch stands for its text in a likeness.
LEAST_KEPT = 16
#: Ranges of doc_id that the order is cut into, by approximate quantiles: one for so many rows, and at most so many. The window
#: of a range is sorted and spilled, so a larger range costs disk and time and no memory.
RANGE_ROWS, RANGES = 2000, 1 << 16


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def sketch(text: Column, shingle: int = SHINGLE, scale: int = SCALE) -> Column:
    """Sorted distinct kept hashes of a text's shingles."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    grams = lambda h: F.when(F.size(h) == 0, F.array().cast("array<long>")).when(
        F.size(h) < shingle, F.array(F.xxhash64(h))
    ).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - shingle, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(shingle)])))
    most = -(2**63) + 2**64 // scale - 1
    return F.array_sort(F.array_distinct(F.filter(_let(hashes, grams), lambda x: x <= most)))


def to_string(kept: Column) -> Column:
    """Hashes as hexadecimal words in rising order, joined by commas."""
    return F.array_join(F.transform(kept, lambda x: F.lower(F.hex(x))), ",")


def merge(a: Column, b: Column) -> Column:
    """The sketch of both documents together."""
    return F.array_sort(F.array_union(a, b))


def containment(a: Column, b: Column, equal: Column) -> Column:
    """Estimated share of the smaller shingle set that lies in the larger, 0 to 1."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / F.greatest(least, F.lit(1)).cast("double")).otherwise(equal.cast("double"))


def likeness(a: Column, b: Column, text: Column, other: Column, shingle: int = SHINGLE, scale: int = SCALE) -> Column:
    """Containment by the sketches a and b of two texts, or by all their shingles where either sketch is small."""
    if scale == 1:
        return containment(a, b, text == other)
    small = F.least(F.size(a), F.size(b)) < LEAST_KEPT
    exact = _let(sketch(text, shingle, 1), lambda x: _let(sketch(other, shingle, 1), lambda y: containment(x, y, text == other)))
    return F.when(small, exact).otherwise(containment(a, b, text == other))


def ranges(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text) with a range of doc_id, and the document that follows the last of each range.

    Documents follow each other by descending doc_id, the first after the last. As each range also gets the first document
    of the range after it, one shuffle and one window a range are enough to pair neighbours.
    """
    n = rows.count()
    cuts = min(RANGES, -(-n // RANGE_ROWS)) - 1
    found = rows.agg(F.percentile_approx("doc_id", [i / (cuts + 1) for i in range(1, cuts + 1)], 10 * (cuts + 1))).first()[0] if cuts > 0 else None
    bounds = sorted(set(found or []))
    coarse = bounds[255::256]
    below = lambda values: F.size(F.filter(values, lambda b: b < F.col("doc_id")))
    if bounds:
        whole = F.array(*[F.lit(b).cast("long") for b in bounds])
        step = below(F.array(*[F.lit(b).cast("long") for b in coarse])) if coarse else F.lit(0)
        bucket = _let(step, lambda s: s * 256 + below(F.slice(whole, s * 256 + 1, 256)))
    else:
        bucket = F.lit(0)
    placed = rows.select("doc_id", "text").withColumn("_range", bucket)
    key = F.struct(F.col("doc_id").isNull(), F.bitwise_not(F.col("doc_id")), F.col("text"))
    first = placed.groupBy("_range").agg(F.min(key).alias("k"))
    down = Window.orderBy(F.desc("_range"))
    lowest = F.min("_range").over(Window.partitionBy())
    first = first.select(F.coalesce(F.lag("_range").over(down), lowest).alias("_range"), F.bitwise_not(F.col("k")["col2"]).alias("doc_id"), F.col("k")["text"].alias("text"))
    return placed, first


def fingerprints(documents: DataFrame, shingle: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """doc_id, n_chars, fingerprint of each text, of its edited text, and the likeness of the first to the second and to the next document's."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    placed, first = ranges(rows)
    both = placed.withColumn("_extra", F.lit(0)).unionByName(first.withColumn("_extra", F.lit(1))).withColumn("f", sketch(F.col("text"), shingle, scale))
    after = Window.partitionBy("_range").orderBy("_extra", F.col("doc_id").desc_nulls_last(), "text")
    seen = both.withColumn("_n", F.lead(F.struct("text", "f")).over(after)).where("_extra = 0")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    seen = seen.select("doc_id", "text", "f", F.col("_n.text").alias("nt"), F.col("_n.f").alias("nf"), n.cast("long").alias("n_chars"), half.alias("half"))
    seen = seen.withColumn("edited", F.concat(F.expr("substring(text, 1, n_chars - half)"), F.expr("substring(nt, 1, half)")))
    seen = seen.withColumn("ef", sketch(F.col("edited"), shingle, scale))
    return seen.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        to_string(F.col("f")).alias("fingerprint"),
        to_string(F.col("ef")).alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("ef"), F.col("text"), F.col("edited"), shingle, scale).alias("near_edited"),
        likeness(F.col("f"), F.col("nf"), F.col("text"), F.col("nt"), shingle, scale).alias("near_next"),
    )
