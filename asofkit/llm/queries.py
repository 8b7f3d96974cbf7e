"""Queries of the corpus operators over the whole tables, and SQL for those that SQL can say."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofkit.llm import ann, bpe, fingerprint, language_id, masked_lm, ngram_jaccard, packing, substring_dedup, toxicity, url_rules
from asofkit.llm.common import small_batches, table
from asofkit.llm.language_id import held_out
from asofkit.llm.parameters import bpe_json, bpe_ranks, split_pattern, unigram_vocabulary

#: (verdict, rule) by which urls are judged before the mined rules.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~held_out()).select("doc_id", "text", "lang"), unigram_vocabulary())
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.link_documents(table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", F.col("toxic").alias("label"))
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted", "evidence")


def op5_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return masked_lm.score(docs, masked_lm.train(docs))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op7_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0, k=5)


def op8_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path, pattern = bpe_json(), split_pattern()
    return packing.pack(packing.pieces(docs, lambda: packing.Encoder(path, pattern)), docs.select("doc_id").count())


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, 500)
    return bpe.digest(bpe.encode(table(spark, sf_dir, "documents"), bpe_ranks(), split_pattern()))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))


def _lean(f):
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return f(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: _lean(f)
    for f in (op1_language_id, op2_ngram_jaccard, op3_fingerprints, op4_toxicity, op5_masked_lm, op6_url_rules, op7_cross_polytope, op8_best_two_fit, op9_byte_bpe, op10_substring_dedup)
}

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

#: SQL by query. The others rest on models, tokenizers, sketches or a search that is not exhaustive; tests/llm holds each
#: against a brute-force version, an exact round trip or held-out accuracy.
ORACLE: dict[str, str] = {
    "op2_ngram_jaccard": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT doc_id, list_sort(CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS o FROM x a JOIN x b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM p WHERE 100 * o >= 75 * (na + nb - o)),
r AS (SELECT doc_id AS node, doc_id AS root FROM s UNION SELECT e.b, r.root FROM r JOIN e ON r.node = e.a),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY ALL)
SELECT doc_id, len(g) AS n_shingles, component_id, CASE WHEN len(g) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY g) END AS copy_of FROM s JOIN c ON node = doc_id""",
    "op10_substring_dedup": f"""WITH w AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w),
k AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 12], ' ')) AS h FROM i),
f AS (SELECT h, min(doc_id) AS f FROM k GROUP BY ALL),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM k JOIN f USING (h) WHERE doc_id > f),
g AS (SELECT doc_id, list(p) AS ps FROM c GROUP BY ALL)
SELECT w.doc_id, len(ws) AS n_words, coalesce(len(ps), 0) AS n_removed, sha256(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, j: NOT list_contains(ps, j)) END, ' ')) AS kept_sha256 FROM w LEFT JOIN g USING (doc_id)""",
}
