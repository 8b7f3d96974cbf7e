"""Corpus pipeline: language ID, toxicity, near duplicates, repeated passages, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a frame, which run() writes to the
shared folder and reads again as the next one's docs. All stages but the last return the columns of `documents`.

Nulls and edge cases: documents without text or letters are rejected by the first stage; rows with a null doc_id are
nobody's duplicate and go through every stage; rows that repeat a doc_id after the first stages count as one group, of
which one stays; other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofkit.llm import language_id, ngram_jaccard, packing, substring_dedup, toxicity
from asofkit.llm.common import keep_ids, materialize, small_batches, table
from asofkit.llm.language_id import held_out
from asofkit.llm.parameters import bpe_json, split_pattern, unigram_vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least posterior of the predicted language; clean documents of any learned language lie far above it.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the model knows; those without letters or of undecided language go."""
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    model = language_id.train(docs.where(~held_out()).select("doc_id", "text", "lang"), unigram_vocabulary())
    known = language_id.identify(docs, model)
    return known.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted to be toxic."""
    small_batches(spark)
    labels = table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", F.col("toxic").alias("label"))
    return toxicity.score(docs.select(*COLUMNS), toxicity.train(docs, labels)).where("predicted = 0").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of smallest doc_id, of each group linked by n-gram Jaccard."""
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    linked = materialize(ngram_jaccard.link_documents(docs), "linked")
    kept = keep_ids(docs, linked.where("doc_id <> component_id").select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)
    again = linked.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not again.limit(1).count():
        return kept
    once = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("r")).select("doc_id", "r.*")
    return kept.join(again, "doc_id", "left_anti").select(*COLUMNS).unionByName(once)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one holds; a document all of whose words go is dropped."""
    small_batches(spark)
    cut = substring_dedup.remove_repeats(docs.select(*COLUMNS)).where("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return cut.withColumns({"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars"))}).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of the documents in sequences of at most 2048 tokens."""
    small_batches(spark)
    path, pattern = bpe_json(), split_pattern()
    return packing.pack(packing.pieces(docs, lambda: packing.Encoder(path, pattern)), docs.select("doc_id").count())


STAGES = [
    ("language_id", language),
    ("toxicity", toxic),
    ("ngram_jaccard", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: None of the stages can be said in SQL (models, tokenizers, components); the tests hold run() against a brute-force version.
ORACLE_SQL = None
