"""From raw documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``. The first four return the
columns of ``documents``; the last returns ids.

Rows with null texts pass as empty texts; columns beyond those of ``documents``
pass through untouched; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from busline.llm import bpe, decontaminate, line_templates, ngram_join, quality
from busline.llm.common import discard, landed, read_table
from busline.llm.queries import vocabulary


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a score of 0.5 and more; scores come from the text alone."""
    labels = read_table(spark, sf_dir, "labels")
    known = landed(quality.with_features(docs, keep=["doc_id"]), "pipeline-features")
    ranker = quality.train_all(known, labels)
    discard(known)
    # features again, rather than the texts written with them
    scored = quality.score_texts(docs, ranker, names=("__score", "__predicted"))
    return scored.filter("__predicted = 1").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines whose template recurs; n_chars follows the text."""
    kept = line_templates.drop_recurring(docs, lines="__n_lines", dropped="__n_dropped")
    chars = F.when(F.col("__n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", chars).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of linked ones: that with the smallest doc_id, then text hash.

    Documents without words are kept. A document without an id goes if its group has one with an id.
    """
    rows = landed(ngram_join.linked(docs), "stage-links")
    size = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    first = rows.filter("n_shingles > 0").groupBy("component").agg(F.min(size).alias("first"))
    keep = first.select(F.xxhash64("first.doc_id").alias("__a"), F.col("first.text_hash").alias("__b"))
    alone = rows.filter("n_shingles = 0").select(F.xxhash64("doc_id").alias("__a"), F.col("text_hash").alias("__b"))
    named = docs.withColumn("__a", F.xxhash64("doc_id")).withColumn("__b", F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = named.join(keep.unionByName(alone).distinct(), ["__a", "__b"], "left_semi")
    if rows.filter("n_shingles > 0").groupBy("doc_id", "text_hash").count().filter("count > 1").limit(1).count():
        with_words = kept.join(keep, ["__a", "__b"], "left_semi").dropDuplicates(["__a", "__b"])  # rows that repeat both
        kept = kept.join(keep, ["__a", "__b"], "left_anti").unionByName(with_words)
    return kept.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontaminate.without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with digests of ids and decoded text."""
    return bpe.bpe_columns(docs, vocabulary("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", encoding),
]

# Scores, hashed shingles and ids have no SQL form; tests/llm compares run() with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = landed(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return docs
