"""One query per text operator, over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from busline.llm.common import read_table
from busline.llm.twins import clusters_sql, resample_sql, top_products_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TOKENIZERS = "/opt/tokenizers"  # folder of the public vocabulary files


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def vocabulary(name: str) -> str:
    """Place of a vocabulary file on the executors."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return f"{TOKENIZERS}/{name}"


@query("op3_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from busline.llm.bpe import bpe_columns

    return bpe_columns(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query("op7_warc")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from busline.llm.warc import read_archives, with_revisits, write_archives

    return read_archives(spark, write_archives(with_revisits(read_table(spark, sf_dir, "pages"))))


@query("op9_token_store")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from busline.llm.token_store import crc_of_ids, look_up, read_documents, write_store

    docs = read_table(spark, sf_dir, "documents")
    store = write_store(docs, vocabulary("byte_bpe_50k.json"))
    written = spark.read.parquet(f"{store.folder}/written").select("key", "copy")
    rows = read_documents(store, look_up(store, written), "ids_crc32 long", crc_of_ids(store.width))
    return rows.select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


@query("op10_secrets")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from busline.llm.secret_scan import scan, span_digest, train

    docs = read_table(spark, sf_dir, "documents")
    return span_digest(scan(docs, train(docs)))


@query("op4_html_text")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from busline.llm.html_text import main_text

    return main_text(read_table(spark, sf_dir, "pages"))


@query("op6_order_minhash")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from busline.llm.order_minhash import edited_fingerprints

    return edited_fingerprints(read_table(spark, sf_dir, "documents"))


@query("op5_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from busline.llm.quality import classify

    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op2_line_templates")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from busline.llm.line_templates import drop_recurring

    return drop_recurring(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op8_ngram_join")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from busline.llm.ngram_join import linked

    return linked(read_table(spark, sf_dir, "documents")).drop("text_hash", "component")


@query("op1_decontaminate")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from busline.llm.decontaminate import leaks

    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("a", "b")


@query("op11_simplex_clusters", clusters_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from busline.llm.simplex_clusters import clusters

    return clusters(read_table(spark, sf_dir, "embeddings"))


@query("op12_voronoi_join", top_products_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from busline.llm.voronoi_join import top_products

    return top_products(read_table(spark, sf_dir, "embeddings"))


@query("op13_crc_resampling", resample_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from busline.llm.crc_resampling import resample

    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
