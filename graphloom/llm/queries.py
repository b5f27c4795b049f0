"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, histpack, jaccard, langid, media, packing, phrases, quality, sql, substring, suffix, urls, whiten


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: The fixed rules of the URL query.
URL_RULES = tuple(
    urls.Rule.parse(x)
    for x in ("block com/en/", "allow example.com/en/7", "allow net/de/", "block example.net/de/8", "block org/es/")
)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read(spark, sf_dir, "documents"), *bpe.vocabulary())


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(read(spark, sf_dir, "documents"))


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_substrings(read(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), *bpe.vocabulary())


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(read(spark, sf_dir, "pages"), URL_RULES)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(read(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(read(spark, sf_dir, "conversations"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_links(read(spark, sf_dir, "documents"))


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup_bytes(read(spark, sf_dir, "documents"))


def op11_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = histpack.pack_texts(read(spark, sf_dir, "documents"), histpack.vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(read(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of ``corpus_pipeline.py`` at the top of the repository."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_bpe, op2_quality, op3_substring, op4_packing, op5_url_filters, op6_language, op7_media, op8_chat, op9_jaccard, op10_suffix,
        op11_histogram_packing, op12_collocations, op13_whitening, pipeline,
    )
}
ORACLE_SQL = {"op2_quality": sql.op2(), "op5_url_filters": sql.OP5, "op8_chat": sql.OP8, "op12_collocations": sql.OP12}
