"""From raw documents to packed training sequences, in five stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame that works on all that the stage
before it kept; between stages the documents are written as Parquet and read again.  All
stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, groups, jaccard, langid, packing, quality, suffix
from graphloom.llm.store import materialize


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which no language is found (no text, or no letter), also where no label can be learned from.

    Null and empty texts go; rows of null or repeated ids are judged one by one; an empty table
    stays empty; a text of any length is judged whole; all columns come along, whatever their names.
    """
    models = langid.train(docs, F.coalesce(langid.fold() != 0, F.lit(False)))
    if not models:
        return docs.where(langid.lettered())
    return langid.predict(docs, models, carry=True).where(F.col("lang_pred") != langid.UNKNOWN).select("row.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality rules reject.

    Null, empty and short texts fail the base rules and go; rows of null or repeated ids are
    judged one by one; an empty table stays empty; a text of any length is judged whole; all
    columns come along, whatever their names.
    """
    return quality.quality_rules(docs, carry=True).where("kept").select("row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least id of each group of linked documents, one row of it.

    A document is an id with a text: rows of a null or repeated id stay if their texts are not
    linked, and of equal rows one stays, any of them; texts without words are linked with nothing,
    so each null or empty one stays, once an id.  The least id decides, a null id first, then the
    least text digest.  An empty table stays empty; all columns come along, whatever their names.
    """
    rows = jaccard.linked_rows(docs).groupBy("id", "text_md5").agg(F.count("*").alias("copies"), F.min("vertex").alias("vertex"))
    kept = rows.groupBy("vertex").agg(F.min(F.struct("id", "text_md5", "copies")).alias("least")).select("least.*")
    kept = materialize(kept.select(F.col("id").alias("kept_id"), F.col("text_md5").alias("kept_md5"), "copies"), "kept")
    own = [F.coalesce(F.col("doc_id").cast("long"), F.lit(int(groups.NULL_ID))), F.md5(F.coalesce("text", F.lit("")).cast("binary"))]
    same = (own[0] == F.col("kept_id")) & (own[1] == F.col("kept_md5"))
    # the kept ids grow with the corpus, so they are never broadcast, however small they are here
    once = docs.join(kept.where("copies = 1").hint("merge"), same, "left_semi")
    again = kept.where("copies > 1")
    if again.isEmpty():
        return once
    several = docs.join(again, same, "left_semi").withColumn("kept_md5", own[1]).dropDuplicates(["doc_id", "kept_md5"])
    return once.unionByName(several.select(*docs.columns))


def shared_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut from each text the 50-byte strings that a document of smaller id has; characters stay whole.

    ``text`` is what is left and ``n_chars`` its length; a null text becomes empty; a null id is
    the smallest; rows of one id do not cut each other; an empty table stays empty; a text of any
    length is cut as a whole; all other columns come along, whatever their names.
    """
    cut = suffix.dedup_bytes(docs, keep_text=True, carry=True)
    made = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return cut.select(*(made[c].alias(c) if c in made else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode what is left and pack the tokens into sequences.

    Texts without a token are in no sequence; rows of null or repeated ids are packed one by one;
    an empty table gives no sequence; a text of any length is packed in pieces; other columns,
    whatever their names, are ignored.
    """
    return packing.pack_documents(docs, *bpe.vocabulary())


STAGES = [
    ("language", language_stage),
    ("quality", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("shared passages", shared_passage_stage),
    ("packing", packing_stage),
]

#: Languages, near-duplicate components and packing are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
