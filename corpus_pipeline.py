"""From raw documents to packed sequences: five stages, each of which reads what the one before kept.

Defined cases: verdicts and groups are of rows, told apart by a hash of all their columns, so rows without
id or with a shared id stand for themselves, and equal rows share their fate; a NULL or blank text fails the
quality rules; a NULL language is a language of its own; without labels of both kinds the classifier
keeps what it decides without one; texts are whole, however long; an empty table passes through as an empty table; other columns may
have any names and are kept up to the last stage.  Columns of maps have no hash and are refused.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitcal.llm import cotrain, near_copies, packing, perplexity, recompress
from unitcal.session import stage


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that the documents do not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_key(docs: DataFrame) -> DataFrame:
    """The documents' text and language with the hash of the row in place of the id."""
    columns = [c for c in ("text", "lang", "source", "n_chars") if c in docs.columns]
    return docs.select(near_copies.row_key(docs).alias("doc_id"), *columns)


def of_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose hash is in the only column of ``keys``."""
    name = fresh(docs, "row_key")
    return docs.join(keys.toDF(name), near_copies.row_key(docs) == F.col(name), "left_semi")


def of_kept(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows of ``docs`` that a verdict per row keeps; ids do not matter, equal rows have one verdict."""
    return of_rows(docs, stage(verdicts.filter("kept").select("doc_id").distinct()))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the counts and whose perplexity is inside their language's band."""
    return of_kept(docs, perplexity.quality_rules(with_key(docs)))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the two co-trained views accept."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return of_kept(docs, cotrain.classify(docs, labels, near_copies.row_key(docs)))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the smallest id (NULL comes last), then of the smallest row hash."""
    groups = near_copies.near_copies(docs)
    first = F.min(F.struct(F.isnull("doc_id"), "doc_id", "row_key"))
    keep = stage(groups.groupBy("root").agg(first.alias("first")).select("first.row_key"))
    return of_rows(docs, keep).dropDuplicates()


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller id has too."""
    cut = recompress.remove_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in sequences of 2048."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("simhash_dedup", simhash_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", pack),
]

#: Neither the fitted models nor the tokenizer have an SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = step(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stage(docs)
    return docs
