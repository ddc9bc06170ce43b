"""The corpus pipeline: quality, near duplicates, mixture, token ids.  Counted as part of ``llm``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelgov.llm import byte_bpe, hash_mixture, ngram_rtree_join, quality_rff
from modelgov.llm.queries import THRESHOLD, VOCABULARY, table
from modelgov.llm.work import Work


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels of the documents it is given.

    Null and empty texts are scored like any other, equal rows alike; an empty table stays empty.  Rows travel whole
    beside their score, so no column of theirs is touched, whatever its name.
    """
    labels = table(spark, sf_dir, "labels")
    model = quality_rff.fit(docs, quality_rff.training_rows(labels, ~quality_rff.held_out()))
    rows = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), F.col("text").alias("text"))
    return quality_rff.score(rows, model, into="score").where(F.col("score") >= THRESHOLD).select("row.*")


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates, the document of the smallest id stays.

    Documents without words all stay, null texts included; of rows equal in id and text one stays; an empty table stays empty.
    """
    return ngram_rtree_join.kept_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their target weights: a document stays as often as the mix takes it, up to three times.

    Null sources are a source of their own; documents without words are taken as their place in the mix says; an empty
    table stays empty; columns are unchanged.
    """
    return hash_mixture.materialise_mix(docs)


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document left, checked by decoding them; null and empty texts have none; equal rows stay rows."""
    return byte_bpe.round_trip(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode_and_decode),
]

#: SQL can express neither the classifier nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    work = Work(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    previous = None
    for _, stage in STAGES:
        done = work.keep(stage(spark, docs, sf_dir))
        if previous is not None:
            work.drop(previous)
        docs = previous = done
    return docs
