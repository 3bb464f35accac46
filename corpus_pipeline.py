"""The corpus pipeline: five stages from raw documents to encoded training texts.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm import bpe, jaccard, mixing, pii, quality_model


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled ones among them."""
    return quality_model.keep_good(docs, quality_model.fit(docs, quality_model.training_labels(spark, sf_dir)))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, Jaccard 0.8 or more, the least id stays."""
    return jaccard.keep_one(docs, size=5, num=80, den=100)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates; n_chars follows the new text."""
    done = pii.pseudonymise(docs).drop("n_entities")
    return done.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(docs.columns) if "n_chars" in docs.columns else done


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks."""
    return mixing.mix_sources(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts, one row for each copy in the mix."""
    return bpe.round_trip_digest(docs, bpe.vocabulary())


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram jaccard join", one_of_each),
    ("pii surrogates", surrogates),
    ("mixing sources", mixed),
    ("bpe", encoded),
]

#: Learned scores and keyed surrogates are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
