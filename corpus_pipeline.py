"""A training-data pipeline of the operators in lodestack.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next one's docs. All but the last keep the columns of
documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import exact_dedup, langid, ngram_join, packing, quality
from lodestack.llm.common import in_thirds, materialise, table

#: Characters from which a text has to be above chance in some language.
SHORT = 100


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those in none of the languages learned: no prototype's cosine is above what chance gives.

    Texts of under ``SHORT`` characters hold too few trigrams to be told from
    chance, and stay if they have a letter. With nothing to learn from, all texts
    with a letter stay. An empty table stays empty.
    """
    prototypes = langid.fit(docs.where(in_thirds("doc_id", 3) != 1).select("doc_id", "text", "lang"))
    letters = F.col("text").rlike(r"\p{L}")
    if not prototypes:
        return docs.where(letters)
    guess = langid.predictor(prototypes)(F.col("text"))
    named = (guess["lang_pred"] != langid.UNKNOWN) & ((guess["score"] >= langid.CHANCE) | (F.length("text") < SHORT))
    return docs.where(named)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score below the limit. Learns from the labelled part of the whole documents table; without labels all stay."""
    labels = table(spark, sf_dir, "labels").where(in_thirds("doc_id", 4) != 2).select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(quality.sample_labelled(table(spark, sf_dir, "documents"), labels))
    if not len(model.labels):
        return docs
    return docs.where(quality.scorer(model)(F.col("text")) >= quality.GOOD)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of equal texts."""
    return exact_dedup.drop_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of linked documents."""
    return ngram_join.drop_near_copies(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_duplicates),
    ("ngram_jaccard_join", near_duplicates),
    ("best_fit_packing", packed_sequences),
]

#: Classifiers and packing aren't SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
