"""Cleaning pipeline over `documents`: toxicity, language ID, near copies, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one reads it from Parquet. All
but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm import piece_bpe, signature_tree, subword_langid, toxic_channel, winnow_decontam
from freshet.llm.registry import tokenizer_file
from freshet.session import cut, prepare, read_table, spread


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; learned from all labels."""
    prepare(spark)
    docs = spread(docs)
    return toxic_channel.clean(docs, toxic_channel.train(docs, read_table(spark, sf_dir, "labels"), F.lit(True)))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go; learned from `lang`."""
    prepare(spark)
    docs = spread(docs)
    return subword_langid.recognised(docs, subword_langid.train(docs, F.lit(True)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of least doc_id stays."""
    prepare(spark)
    return signature_tree.one_of_each(spread(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    prepare(spark)
    return winnow_decontam.untouched(spread(docs), read_table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the text decoded from them."""
    prepare(spark)
    return piece_bpe.digests(spread(docs), tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", toxicity), ("language_id", language_id), ("near_copies", near_copies),
    ("decontamination", decontamination), ("sentencepiece", sentencepiece),
]

ORACLE_SQL = None  # trained models and tokenizers are beyond SQL; tests compare with plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each result but the last written as Parquet and reread."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
