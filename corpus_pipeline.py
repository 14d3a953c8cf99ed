"""From documents to packed training sequences: toxic and poor documents go, one document of each group of near copies
stays, and what is left is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabulon.llm import quality, toxicity
from tabulon.llm.common import stage, table
from tabulon.llm.ngram_join import one_of_each
from tabulon.llm.packing import pack_matched
from tabulon.llm.queries import tokenizer
from tabulon.session import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the noisy-or model scores 0.5 or more go; it learns from labelled documents of this stage's input."""
    ship(spark)
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained views score under 0.5 go."""
    ship(spark)
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more of their five-word shingles, the one with the least doc_id stays."""
    ship(spark)
    return one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return pack_matched(docs, tokenizer("byte_bpe_50k.json"), 1024, 2)


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near copies", drop_near_copies), ("packing", pack)]
#: Trained models and tokenizers have no SQL; the tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
