"""The training-data pipeline over `documents`: toxicity, exact dedup, n-gram join, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns rows with the columns of its docs (the last one, pieces of
sequences). Stages handle null texts and sources, empty tables and repeated rows as their operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ontoloom.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from ontoloom.llm.common import table, written


#: Near copies: shingles of five words, a similarity of 0.8.
NEAR = ngram_join.Rule(words=5, num=80)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.one_of_each(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs, NEAR)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.taken(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("ngram_join", drop_near_copies), ("mixing", mix_sources), ("packing", pack)]

#: Learned scores, tilts and tokenizer ids have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
