"""The corpus pipeline: five training-data operators in a row, each on all that the one before kept.

Null and empty texts, and null ids, pass all stages: they have no toxic words, lines, shingles or benchmark words, and
encode to no tokens. Of ties and repeated rows the near-duplicate stage keeps one; those without a word all stay. Very
long texts are taken whole. Extra columns, of any name, are kept up to the last stage. An empty table gives an empty one.
A model that has no toxic label to learn from rejects nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from splatframe.llm import bpe, decontaminate, linededup, neardup, toxicity
from splatframe.llm.common import Scratch, saved, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as toxic by a model of the labelled documents among docs."""
    return toxicity.reject(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of line runs of 50 words or more, and documents of which nothing is left."""
    return linededup.remove(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near copies."""
    return neardup.representatives(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out of texts, and drops documents that are mostly such passages."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and decoded texts, with their digests."""
    return bpe.encode(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("BPE encoding and decoding", encoded),
]

#: Training by numpy, MinHash banding and BPE aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Tables between stages are deleted when it is written."""
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        for k, (name, stage) in enumerate(STAGES):
            keep = saved if k == len(STAGES) - 1 else scratch.saved
            docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs
