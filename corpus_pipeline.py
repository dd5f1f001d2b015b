"""The corpus pipeline: stages over the table documents, each written as Parquet and read again by the next.

Cases: null or empty text: no toxic words, then too short for the quality rules, so it goes there; null lang or source: the base
rules alone, a source of its own in the mix; null doc_id: no near copy of anything, all else as for other rows; rows that share doc_id
and text: one of them stays in the join, told by a hash of all columns; rows that share doc_id only: each is a document of its own;
ties (equal hashes in the mix): broken as mixing.py says; very long texts: whole, in every stage; empty table: no rows; more columns,
whatever their names: all stages but the last pass them on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import common as C
from corvane.llm import jaccard, mixing, quality, toxicity, viterbi


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no category of the classifier chain rejects."""
    return toxicity.keep(docs, toxicity.train(docs, C.table(spark, sf_dir, "labels")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and their language's histograms keep."""
    return quality.keep(docs)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the least doc_id."""
    return jaccard.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as its source's target asks for."""
    return mixing.take(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document of the mix, checked by decoding them."""
    return viterbi.encoded(docs, with_ids=True)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality rules", quality_stage),
    ("n-gram jaccard join", jaccard_stage),
    ("mixing sources", mixing_stage),
    ("sentencepiece encoding", encoding_stage),
]
#: The toxicity stage learns its model, which SQL can't express; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = C.cut(docs, name.replace(" ", "-"))
    return docs
