"""The registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import html, jaccard, maglev, mixing, neardup, oracles, quality, toxicity, viterbi, warc, wavelet


def op1_wavelet_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.stored(C.table(spark, sf_dir, "documents"))


def op2_text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(C.table(spark, sf_dir, "pages"))


def op3_permutation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maglev.place(C.table(spark, sf_dir, "documents"), "doc_id")


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(C.table(spark, sf_dir, "pages"))


def op5_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.verdicts(C.table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 6) for c in ("class_distance", "common_distance")})


def op6_hash_threshold_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(C.table(spark, sf_dir, "documents"))


def op7_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.train(docs, C.table(spark, sf_dir, "labels")))


def op8_pca_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.duplicates(C.table(spark, sf_dir, "embeddings"))


def op9_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(C.table(spark, sf_dir, "documents"))


def op10_streaming_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi.encoded(C.table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_wavelet_matrix,
        op2_text_blocks,
        op3_permutation_table,
        op4_warc_derivatives,
        op5_distribution_divergence,
        op6_hash_threshold_mixing,
        op7_classifier_chain,
        op8_pca_tiles,
        op9_chosen_path_join,
        op10_streaming_viterbi,
    )
}
ORACLE_SQL = oracles.ORACLE_SQL
