"""The operators over the tables they are meant for, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from shelfsight.llm.cap_filters import near_vectors
from shelfsight.llm.conversations import repaired_conversations
from shelfsight.llm.decontamination import decontaminated
from shelfsight.llm.hard_negatives import hard_negatives
from shelfsight.llm.licences import licence_scan
from shelfsight.llm.packing import packed
from shelfsight.llm.quality_knn import quality_scores
from shelfsight.llm.quality_rules import quality_rules
from shelfsight.llm.secrets import secret_scan
from shelfsight.llm.statements import ORACLES
from shelfsight.llm.suffix_dedup import without_repeats
from shelfsight.llm.superminhash import near_duplicates
from shelfsight.llm.token_files import token_index
from shelfsight.llm.toxicity import toxicity

__all__ = ["ORACLES", "QUERIES"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def op1_induced_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir))


def op2_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))


def op3_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(documents(spark, sf_dir))


def op4_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(documents(spark, sf_dir))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op5_counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op6_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminated(documents(spark, sf_dir), benchmark(spark, sf_dir)).drop("text_hash")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), labels(spark, sf_dir))


def op8_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).drop("text_hash")


def op9_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_index(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op10_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).drop("text_hash")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op11_angular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(embeddings(spark, sf_dir))


def op12_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(embeddings(spark, sf_dir))


QUERIES = {
    "op1_induced_suffixes": op1_induced_suffixes,
    "op2_best_fit": op2_best_fit,
    "op3_paragraphs": op3_paragraphs,
    "op4_markov": op4_markov,
    "op5_counterfactual": op5_counterfactual,
    "op6_prefix_join": op6_prefix_join,
    "op7_neighbours": op7_neighbours,
    "op8_divergence": op8_divergence,
    "op9_wavelet": op9_wavelet,
    "op10_superminhash": op10_superminhash,
    "op11_angular": op11_angular,
    "op12_agenda": op12_agenda,
    "op13_cap_filters": op13_cap_filters,
    "pipeline": corpus_pipeline.run,
}
