"""From documents to packed training sequences: five stages, each written and read again.

STAGES lists (name, function). A function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfsight.llm.decontamination import decontaminated
from shelfsight.llm.packing import packed
from shelfsight.llm.quality_rules import quality_rules
from shelfsight.llm.secrets import masked
from shelfsight.llm.superminhash import near_duplicate_groups
from shelfsight.workspace import written

#: Near copies of the stage: five words, and this percentage of shared shingles.
SIMILAR_PERCENT = 80


def _as_rows(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` whole, as ``row``, with its id and text hash: no column of it clashes with those of a stage."""
    return docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"),
        F.xxhash64("text").alias("hash"),
    )


def _unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*(F.col("row").getField(c).alias(c) for c in columns))


def _chosen(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Those of _as_rows() whose id and text hash have a row in ``verdicts`` (doc_id, text_hash)."""
    keys = verdicts.select(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash")).distinct()
    return rows.join(keys, F.expr("id <=> of_id AND hash = of_hash"), "left_semi")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. A null, empty or blank text fails them and goes; of repeated rows all stay
    or go; other columns pass as they are. No rows give no rows."""
    return _unpacked(_chosen(_as_rows(docs), quality_rules(docs).where("kept")), docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one of least doc_id, ids before nulls, then of least text hash.
    Of equal rows of that id and text one stays. Texts without words are in no group; they keep one row per id."""
    # A second reading of the verdicts would group once more.
    groups = written(near_duplicate_groups(docs, SIMILAR_PERCENT), "pipeline-groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
    heads = groups.where("comp IS NOT NULL").groupBy("comp").agg(first).select("first.doc_id", "first.text_hash")
    kept = _chosen(_as_rows(docs), heads.union(groups.where("comp IS NULL").select("doc_id", "text_hash")))
    one = Window.partitionBy("id", "hash").orderBy(F.xxhash64("row"))
    return _unpacked(kept.withColumn("n", F.row_number().over(one)).where("n = 1"), docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item. A null, empty or blank text has none and stays, as do all of
    repeated rows; without items everything stays."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _unpacked(_chosen(_as_rows(docs), decontaminated(docs, items).where("NOT contaminated")), docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked in their texts; n_chars follows the text. Null and empty texts stay as they are."""
    clean = masked(docs)
    if "n_chars" in docs.columns:
        length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        clean = clean.withColumn("n_chars", F.coalesce(length, "n_chars")).select(*docs.columns)
    return clean


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A bin and offset for every word of every document; null, empty and repeated texts are as packed() states."""
    return packed(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: Markov scores and best-fit order have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
