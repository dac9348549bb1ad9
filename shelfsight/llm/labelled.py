"""Labelled documents for training, and the split that keeps a fifth of them out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that training never sees: crc32 of the id as text is a multiple of FOLDS. False without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, column: str, bound: int) -> DataFrame:
    """(doc_id, text, label) for at most ``bound`` labelled ids that are not held out, those of least hash.

    An id with several labels counts as 1 if their mean is at least a half; rows without id or label are left
    out. Of several documents of one id the one whose text has the least hash stands, so the bound is on rows too.
    """
    usable = labels.select(F.col("doc_id").cast("long"), F.col(column).alias("label")).where(
        "doc_id IS NOT NULL AND label IS NOT NULL"
    ).where(~held_out())
    one = usable.groupBy("doc_id").agg(F.when(F.avg("label") >= 0.5, 1).otherwise(0).alias("label"))
    few = one.orderBy(F.xxhash64("doc_id", F.lit(column)), "doc_id").limit(bound)
    given = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    one_text = F.min_by(F.struct("text", "label"), F.xxhash64("text"))
    found = given.join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(one_text.alias("of"))
    return found.select("doc_id", "of.text", "of.label")
