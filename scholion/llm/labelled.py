"""Bounded samples of labelled rows, for the operators that learn from labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows of either class that a model is fitted on, at most.
PER_CLASS = 2048


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def sampled_texts(docs: DataFrame, labels: DataFrame, label: str, *, id_col: str = "doc_id", text_col: str = "text", folds: int, held_out: int, per_class: int = PER_CLASS) -> tuple[DataFrame, dict[int, int]]:
    """(id, ``label``, ``text``) of at most ``per_class`` labelled documents of each class, and the counts of labelled ids by class.

    Rows whose fold is ``held_out`` are left out, as are null ids and labels other than 0 and 1; an
    id that is labelled twice counts with its larger label, and a repeated document once. The
    sample is the rows of least hash, so it doesn't depend on order. Counts cover all labelled rows.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("id").isNotNull())
    known = known.filter(fold("id", folds) != held_out).groupBy("id").agg(F.max("label").alias("label"))
    counts = {x["label"]: x["count"] for x in known.groupBy("label").count().collect()}
    chosen = [known.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(per_class) for k in (0, 1)]
    chosen = F.broadcast(chosen[0].union(chosen[1]))  # no more than twice per_class rows
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(chosen, "id")
    return texts.groupBy("id").agg(F.first("label").alias("label"), F.min("text").alias("text")), counts
