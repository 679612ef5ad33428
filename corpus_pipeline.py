"""From raw documents to training sequences, in five stages.

Each stage takes all that the one before it kept and applies its operator's decisions: documents
that the quality classifier rejects go; one document of each near-duplicate group stays; documents
that hold benchmark windows go; personal data is replaced; what is left is packed. Between stages
the documents are written as Parquet to the shared folder and read back, which bounds what a lost
executor costs.

Stages keep the columns of the documents they get, the last excepted, and pass rows with nulls on:
see each operator for what it makes of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.llm.common import discard, materialize, scratch_tables, table
from scholion.llm.decontaminate import drop_contaminated
from scholion.llm.packing import pack_documents
from scholion.llm.pii import pseudonymise
from scholion.llm.quality import THRESHOLD, fit_quality, score_texts
from scholion.llm.simhash import drop_near_duplicates

#: Fingerprint tables of the near-duplicate stage. README has how many copies of which similarity they find.
TABLES = 4
#: A stage has no SQL equivalent where it learns or tokenizes; tests hold the stages against plain versions.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that score at the classifier's threshold or above."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    columns = docs.columns
    scored = score_texts(docs.withColumnsRenamed({x: f"_{k}" for k, x in enumerate(columns)}), model, text_col=f"_{columns.index('text')}")
    kept = scored.filter(F.col("score") >= THRESHOLD).drop("score")
    return kept.withColumnsRenamed({f"_{k}": x for k, x in enumerate(columns)})


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id in each group of near duplicates, by shingles of five words and several tables of fingerprints."""
    return drop_near_duplicates(docs, words=5, tables=TABLES)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in which no benchmark window occurs."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in all documents; their lengths follow."""
    out = pseudonymise(docs).drop("pii")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences: one row for each piece."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("privacy", privacy),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        known = {x.scratch_path for x in scratch_tables()}
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(before, *(x for x in scratch_tables() if x.scratch_path not in known and x is not docs))
    return STAGES[-1][1](spark, docs, sf_dir)
