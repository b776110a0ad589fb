"""Cleaning pipeline over ``documents``.

Each stage calls one operator on all that the stage before kept; its output is
written as Parquet and reread as the next one's input.  The first four return
the columns of ``documents``, the last the encoded documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from servicepulse.llm import decontaminate, near_dup, pieces, pii, quality
from servicepulse.llm.common import id_fold, read
from servicepulse.llm.queries import tokenizer_path
from servicepulse.session import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the quality model scores below 0.3; texts without words score 0 and go too."""
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    gam = quality.train(docs, labels, id_fold(F.col("doc_id"), 5) != 0)
    return quality.score(docs, gam, *docs.columns, name="__quality").where(F.col("__quality") >= 0.3).select(*docs.columns)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five-word shingles, 0.8): the one with the smallest id."""
    gone = near_dup.near_duplicates(docs, shingle=5, percent=80).where("not kept")
    return docs.join(gone.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold a benchmark item (five-word shingles, 0.8)."""
    return decontaminate.without_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind; n_chars follows the text."""
    out = pii.mask_documents(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the cleaned texts."""
    return pieces.encode(docs, tokenizer_path(), "doc_id")


STAGES = [
    ("quality", quality_stage),
    ("near_dup", near_dup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: The stages learn a model, verify fingerprints and encode pieces: not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole ``documents`` table."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
