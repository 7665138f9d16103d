"""A training-corpus pipeline over ``documents``: a list of stages, each one operator of rillstone.llm.

Documents that the quality classifier rejects go; of each group of near duplicates one document stays;
secrets are replaced in the texts; what is left is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.llm import near_dedup, packing, quality, secrets
from rillstone.llm.common import read, stage


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the classifier does not reject; labels are those of ``labels``."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (shingles of five words, similarity 0.8) the row with the smallest doc_id."""
    return near_dedup.keep_one(docs, percent=80)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets in texts replaced and n_chars counted anew."""
    hidden = secrets.redact(docs)
    return hidden.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else hidden


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's pieces and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("near duplicates", keep_one_of_each_group),
    ("secret scans", hide_secrets),
    ("best-fit packing", pack),
]

#: The classifier, signatures and the packing have no SQL form; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to ``documents``, each over the written rows of the one before."""
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
