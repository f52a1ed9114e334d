"""The corpus pipeline: five stages from documents to packed training sequences.

Each stage calls one operator of ``lodestrata.llm`` and works on all that the
stage before it kept. A stage's function takes (spark, docs, sf_dir); all but
the last return the columns of documents. ``run`` writes each stage's result as
Parquet into the session's shared folder and hands it on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import decontam, packing, pii, quality_rules, simhash
from lodestrata.llm.common import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned decision list rejects go.

    A null or empty text fails the base rule; repeated rows have one fate; without
    labels the base rule alone decides. All columns stay.
    """
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.apply_rules(docs, rules).where("quality.kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays.

    Documents are near from a Jaccard similarity of 0.8 in five-word shingles on.
    Twelve fingerprints of two-word shingles find the candidates: of pairs from
    0.85 on they find all that were measured, of pairs from 0.8 on 98 in 100. The
    candidates' own shingle sets decide. Equal rows become one; texts without words
    are alike; rows with a null id all stay.
    """
    return simhash.one_similar_of_each(docs, similarity=0.8, shingle=5, width=2, count=12)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; rows with a null id or text stay, repeated rows have one fate, and without a benchmark nothing goes."""
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; no document goes, repeated rows stay, and a null text stays null."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens, every source in its share; repeated rows are packed as often as they come, a null source is one more."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("personal data", private_data),
    ("packing", pack),
]

#: Learned rules, fingerprints and token ids have no SQL; tests compare stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{i}")
    return docs
