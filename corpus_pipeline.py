"""The corpus pipeline: documents through quality rules, near-duplicate removal, decontamination, pseudonyms and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it keeps is written as Parquet into the shared folder
and read again by the next one, so that a lost executor costs no more than the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forecourt.llm import decontamination, packing, pii, quality, simhash
from forecourt.llm.common import materialize, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest doc_id."""
    return simhash.keep_one(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def pseudonymous(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts turns into pseudonyms of the same format; n_chars counts the new text. The session's key, or a random one."""
    new = pii.pseudonymize(docs, pii.session_key(spark))
    return new.select(*[F.length("text").cast(kind).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c, kind in docs.dtypes])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, their ids and their places in the training sequences."""
    return packing.pack(docs, keep_ids=True)


STAGES = [("quality_rules", good), ("simhash", unique), ("decontamination", uncontaminated), ("pii_pseudonyms", pseudonymous), ("best_fit_packing", packed)]

#: Fingerprint components, BM25 search, keyed permutations and packing have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
