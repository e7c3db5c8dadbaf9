"""A corpus pipeline: rules, exact copies, near copies, the mix, and packed sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all
that the stage before kept. All but the last return the columns of documents, and
any further columns that docs has, whatever their names.

Defined cases: a null text counts as empty, and the rules reject it with all texts
under twenty words; null ids stay and come after all others where the least id
decides; of rows alike in id and text one stays; of equal or linked texts the least
id stays, of equal ids the least text; rows alike are mixed and packed alike but as
rows of their own; texts of any length are taken whole; an empty table gives an
empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernel.llm import exact_dedup, jaccard_join, mixing, packing, quality_rules
from quernel.llm.common import stage, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, whole."""
    return quality_rules.keep(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts, the one with the least id."""
    return exact_dedup.drop_repeats(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word shingles (0.8 or more) join, the one with the least id."""
    return jaccard_join.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mix's documents in sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [("quality rules", rules), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing", mixed), ("best-fit packing", packed)]

#: Tokenizing can't be said in SQL; tests hold the rows against a version in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{k}")
    return docs
