"""From raw documents to packed training sequences, stage by stage.

Each stage takes what its predecessor kept and is written before the next one reads it,
so a lost executor costs a task and a failed stage costs that stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomsift.llm.common import documents, vocabulary, written
from loomsift.llm.packing import pack_documents
from loomsift.llm.quality import PIECE_BPE, keep_good
from loomsift.llm.secrets import mask_secrets
from loomsift.llm.simhash import keep_one
from loomsift.llm.suffixes import drop_repeats
from loomsift.llm.tokens import WORD_BPE


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the word rules or their tokeniser fertility reject go."""
    return keep_good(docs, vocabulary(PIECE_BPE))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id."""
    return keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out wherever they are not in their first place."""
    return drop_repeats(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text."""
    return mask_secrets(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and offset."""
    return pack_documents(docs, vocabulary(WORD_BPE))


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit_packing),
]

#: The stages compute fingerprints, encodings and packings that SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
