"""The corpus pipeline: from raw documents to packed training sequences.

Every stage works on all that the one before it kept. ``STAGES`` names them; each takes (spark, docs, sf_dir) and
returns the columns of ``documents`` but the last, which returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm.line_dedup import clean_documents
from corvane.llm.mixing import mixed_documents
from corvane.llm.packing import pack
from corvane.llm.quality_rules import STANDARD, good_documents
from corvane.llm.queries import vocabulary
from corvane.llm.simhash_dedup import first_of_each_group
from corvane.session import fresh_path, materialise, table
from corvane.shipping import ship

#: Fingerprints, the mix and the packing have no counterpart in SQL; a brute-force version tests them.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the standard policy keeps."""
    return good_documents(docs, STANDARD)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that three or more of them share."""
    ship(spark)
    return clean_documents(docs, fresh_path(spark, "line-index"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates."""
    ship(spark)
    return first_of_each_group(docs, radius=2, shingle=3)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    ship(spark)
    return pack(docs, vocabulary("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("source_mixing", mixture),
    ("best_fit_packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
