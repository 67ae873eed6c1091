"""The corpus pipeline: classifier, rules, line dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that its
predecessor kept; all but the last return the columns of documents.

Defined cases: null and empty texts fail the base rule and go with the quality rules; rows without an id hold no line against others in line dedup and
rank last in near-dedup; repeated rows are near copies of each other, one stays; columns beyond those of documents pass through, whatever their names;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoline.llm import line_dedup, packing, quality_classifier, quality_rules, similarity
from chronoline.llm.common import bounded_batches, checkpoint, table

SHINGLE_WORDS = 5
SIMILARITY = 0.8


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents under the threshold go."""
    bounded_batches(spark)
    return quality_classifier.keep_documents(docs, table(spark, sf_dir, "labels"))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that a rule rejects go."""
    return quality_rules.keep_documents(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: lines repeated across documents go; n_chars follows the text."""
    bounded_batches(spark)
    kept = line_dedup.dedup_lines(docs, counts=False)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: one row of each near-duplicate group stays, that of the smallest doc_id; rows without an id rank last."""
    bounded_batches(spark)
    return similarity.keep_one(docs, SHINGLE_WORDS, SIMILARITY)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: length buckets and token-budget batches."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", classify_quality),
    ("quality_rules", apply_quality_rules),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_documents),
    ("packing", pack),
]

#: No SQL: the classifier is trained and the last but one stage follows links to any depth.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))  # a stage reads its input more than once
    return STAGES[-1][1](spark, docs, sf_dir)
