"""A corpus pipeline: quality rules, quality classifier, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``docs``, also such with names that the operators use themselves. Between
stages the rows are written as Parquet and read again, so a lost executor costs no more
than the stage at work. An empty table gives no rows in any stage; very long texts pass
whole, in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from forecourt.llm import packing, quality_classifier, quality_rules, simhash, suffix_dedup
from forecourt.llm.common import documents, durable, labels


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the risk-controlled quality rules keep.

    Null and empty texts have no words and go; a null doc_id is judged by its text alone;
    rows equal in id and text share one fate; a value equal to a cutoff stays; without
    enough labels only the base rule rejects.
    """
    return quality_rules.keep_documents(docs, labels(spark, sf_dir))


def keep_by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as good.

    Null and empty texts are scored like any other, by the zero vector; a null doc_id trains
    nothing; repeated rows share one fate; a score equal to the cutoff stays; without labels
    of both kinds every score is the share of good ones.
    """
    return quality_classifier.keep_good(docs, labels(spark, sf_dir))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest id, then the smallest hash of the text.

    Texts without words (null, empty) are near-duplicates of each other; rows without an id
    come last and go if another one of their group stays; of rows equal in id and text one
    stays; different texts with one id are told apart.
    """
    return simhash.keep_one(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 200 bytes or more that occur more than once.

    Every occurrence goes, so rows with equal long texts lose all of it; null texts stay
    null, shorter ones stay as they are; ids are not read but as part of a row's name; no
    row goes, even if nothing of its text is left.
    """
    return suffix_dedup.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in packed sequences.

    A null or empty text is the end token alone; null ids stay; repeated rows are packed as
    often as they occur; pieces of one length take places in the order in which they come.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", keep_by_rules),
    ("quality_classifier", keep_by_classifier),
    ("simhash", keep_one_of_each_group),
    ("suffix_dedup", cut_repeated_passages),
    ("packing", pack),
]

#: No SQL: the classifier, the near-duplicates' closure and the tokeniser are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
