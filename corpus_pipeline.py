"""The corpus pipeline: stages over `documents`, each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all
but the last return the columns of documents.

Defined results: a null or empty text fails the base rules and goes in the first stage; rows
without doc_id are judged like others and keep their null; rows that repeat, or share a doc_id, are
judged each until the near duplicates, where one of a group of equal or near texts stays;
a text of any length is one document throughout, cut in pieces by the last stage only; columns
that documents has beside its own are carried to the fourth stage; empty tables give an
empty result; without labels nothing is learned, so no rule beyond the base rules and no rate but 1 applies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import best_fit_packing, jaccard_join, line_dedup, quality_rules, source_mixing
from quillspark.llm._shared import discard, staged, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.filter_documents(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least three documents share stay in one of them."""
    out = line_dedup.line_dedup(docs).drop("n_lines", "n_dropped")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays."""
    return jaccard_join.keep_representatives(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay as often as target weights of the labelled domains ask for."""
    return source_mixing.mix_documents(docs, source_mixing.domain_labels(table(spark, sf_dir, "labels")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their sequences."""
    return best_fit_packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("source_mixing", mixing),
    ("best_fit_packing", packing),
]

#: Classifier, thresholds and packing have no SQL; tests/llm holds run() against its parts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
