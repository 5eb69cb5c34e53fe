"""Corpus pipeline: classifier, rules, near-duplicates, mixing, packing; each stage reads what the last one wrote.

Every stage but the last returns rows of documents with the columns of its input: the classifier and the rules
leave out what they reject, near-duplicate removal keeps the smallest doc_id of each component, mixing gives each
row 0 to 3 times, as the slots of its schedule take it. Packing returns a row for each piece of each row that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bahikhata.llm import classifier, mixing, outliers, packing, simhash
from bahikhata.llm.common import compact, removed, scratch, table, written
from bahikhata.llm.tokens import public


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the table's labels, doesn't reject."""
    return compact(classifier.kept(docs, table(spark, sf_dir, "labels")))


def ruled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the outlier test keep."""
    return compact(outliers.kept(docs))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one with the smallest doc_id."""
    return compact(simhash.one_of_each(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, in the order of its schedule."""
    return mixing.repeated(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequences and offsets."""
    return packing.digest(docs, public("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", classified),
    ("quality_rules", ruled),
    ("simhash_near_dedup", deduplicated),
    ("source_mixing", mixed),
    ("packing", packed),
]
#: Trained scores, fingerprints and packing plans have no SQL form; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's own tables, and the rows it was given, are removed once its result is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as stay:
            docs, path = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
            stay.append(path)
        if last:
            removed(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
