"""The corpus pipeline: quality rules, near-duplicates, personal data, mixture, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; its rows are written as Parquet and read again by the next one.

Defined results of every stage: an empty table stays empty; further columns, whatever their names, are kept up to the packing;
texts of any length are taken whole. What nulls, repeated rows and ties give is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from curvelab.llm import mixing, neardup, packing, pii, repetition
from curvelab.llm.common import documents_of, stored
from curvelab.llm.queries import MIX_WEIGHTS


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go, null, empty and blank texts with them; repeated rows are judged alike."""
    return repetition.passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, of the smallest doc_id (one without a doc_id where none has any); repeated rows are copies.

    Texts that SimHash links, and those that share a band of shingle minima, are compared; five-word Jaccard similarity of 0.8 or more makes a copy.
    """
    return neardup.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data is replaced by its kind; overlapping ones become one, named after the first; null texts stay null."""
    return pii.redact(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target rate makes it, in a global random order; sources without a weight, null too, stay as they are; repeated doc_ids share one count."""
    return mixing.mix(docs, MIX_WEIGHTS).select(*docs.columns)


def packing_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in the sequences; a null text is its closing id alone; repeated rows are packed each for itself."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("personal data", personal_data),
    ("mixing", mixing_sources),
    ("packing", packing_sequences),
]

#: Hashes, weak supervision and packing are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents_of(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
