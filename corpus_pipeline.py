"""Documents made ready for training: five stages, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from regidx.llm import byte_bpe, decontaminate, line_dedup, simhash, toxicity
from regidx.llm.common import table
from regidx.session import through_storage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine, learned from their labels, does not call toxic; all where it could learn nothing."""
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    if not machine.feature_of:
        return docs.select(*COLUMNS)
    return toxicity.score_documents(docs, machine).where("predicted = 0").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; lines of recurring templates stay in the first document alone."""
    return line_dedup.drop_recurring_lines(docs).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id."""
    return simhash.keep_one(docs).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages to speak of."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with the digests of what they decode to."""
    coded = byte_bpe.encode_documents(docs.select("doc_id", "text"))
    return byte_bpe.digest(coded, "doc_id", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: The learned score and its floating-point training cannot be said in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = through_storage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
