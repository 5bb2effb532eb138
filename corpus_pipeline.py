"""Corpus pipeline: toxicity, near-duplicates, personal data, mixing, packing.

``STAGES`` lists (name, function) pairs; each function takes (spark, docs, sf_dir) and
returns a DataFrame, which ``run`` writes as Parquet under the shared checkpoint folder
and rereads as the next stage's input. All stages but the last return the columns of
``documents``. Rows with null columns pass through every stage: a null text is an empty
document to the classifier, the fingerprint and the tokenizer, and stays null until the
last stage; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairmine.llm import mixing, packing, pii, simhash, toxicity
from pairmine.llm.common import staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon model scores below 0.5."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each SimHash component."""
    return simhash.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the found spans replaced by their kind and n_chars brought up to date."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's repetition rate asks for (0 to 3 times)."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its sequence and offset."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: The tokenizer and the learned lexicon have no SQL form; the tests hold the pipeline
#: against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
