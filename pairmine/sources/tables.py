"""Readers for the driver's parquet tables and the corpus mapping used by the queries.

Mapping (fixed, documented in the README): the ``embeddings`` table holds both
corpora of a mining run. One id in five (``vec_id mod 5 = 0``) is a source
sentence, the other four are target sentences; together the two sides cover the
whole table. Texts come from ``documents`` by ``doc_id = vec_id`` (``'vec <id>'``
when there is no such document); ``label`` feeds the stand-in quality model.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: one id in SOURCE_EVERY is a source sentence.
SOURCE_EVERY = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@dataclass
class Corpora:
    src_vec: DataFrame    # idx, vec
    tgt_vec: DataFrame    # idx, vec
    src_attrs: DataFrame  # idx, label, text
    tgt_attrs: DataFrame  # idx, label, text


def is_source(id_col) -> "F.Column":
    return F.pmod(id_col, F.lit(SOURCE_EVERY)) == 0


def corpora(spark: SparkSession, sf_dir: str) -> Corpora:
    emb = table(spark, sf_dir, "embeddings")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), "text")
    vec = emb.select(F.col("vec_id").alias("idx"), F.col("embedding").alias("vec"))
    attrs = (emb.select(F.col("vec_id").alias("idx"), "label")
             .join(docs, "idx", "left")
             .select("idx", "label",
                     F.coalesce(F.col("text"), F.concat(F.lit("vec "), F.col("idx").cast("string"))).alias("text")))
    src = is_source(F.col("idx"))
    return Corpora(vec.filter(src), vec.filter(~src), attrs.filter(src), attrs.filter(~src))
