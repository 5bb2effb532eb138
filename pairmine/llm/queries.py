"""Registered queries of the subpackage: name -> callable(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairmine.llm import (ann, bpe, licenses, mixing, packing, pii, quality, rules, runs, simhash, substring, toxicity,
                          vector_codes)
from pairmine.llm.common import table


def op1_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op3_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op4_quality_rules(spark, sf_dir):
    return rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("failed_rules")


def op5_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_adaptive_scan_ann(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"))


def op7_mix_sources(spark, sf_dir):
    out = mixing.rates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target",
                      (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def op8_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_bootstrapped_pii(spark, sf_dir):
    return pii.detect(table(spark, sf_dir, "documents"))


def op10_suffix_array_dedup(spark, sf_dir):
    return substring.dedup(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark, sf_dir):
    return runs.digests(runs.find_runs(runs.with_planted_runs(table(spark, sf_dir, "documents"))))


def op12_vector_codes(spark, sf_dir):
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_byte_bpe(spark, sf_dir):
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), with_decoded=True))


QUERIES = {f.__name__: f for f in (
    op1_simhash_near_dedup, op2_license_scan, op3_quality_classifier, op4_quality_rules,
    op5_toxicity, op6_adaptive_scan_ann, op7_mix_sources, op8_best_fit_packing,
    op9_bootstrapped_pii, op10_suffix_array_dedup, op11_periodic_runs, op12_vector_codes, op13_byte_bpe)}
