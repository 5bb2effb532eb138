"""MT evaluation queries on the driver's tables (unit 12).

Evaluation rows (fixed mapping): every document is the prediction and the next
document (``doc_id + 1``) the reference; whole texts, every document but the last.
``compare_runs`` scores a second system (the document two before the reference)
against the same references.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairmine.operators import mt_metrics as MT
from pairmine.plans.mining_queries import rounded
from pairmine.sources.tables import table


def eval_rows(spark: SparkSession, sf_dir: str, offset: int = 1) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    a = docs.select(F.col("doc_id").alias("row_id"), F.col("lang").alias("source"),
                    F.col("text").alias("prediction"))
    b = docs.select((F.col("doc_id") - offset).alias("row_id"), F.col("text").alias("reference"))
    return a.join(b, "row_id")


def q_bleu_rows(spark, sf_dir):
    return rounded(MT.bleu_rows(eval_rows(spark, sf_dir)))


def q_chrf_rows(spark, sf_dir):
    return rounded(MT.chrf_rows(eval_rows(spark, sf_dir)))


def q_chrf_pp(spark, sf_dir):
    return rounded(MT.chrf_pp_rows(eval_rows(spark, sf_dir)))


def q_meteor_rows(spark, sf_dir):
    return rounded(MT.meteor_rows(eval_rows(spark, sf_dir)))


def q_corpus_bleu(spark, sf_dir):
    return rounded(MT.corpus_bleu(eval_rows(spark, sf_dir)))


def q_corpus_chrf(spark, sf_dir):
    return rounded(MT.corpus_chrf(eval_rows(spark, sf_dir)))


def q_evaluate_table(spark, sf_dir):
    ev = MT.evaluate_table(eval_rows(spark, sf_dir))
    return rounded(ev.select("row_id", "source", "bleu", "chrf", "meteor"))


def q_metric_means(spark, sf_dir):
    ev = MT.evaluate_table(eval_rows(spark, sf_dir))
    return rounded(MT.metric_means(ev, ["bleu", "chrf", "meteor"]))


def q_compare_runs(spark, sf_dir):
    """System A (the previous document) vs system B (the one before), same rows. Both systems
    are counted in one pass. Where an id of B's predictions repeats, A's row stands beside each of
    them; one of these is A's own."""
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("row_id"),
                                                    F.col("text").alias("prediction_b"))
    one_of = F.row_number().over(Window.partitionBy("row_id").orderBy("row_id"))
    both = eval_rows(spark, sf_dir, 1).join(docs.withColumn("_of", one_of), "row_id")
    a, b = MT.count_systems(both, ["bleu", "chrf"], ["prediction", "prediction_b"],
                            own=[F.col("_of") == 1, F.lit(True)])
    ca = MT.bleu_rows(a).join(MT.chrf_rows(a), "row_id")
    cb = MT.bleu_rows(b).join(MT.chrf_rows(b), "row_id")
    return rounded(MT.compare_runs(ca, cb, ["bleu", "chrf"]))


QUERIES = {
    "bleu_rows": q_bleu_rows,
    "chrf_rows": q_chrf_rows,
    "chrf_pp": q_chrf_pp,
    "meteor_rows": q_meteor_rows,
    "corpus_bleu": q_corpus_bleu,
    "corpus_chrf": q_corpus_chrf,
    "evaluate_table": q_evaluate_table,
    "metric_means": q_metric_means,
    "compare_runs": q_compare_runs,
}
