"""Incremental quality scoring (the resume path: J7 unscored_pairs, U4 append_scored,
M2 quality_score, K8/S6 stage tables) as a Structured Streaming job.

New candidate files landing in ``candidates_dir`` (Parquet, one row per pair) are
picked up by a file stream; each micro-batch keeps only the pairs not yet in the
scored table (anti join on (src_idx, tgt_idx), also within the batch), scores them
with the plug-in model and appends them. A pair whose scoring failed has no quality and
is tried again; ``read_scored`` keeps one row per pair, a scored one if there is any. The
scored table is partitioned by a hash bucket of the pair, and a batch reads only the
buckets that its own pairs fall in. The stream's checkpoint makes the job
restartable: a lost executor or driver resumes at the last committed batch, and a
batch that is replayed finds its pairs already scored. ``availableNow`` processes
what is there and stops, the batch analogue of the reference's resume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pairmine.operators import quality as Q
from pairmine.operators.models import Factory
from pairmine.session import stage_root
from pairmine.sources.io import _path_exists

CANDIDATE_SCHEMA = "src_idx long, tgt_idx long, src_text string, tgt_text string"


BUCKETS = 64    # folders of the scored table


def _bucket():
    return F.pmod(F.xxhash64("src_idx", "tgt_idx"), F.lit(BUCKETS)).cast("int")


def read_scored(spark: SparkSession, scored_dir: str) -> DataFrame:
    """One row per pair: a quality if the pair was ever scored, else its last error."""
    rows = spark.read.parquet(scored_dir)
    best = F.max(F.struct(F.col("quality").isNotNull().alias("ok"), "quality", "error")).alias("b")
    return rows.groupBy("src_idx", "tgt_idx").agg(best).select("src_idx", "tgt_idx", "b.quality", "b.error")


def score_new_pairs(batch: DataFrame, scored_dir: str, scorer: Factory | Q.Scorer, batch_size: int = 128) -> int:
    """One step of the resume path: score the pairs of ``batch`` without a quality and
    append them to ``scored_dir``. Returns the number of rows appended."""
    spark = batch.sparkSession
    stage_root(spark)
    pairs = batch.dropDuplicates(["src_idx", "tgt_idx"]).withColumn("bucket", _bucket())
    if _path_exists(spark, f"{scored_dir.rstrip('/')}/_SUCCESS"):
        here = [r["bucket"] for r in pairs.select("bucket").distinct().collect()]   # at most BUCKETS
        old = spark.read.parquet(scored_dir).filter(F.col("bucket").isin(here))
        pairs = Q.unscored_pairs(pairs, old)
    new = Q.score_pairs(pairs, scorer, batch_size).withColumn("bucket", _bucket())
    new = new.checkpoint(eager=True)
    n = new.count()
    if n:
        new.write.mode("append").partitionBy("bucket").parquet(scored_dir)
    return n


def start_incremental_scoring(spark: SparkSession, candidates_dir: str, scored_dir: str,
                              checkpoint_dir: str, scorer: Factory | Q.Scorer, available_now: bool = True,
                              batch_size: int = 128) -> StreamingQuery:
    stream = spark.readStream.schema(CANDIDATE_SCHEMA).parquet(candidates_dir)
    writer = (stream.writeStream
              .foreachBatch(lambda df, epoch: score_new_pairs(df, scored_dir, scorer, batch_size))
              .option("checkpointLocation", checkpoint_dir))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def coverage(spark: SparkSession, candidates_dir: str, scored_dir: str, n_sources: int) -> DataFrame:
    """A9 over the two stage tables."""
    cands = spark.read.schema(CANDIDATE_SCHEMA).parquet(candidates_dir)
    scored = read_scored(spark, scored_dir) if _path_exists(spark, scored_dir) else \
        spark.createDataFrame([], Q.SCORED_SCHEMA)
    return Q.candidate_coverage(cands, scored, F.lit(n_sources))
