"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmine.session import stage_root

# Words of most contracts: runs of anything but the six ASCII white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Spark deletes a query's shuffles when it has ended (else when the driver collects garbage).
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, tag: str, drop_shuffles: bool = False) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs the tasks it ran, never the stages before.
    ``drop_shuffles``: the shuffles of the write leave the disk as soon as it is done.
    """
    spark = df.sparkSession
    path = f"{stage_root(spark).rstrip('/')}/llm-{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(DROP_SHUFFLES, None)
    try:
        if drop_shuffles:
            spark.conf.set(DROP_SHUFFLES, "true")
        df.write.parquet(path)
    finally:
        if drop_shuffles:
            spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def checked_broadcast(small: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint only when a count shows at most ``max_rows`` rows; the plain
    frame (shuffle join) otherwise. ``small`` should be staged, as it is counted."""
    return F.broadcast(small) if small.limit(max_rows + 1).count() <= max_rows else small


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    ``edges`` has two BIGINT node columns. Returns (node, root) for every node that is
    not itself the smallest of its component. Each round is staged; the number of
    rounds grows with the logarithm of the longest chain. Nothing is collected but
    one row of counters per round.
    """
    e = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
         .filter("u <> v").distinct())
    e = staged(e, "cc")
    seen = None
    while True:
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        state = (state["n"], state["h"])
        if state[0] == 0 or state == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.join(low, "u").filter("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        large = staged(large, "cc")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v")))
                 .filter("u <> v").distinct())
        e = staged(small, "cc")
