"""Approximate nearest neighbours by an adaptive dimension scan of inverted lists.

Index: centroids from k-means on a bounded sample; every vector is put in the list of
its nearest centroid, and long lists are cut into blocks of at most ``BLOCK_ROWS``.
Search: a query goes to the blocks of its ``probes`` nearest lists, as many as it takes to
find ``TARGET_RECALL`` of the true neighbours among the sampled vectors (sparser than all
vectors, so their neighbours lie further apart). Inside a block all
vectors are rotated by one random orthogonal matrix and scanned in column blocks. After a
block of d dimensions the partial distance, scaled by D/d, estimates the full one; a
candidate is abandoned as soon as the hypothesis that it is among the k nearest is
rejected: estimate > (k-th best * (1 + EPSILON / sqrt(d))) squared. Survivors are measured
on the original vectors in double precision. Partial results are merged per query.

Vectors that are null, zero, of another length than the most common one, or hold null or
non-finite components take no part; fewer candidates than k give fewer rows; ties go to
the smaller id; rows that repeat id and vector count once, and rows that share an id but not
the vector are rows (queries, candidates) of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairmine.llm.common import staged

K = 10
QUERY_EVERY = 100
SAMPLE_ROWS = 20_000     # vectors that the centroids are fitted on, at most
MAX_LISTS = 4096
TARGET_RECALL = 0.95     # on the sample; sets the number of lists that a query visits
TUNE_QUERIES = 256       # sampled vectors that it is measured on
MIN_PROBES = 16
BLOCK_ROWS = 4096        # vectors of a list scanned by one task at a time
QUERY_BLOCK = 512        # queries that meet a block of a list at a time
DIM_BLOCK = 8
EPSILON = 2.1            # of the test; larger abandons later
SEED = 7


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def _sq(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :], 0)


def kmeans(x: np.ndarray, lists: int, rounds: int = 12, seed: int = SEED) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    lists = min(lists, len(x))
    c = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(rounds):
        own = np.concatenate([_sq(x[i:i + 4096], c).argmin(1) for i in range(0, len(x), 4096)])
        n = np.bincount(own, minlength=lists)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def tuned_probes(x: np.ndarray, cents: np.ndarray, k: int, target: float = TARGET_RECALL) -> int:
    """Lists to visit: the smallest number that holds ``target`` of the k nearest of
    ``TUNE_QUERIES`` sampled vectors, by brute force over the sample."""
    own = np.concatenate([_sq(x[i:i + 4096], cents).argmin(1) for i in range(0, len(x), 4096)])
    q = np.linspace(0, len(x) - 1, min(TUNE_QUERIES, len(x))).astype(int)
    dist = _sq(x[q], x)
    dist[np.arange(len(q)), q] = np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return 1
    near = np.argpartition(dist, k - 1, axis=1)[:, :k]
    order = _sq(x[q], cents).argsort(axis=1, kind="stable").argsort(axis=1)     # rank of each list
    places = np.take_along_axis(order, own[near], axis=1).ravel()
    return int(np.sort(places)[int(np.ceil(target * len(places))) - 1]) + 1


def valid_vectors(emb: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part, repeated rows once."""
    v = emb.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = (F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists("v", lambda x: x != 0))
    return v.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(fine).distinct()


def top_in_block(ids, rows, x, x_rot, q, q_rot, own_row, k=K, epsilon=EPSILON, dim_block=DIM_BLOCK):
    """The k nearest (ids, squared distances) of one query among the rows of a block."""
    dim = x.shape[1]
    alive = np.nonzero(rows != own_row)[0]
    if len(alive) > 4 * k:
        part = np.zeros(len(alive))
        limit = None
        for d in range(0, dim, dim_block):
            cols = x_rot[alive, d:d + dim_block] - q_rot[d:d + dim_block]
            part += np.einsum("ij,ij->i", cols, cols)
            if limit is None:   # the best by the first columns bound the k-th distance
                near = alive[np.argpartition(part, 2 * k)[:2 * k]]
                limit = np.partition(((x[near] - q) ** 2).sum(1), k - 1)[k - 1]
            seen = min(d + dim_block, dim)
            if seen < dim:
                keep = part * (dim / seen) <= limit * (1 + epsilon / np.sqrt(seen)) ** 2
                alive, part = alive[keep], part[keep]
            if len(alive) <= 4 * k:
                break
    dist = ((x[alive] - q) ** 2).sum(1)
    best = np.lexsort((ids[alive], dist))[:k]
    return ids[alive][best], dist[best]


def search(emb: DataFrame, k: int = K, query_every: int = QUERY_EVERY,
           target_recall: float = TARGET_RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each query row, by Euclidean distance."""
    # A vector is known by its row: ids may repeat.
    vecs = staged(valid_vectors(emb).withColumn("row", F.monotonically_increasing_id()), "vectors")
    dims = vecs.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return emb.sparkSession.createDataFrame([], schema)
    dim, rows = dims["d"], dims["count"]
    vecs = vecs.filter(F.size("v") == dim)
    # Bounded by SAMPLE_ROWS.
    some = vecs.orderBy(F.xxhash64("vec_id", F.lit("lists")), "vec_id", "v").limit(SAMPLE_ROWS).select("v").toPandas()
    some = np.array(some["v"].tolist())
    cents = kmeans(some, int(min(MAX_LISTS, max(1, np.sqrt(rows)))))
    probes = min(len(cents), max(MIN_PROBES, tuned_probes(some, cents, k, target_recall)))
    rot = rotation(dim)

    def assign(n):
        def run(batches):
            for b in batches:
                x = np.array(b.column(2).to_pylist()).reshape(-1, dim)
                d = _sq(x, cents)
                near = d.argmin(1)[:, None] if n == 1 else np.argpartition(d, n - 1, axis=1)[:, :n] if n < len(cents) \
                    else np.tile(np.arange(len(cents)), (len(x), 1))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(list(near.astype(np.int32)), pa.list_(pa.int32())),
                     pa.array([r.tobytes() for r in x], pa.binary())], names=["row", "id", "lists", "v"])
        return run

    shape = "row long, id long, lists array<int>, v binary"
    vecs = vecs.select("row", "vec_id", "v")
    index = staged(vecs.mapInArrow(assign(1), shape).select("row", "id", F.col("lists")[0].alias("list"), "v"), "lists")
    queries = staged(vecs.filter(F.pmod("vec_id", F.lit(query_every)) == 0).mapInArrow(assign(probes), shape)
                     .select("row", "id", F.explode("lists").alias("list"), "v"), "queries")
    # Blocks of each list and of the queries that visit it: one row per list.
    size = (index.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
            .join(queries.groupBy("list").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("q_blocks")), "list"))
    size = F.broadcast(staged(size, "sizes"))     # at most MAX_LISTS rows
    cells = ["list", "block", "q_block"]
    left = (index.join(size, "list").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
            .withColumn("q_block", F.explode(F.expr("sequence(0, q_blocks - 1)"))).select(*cells, "row", "id", "v"))
    right = (queries.join(size, "list").withColumn("q_block", F.pmod(F.xxhash64("row"), F.col("q_blocks")).cast("int"))
             .withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).select(*cells, "row", "id", "v"))

    def scan(items: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(items) and len(asked):
            ids, rows = items["id"].to_numpy(), items["row"].to_numpy()
            x = np.frombuffer(b"".join(items["v"]), np.float64).reshape(-1, dim)
            x_rot = x @ rot
            for own, qid, v in zip(asked["row"], asked["id"], asked["v"]):
                q = np.frombuffer(v, np.float64)
                near, dist = top_in_block(ids, rows, x, x_rot, q, q @ rot, own, k)
                out.append(pd.DataFrame({"query_row": own, "query_id": qid, "vec_id": near, "score": np.sqrt(dist)}))
        return pd.concat(out) if out else pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "score": []})

    parts = left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInPandas(
        scan, "query_row long, query_id long, vec_id long, score double")
    order = Window.partitionBy("query_row").orderBy("score", "vec_id")
    return (parts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
